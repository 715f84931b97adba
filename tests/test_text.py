import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone import options
from inkstone.functions import text as t
from inkstone.operators import dictionary as dic
from inkstone.operators import predicates as p
from inkstone.operators import quotes, reflow


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1:] if len(columns) > 1 else r[1] for r in sorted(df.select("i", *columns).collect())]


def test_quotes(spark):
    given_ = ["“Hello\"", "「Hello\"", "‘Hello'", "『Hello'", "don't", "rock'n'roll", '"a" "b"', None, "", "「a\" \"b\" \"c\"", "it‘s 'a'"]
    want = ["“Hello”", "「Hello」", "‘Hello’", "『Hello』", "don't", "rock'n'roll", "“a” “b”", None, "", "「a」 “b” “c”", "it‘s ‘a’"]
    assert column(spark, given_, quotes.normalize_quotes(F.col("s"))) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab'\"“”‘’「」『』 中", max_size=20), min_size=1, max_size=30))
def test_quotes_keep_length_and_are_settled(spark, texts):
    once = column(spark, texts, quotes.normalize_quotes(F.col("s")))
    assert [len(x) for x in once] == [len(x) for x in texts]
    assert column(spark, once, quotes.normalize_quotes(F.col("s"))) == once


def test_suspicious(spark):
    given_ = ["”Hello“", "」你好「", "「Hello”", "“Hello」", "「Hello』", "“ok”", "“open only", "", "x"]
    assert column(spark, given_, p.suspicious_quotes(F.col("s"))) == [True] * 5 + [False] * 4


def test_collapse(spark):
    given_ = [" ".join(["背负着一切的麒麟"] * 4), "AbcdAbcdAbcd", "第一季大结局" * 3, "哈哈哈哈哈哈", "a b a b a b c", "x a a a ab", "", "  ", "a\t b"]
    assert column(spark, given_, t.collapse_line(F.col("s"))) == ["背负着一切的麒麟", "Abcd", "第一季大结局", "哈哈哈哈哈哈", "a b c", "x a ab", "", "  ", "a b"]


def phrases(tokens):
    """Collapse by plain loops."""
    for start in range(len(tokens)):
        for size in range(1, 9):
            one = tokens[start : start + size]
            n = 1
            while len(one) == size and tokens[start + n * size : start + (n + 1) * size] == one:
                n += 1
            if n >= 3:
                return tokens[: start + size] + tokens[start + n * size :]
    return tokens


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c."]), min_size=1, max_size=14), min_size=1, max_size=40))
def test_collapse_phrases_like_loops(spark, rows):
    assert column(spark, [" ".join(r) for r in rows], t.collapse_phrases(F.col("s"))) == [" ".join(phrases(r)) for r in rows]


def stack_spoilt(s):
    stack = []
    for ch in s:
        if ch in p.PAIRS:
            stack.append(p.PAIRS[ch])
        elif ch in p.PAIRS.values() and (not stack or stack.pop() != ch):
            return True
    return bool(stack)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="（）()[]【】a中", max_size=12), min_size=1, max_size=40))
def test_unclosed_bracket_is_a_stack(spark, rows):
    assert column(spark, rows, p.unclosed_bracket(F.col("s"))) == [stack_spoilt(s) for s in rows]


def test_lines(spark):
    assert column(spark, ["──────", "======", "───===───", "--", "- a -"], p.divider(F.col("s"))) == [True, True, True, False, False]
    assert column(spark, ["第一章 开始", "第一章", "目录", "番外篇"], p.title(F.col("s"))) == [True, False, True, True]
    assert column(spark, ["书名：红楼梦", "书名：“红”", "作者", "谁：我"], p.metadata(F.col("s"))) == [True, False, False, False]
    assert column(spark, ["物品准备：", "他说。", "第一章", "一，二"], p.short_heading(F.col("s"))) == [True, False, True, False]
    assert column(spark, ["1) 甲", "（12）乙", "- x", "1.x", "一、"], p.begins_list(F.col("s"))) == [True, True, True, False, True]
    s = F.col("s")
    assert column(spark, ["结束.", "他说：", "好。", "……", "好。”", "甲；"], *(p.sentence_boundary(s, k) for k in (1, 2, 3))) == [
        (False, False, True), (True, True, False), (True, True, True), (False, False, False), (True, True, True), (True, False, False),
    ]


def test_functions(spark):
    n = spark.createDataFrame([(1,), (26,), (27,), (4,), (9,), (7,), (0,), (1994,), (703,)], "n int")
    rows = n.select("n", *(t.counter(F.col("n"), F.lit(k)) for k in ("lowerLetter", "upperRoman", "decimalZero", "other"))).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert (got[1][0], got[26][0], got[27][0], got[703][0]) == ("a", "z", "aa", "aaa")
    assert (got[4][1], got[9][1], got[1994][1], got[7][2], got[0]) == ("IV", "IX", "MCMXCIV", "07", ("a", "I", "01", "1"))
    assert spark.range(1).select(t.progress_bar(F.lit(45))).first()[0] == "[" + "🟩" * 4 + "🟨" * 6 + "]"
    assert spark.range(1).select(t.combine_path(F.lit("OEBPS/text/"), F.lit("../img/a.xhtml"))).first()[0] == "OEBPS/img/a.xhtml"
    assert column(spark, [None, "abc", "x" * 60], t.middle_ellipsis(F.col("s"), 10)) == ["", "abc", "xxx...xxxx"]


def test_reflow(spark):
    given_ = ["他的脸上露出了痛苦的面\n容。", "面\n容", "“你好。”\n“再见。”", "latin " * 20 + "\r\nend", "", None, "  \n "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given_)], "doc_id int, text string")
    got = {r.doc_id: r for r in reflow.reflow(df).collect()}
    assert [got[i].reflowed for i in range(7)] == ["他的脸上露出了痛苦的面容。", "面\n\n容", "“你好。”\n\n“再见。”", given_[3], "", "", ""]
    assert [s.rule for s in got[1].segments] == ["heading", "heading"]
    compact = reflow.reflow(df, options.PdfOptions(compact=True)).where("doc_id = 2").first()
    assert compact.reflowed == "“你好。”\n“再见。”"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="中文字，。“”（）：\n　章第一", max_size=60), min_size=1, max_size=20))
def test_reflow_keeps_what_is_seen(spark, texts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "doc_id int, text string")
    seen = lambda s: sorted(re.sub(r"\s", "", s))
    for r in reflow.reflow(df).collect():
        assert len(seen(r.reflowed)) <= len(seen(texts[r.doc_id]))
        if not re.search(r"(.{4,10})\1\1|(\S+)( \2){2}", texts[r.doc_id].replace("　", " ")):
            assert seen(r.reflowed) == seen(texts[r.doc_id])


def test_conversion(spark):
    texts = ["中国的皇后在这里说“你好”", "", None, "abc", "头发后来"]
    big = {**dic.SAMPLE, "STCharacters": dic.SAMPLE["STCharacters"] | {chr(0xAC00 + i): "x" for i in range(dic.EXPRESSION_KEYS)}}
    want = ["中國的皇后在這裏說「你好」", "", None, "abc", "頭髮後來"]
    assert column(spark, texts, dic.convert(F.col("s"), "s2tw", punctuation=True)) == want
    assert column(spark, texts, dic.convert(F.col("s"), "s2tw", big, punctuation=True)) == want
    assert dic.parse_config("T2S (x)") == "t2s" and dic.parse_config("nope") == "s2t"
    assert set(dic.ROUNDS) == set(dic.CONFIGS) and {s for r in dic.ROUNDS.values() for x in r for s in x} <= set(dic.SLOTS)
    with pytest.raises(ValueError, match="row 2"):
        dic.check_specs([("STPhrases", "Append", "x"), ("STPhrases", "Other", "x")])


def test_specs(spark):
    rows = [(0, "STPhrases", "Append", "a"), (1, "Nope", "Append", "a"), (2, "STPhrases", "Override", " "), (3, "TWPhrases", "Override", "b")]
    df = spark.createDataFrame(rows, "ord int, slot string, mode string, path string")
    assert sorted(r.ord for r in dic.valid_specs(df).collect()) == [0, 3]
    assert dic.label("base", []) == "base" and dic.label("base", [("b", "", ""), ("a", "", ""), ("b", "", "")]) == "base + b, a"
    last = dic.latest_requests(spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "z")], "s int, n int, v string"), "s", "n")
    assert sorted(map(tuple, last.collect())) == [(1, 9, "y"), (2, 1, "z")]


def test_options():
    with pytest.raises(ValueError, match="direction"):
        options.check_batch(["a"], True, None)
    assert options.detofu_level("EXT-C") == "ExtC" and options.detofu_level("EXT-C", prefixed=False) == "ExtB" and options.detofu_level(None) == "ExtB"
    assert options.boundary_level(9) == 3 and options.pdf_engine(2, "linux-arm64") == 1
    base, user = {"a": {"b": 1, "c": [1, 2]}, "d": 2}, {"a": {"c": [3]}, "e": 5}
    assert options.merge(base, options.difference(base, options.merge(base, user))) == options.merge(base, user)
    assert options.ShortHeading(custom_regex="(").custom() is None


def test_bracket_boundary_looks_at_brackets_only(spark):
    """Runs of other characters go before anything is split into characters; the same answers as before."""
    inner = ["一二三，abc" * 30, "一" * 200, "（一）" * 60, "一）（" * 60, "》》《一" * 60, "𠀀abcd一二三四五" * 20, "abcde一二三四五" * 20, "", "　", "abcd一二", None]
    own = p.bracket_boundary(F.col("s"))
    assert column(spark, [None if x is None else f" 《{x}》　" for x in inner] + ["《", "《》", "", "（一》", "一》"], own) == [True, True, True, True, False, True, False, False, False, False, False, False, False, False, False, False]
    for split in str(own).split("split(")[1:]:  # no whole text is split
        assert split.startswith("regexp_replace(")
