"""Reflow against a plain version: over whole tables, and over small random documents full of marks."""

import os
import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as t
from inkstone.operators import predicates as p
from inkstone.operators.reflow import paragraphs, reflow
from inkstone.options import PdfOptions, ShortHeading
from inkstone.plans import queries as q

sys.path.insert(0, os.path.dirname(__file__))
import plain_reflow as plain  # noqa: E402

DATA = "/root/testdata/sf0.01"


def differences(docs, **how):
    options = PdfOptions(add_page_header=how.get("header", False), compact=how.get("compact", False), short_heading=ShortHeading(max_len=how.get("most", 8)))
    bad = []
    for r in reflow(docs, options, level=how.get("level", 2)).collect():
        segments, joined = plain.reflow(r.text, **how)
        if [s.text for s in r.segments] != segments or r.reflowed != joined:
            bad.append((r.text, [tuple(s) for s in r.segments], segments))
    return bad


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("how", [{}, {"compact": True, "most": 12, "level": 1}, {"level": 3, "header": True}])
@pytest.mark.parametrize("source", ["documents", "marked", "split_lines"])
def test_whole_tables(spark, how, source):
    docs = {"documents": q.documents, "marked": q.marked, "split_lines": lambda s, d: q.documents(s, d).withColumn("text", F.regexp_replace("text", "([。，])", "$1\n"))}[source](spark, DATA)
    assert differences(docs.repartition(4), **how) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_queries(spark):
    docs = {r.doc_id: r.text for r in q.documents(spark, DATA).collect()}
    for name, how in (("reflow_novel", {}), ("reflow_compact", {"compact": True, "most": 12, "level": 1})):
        rows = q.QUERIES[name](spark, DATA).collect()
        assert len(rows) == len(docs)
        for r in rows:
            segments, joined = plain.reflow(docs[r.doc_id], **how)
            assert (r.reflowed, r.n_segments) == (joined, len(segments))
    got = {}
    for r in q.QUERIES["reflow_paragraphs"](spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.seg_no, r.text))
    want = {i: list(enumerate(plain.reflow(x)[0])) for i, x in docs.items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}


PIECES = ["的", "一是了", "我不人在他有", "。", "！", "？", "，", "、", "：", ":", "；", "…", "..", "...", ".", "“", "”", "‘", "’", "「", "」", "『", "』", "﹁", "﹂", "〞", "（", "）", "(", ")", "《", "》", "【", "】", " ", "  ", "　", "　　", "\t", "a", "Abc", "abcdabcdabcd", "第", "章", "第一章 风", "卷一", "=== ", "===", "---", "* ", "1.", "1)", "（1）", "一、", "书名：", "作者", "·", "12", "𠀀", "x x x ", "目录", "é", "番外"]


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, seed):
    rnd = random.Random(seed)
    lines = lambda: "".join(rnd.choice(PIECES) for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8])))
    rows = [(i, rnd.choice(["\n", "\n", "\r\n", "\r"]).join(lines() for _ in range(rnd.randint(1, 14)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert differences(docs, level=seed + 1, header=seed == 2, compact=seed == 1) == []


def test_rows_and_columns_stay(spark):
    schema = "doc_id long, _kind string, _lines int, text string, kind int, flags int, raw string, mode int, doc int, segments int"
    texts = [None, "", " \n ", "的一是。\n\n了我", "Plain English text that is long enough to be taken as Latin, surely.", "的一是。\n\n了我"]
    df = spark.createDataFrame([(None if i == 3 else 1, "k", i, x, 1, 2, None, 3, 4, 5) for i, x in enumerate(texts)], schema)
    got = sorted(reflow(df).collect(), key=lambda r: r["_lines"])
    assert [r.reflowed for r in got] == ["", "", "", "的一是。\n\n了我", texts[4], "的一是。\n\n了我"]
    assert [r.text for r in got] == texts and [r["_kind"] for r in got] == ["k"] * 6 and got[3].doc_id is None
    assert [[s.rule for s in r.segments] for r in got[3:5]] == [["sentence end", "heading"], []]
    assert paragraphs(reflow(df)).count() == 4
    assert reflow(df.limit(0)).count() == 0
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # documents over several batches
    many = "\n".join(f"的一是{'。' if k % 3 == 0 else '，'}" for k in range(50))
    assert reflow(spark.createDataFrame([(many,), ("了",), (many,)], "text string").coalesce(1)).collect()[2].reflowed == plain.reflow(many)[1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)


def test_one_scan_and_no_shuffle(spark):
    plan = q.QUERIES["reflow_novel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() if os.path.isdir(DATA) else ""
    assert plan.count("FileScan") <= 1 and "Exchange" not in plan


#: Characters of most long lines: enough for a recursion to overflow and for quadratic time to show.
N = 300_000
LONG = {"spaces": " " * N, "spaces inside": "的" + " " * N + "x", "wide": "的" + "　" * N + "x", "digits": "1" * N + "x", "han": "的" * N, "dividers": "-" * N, "dividers and more": "- " * 10**5 + "x", "brackets": "（" * 1000 + "的" * N, "letters": "a" * N + "的", "marks": "“" * 10**5, "dots": "." * N + "x", "closers": "」" * N + "x", "words": "w的 " * 10**6, "numbers": " ".join(map(str, range(10**5))), "same": "ab " * N, "pairs": "ab cd " * 10**5 + "x", "newlines": "的" + "\n" * N + "x", "token": "abcdefgh" * 10**5}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_long_lines(spark, kind):
    df = spark.createDataFrame([(LONG[kind],)], "text string")
    s = F.col("text")
    began = time.time()
    flags = [p.all_ascii(s), p.all_ascii_digits(s), p.all_cjk(s), p.all_cjk(s, True), p.mixed_cjk_ascii(s), p.latin_leading(s), p.begins_dialog(s), p.ends_dialog(s), p.begins_list(s), p.has_comma(s), p.ends_colon(s), p.ends_ellipsis(s), p.ends_strong(s), p.divider(s), p.indented(s), p.page_marker(s), p.title(s), p.metadata(s), p.wrapped(s), p.suspicious_quotes(s), p.short_heading(s)]
    texts = [t.normalize_newlines(s), t.save_newlines(s), t.strip_half_width_indent(s), t.right_trim(s), t.probe(s), t.normalize_white_space(s), t.cap_blank_lines(s), t.trim_trailing_newlines(s), t.collapse_line(s)]
    row = df.select(*(f.alias(f"f{k}") for k, f in enumerate(flags)), *(F.length(x).alias(f"t{k}") for k, x in enumerate(texts))).first()
    assert row[f"t{len(texts) - 1}"] == len(plain.collapsed(LONG[kind])) if kind not in ("words", "numbers") else True
    assert len(reflow(df).first().reflowed) == len(plain.reflow(LONG[kind])[1]) if kind not in ("words", "numbers", "brackets") else True
    assert time.time() - began < 60


def test_reflow_takes_batches_in_slices():
    """A batch of many texts becomes Python objects by slices, and a Latin text is sent once, with its document."""
    import pyarrow as pa

    from inkstone.operators import reflow as module

    n = 3000
    texts = [f"latin text {i}" for i in range(n)]
    names = ["doc_id", "text"]
    docs = pa.StructArray.from_arrays([pa.array(range(n)), pa.array(texts)], names)
    batch = pa.RecordBatch.from_arrays([docs, pa.array([""] * n), pa.array([module.AS_IS] * n, pa.int32()), pa.array([0] * n, pa.int32())], ["doc", "text", "kind", "flags"])
    out = list(module._walked(PdfOptions(), 2, [*names, "segments", "reflowed"], 1)(iter([batch])))
    assert max(b.num_rows for b in out) <= 256
    assert [x for b in out for x in b.column(3).to_pylist()] == texts and [x for b in out for x in b.column(0).to_pylist()] == list(range(n))
