"""Queries over the driver's tables, each with SQL that gives the same rows.

The tables hold no Chinese text, so that the documents are projected on Chinese characters first: the
same ``translate`` on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import chars as c
from inkstone.functions import text as t
from inkstone.operators import batch, matching, numbering, overlay, quotes, reflow, settings, tables
from inkstone.operators import dictionary as dic
from inkstone.operators import predicates as p
from inkstone.options import PdfOptions, ShortHeading
from inkstone.sources.files import path_of_uri

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FROM = "abcdefghijklmnopqrstuvwxyz .,!?$#%&*"
TO = "的一是了我不人在他有这个上们来到时大地为子中你说生国　。，！？“”：第章"
MARKED = ("wyfvgb#%&*", "（）【】“”「」《》")
QUOTED = ("#%&*$", "\"”“「」")

CTE_DOCS = f"docs AS (SELECT doc_id, translate(lower(text), '{FROM}', '{TO}') AS text FROM documents)"
CTE_LINES = "lines AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10)))))::BIGINT - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM docs)"
LINES = f"WITH {CTE_DOCS}, {CTE_LINES}"
MARKED_LINES = f"WITH docs AS (SELECT doc_id, translate(lower(text), '{MARKED[0]}', '{MARKED[1]}') AS text FROM documents), {CTE_LINES}"
CHARS = "chars AS (SELECT doc_id, line_no, unnest(generate_series(1, length(line))) AS i, unnest(string_split(line, '')) AS c FROM lines WHERE line <> '')"
STRIP = lambda s: f"regexp_replace({s}, '^[{c.W}]+|[{c.W}]+$', '', 'g')"
LAST = lambda s: f"regexp_extract({s}, '([^{c.W}])[{c.W}]*$', 1)"
HAS = lambda s, rx: f"regexp_matches({s}, '{rx.replace(chr(39), chr(39) * 2)}')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.translate(F.lower("text"), FROM, TO).alias("text"))


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.translate(F.lower("text"), *MARKED).alias("text"))


def quoted(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.translate("text", *QUOTED).alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(n).cast("long").alias(n) if k in ("int", "smallint") else F.col(n) for n, k in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf: longs(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return add


def line_query(name: str, flag: Callable[[Column], Column], condition: str, source=documents, ctes: str = LINES) -> None:
    """Whether a predicate holds, for every line."""

    @query(name, f"{ctes} SELECT doc_id, line_no, line, ({condition}) AS holds FROM lines")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return lines(source(spark, sf)).withColumn("holds", flag(F.col("line")))


#: Projections of words, each a line, for which predicates on short lines hold often and fail often.
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"
WORDS = {
    "han": ("aeiou", "的一是了我"),
    "spaced": ("aeioutnrs", "的一是了我　　的一"),
    "digits": (_CONSONANTS, "123456789０１２３４５６７８９00"),
    "signs": (_CONSONANTS, "─═-=~～*＊★☆_─═-=~～*＊★☆"),
    "lists": ("thoans", "1)（2-."),
    "titles": ("thearn", "第章一回节分"),
}


def words(kind: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """Documents with a word a line, and the same lines in SQL."""
    old, new = WORDS[kind]

    def source(spark: SparkSession, sf: str) -> DataFrame:
        return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.translate(F.translate(F.lower("text"), old, new), " ", "\n").alias("text"))

    return source, f"WITH docs AS (SELECT doc_id, replace(translate(lower(text), '{old}', '{new}'), ' ', chr(10)) AS text FROM documents), {CTE_LINES}"


# ---------------------------------------------------------------- characters and lines
@query("char_profile", f"WITH {CTE_DOCS} SELECT doc_id, length(text)::BIGINT AS n_chars, len(regexp_extract_all(text, '[{c.CJK}]'))::BIGINT AS n_cjk, len(regexp_extract_all(text, '[{c.DIGIT}]'))::BIGINT AS n_digits, len(regexp_extract_all(text, '[{c.LETTER}]'))::BIGINT AS n_letters, (length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')))::BIGINT AS n_utf16 FROM docs")
def char_profile(spark, sf):
    n = lambda cls: F.regexp_count("text", F.lit(f"[{cls}]"))
    return documents(spark, sf).select("doc_id", F.length("text").alias("n_chars"), n(c.CJK).alias("n_cjk"), n(c.DIGIT).alias("n_digits"), n(c.LETTER).alias("n_letters"), c.utf16_length(F.col("text")).alias("n_utf16"))


_LATIN_SQL = f"NOT {HAS('head', f'[{c.CJK}]')} AND length(head) >= 40 AND len(regexp_extract_all(head, '[{c.LATINISH.replace(chr(39), chr(39) * 2)}]')) * 10 >= length(head) * 9"


@query("latin_leading", f"WITH heads AS (SELECT doc_id, left(regexp_replace(text, '[{c.W}]', '', 'g'), 200) AS head FROM documents) SELECT doc_id, ({_LATIN_SQL}) AS latin FROM heads")
def latin_leading(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", p.latin_leading(F.col("text")).alias("latin"))


@query("mostly_cjk", f"""{LINES}, {CHARS},
    k AS (SELECT doc_id, line_no, i, CASE WHEN {HAS('c', f'[{c.CJK}]')} THEN -1 WHEN {HAS('c', f'[{c.LETTER}]')} THEN 1 ELSE 0 END AS v FROM chars),
    run AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS lead FROM k)
    SELECT doc_id, line_no FROM run GROUP BY doc_id, line_no HAVING count(*) FILTER (WHERE v = -1) > 0 AND sum(v) <= 0 AND max(lead) <= 4""")  # fmt: skip
def mostly_cjk(spark, sf):
    return lines(documents(spark, sf)).where(p.mostly_cjk(F.col("line"))).select("doc_id", "line_no")


line_query("all_ascii", p.all_ascii, HAS("line", r"^[\x00-\x7F]+$"), *words("han"))
line_query("all_ascii_digits", p.all_ascii_digits, HAS("line", rf"^[ {c.DIGIT}]*[{c.DIGIT}][ {c.DIGIT}]*$"), *words("digits"))
line_query("all_cjk", p.all_cjk, HAS("line", rf"^[{c.CJK}]+$"), *words("han"))
line_query("all_cjk_spaced", lambda s: p.all_cjk(s, True), f"{HAS('line', f'^[{c.W}{c.CJK}]+$')} AND {HAS('line', f'[{c.CJK}]')}", *words("spaced"))
_A = f"{c.LETTER}{c.DIGIT}"
line_query("mixed_cjk_ascii", p.mixed_cjk_ascii, HAS("line", f"^[{c.NEUTRAL}]*([{_A}][{_A}{c.NEUTRAL}]*[{c.CJK}]|[{c.CJK}][{c.CJK}{c.NEUTRAL}]*[{_A}])"), *words("han"))
line_query("visual_dividers", p.divider, f"{HAS('line', f'^[{c.W}{c.DIVIDER}]+$')} AND length(regexp_replace(line, '[{c.W}]', '', 'g')) >= 3", *words("signs"))
line_query("list_starters", p.begins_list, HAS("line", p.LIST_STARTER), *words("lists"))
line_query("dialog_lines", lambda s: p.begins_dialog(s) | p.ends_dialog(s), f"{HAS('line', f'^[{c.W}]*[{c.DIALOG_OPEN}]')} OR {HAS('line', f'[{c.DIALOG_CLOSE}][{c.W}]*$')}", marked, MARKED_LINES)
_TITLE = f"NOT {HAS('line', p.LATE_COMMA)} AND length(line) <= 50 AND {HAS('line', f'^({p.TITLES})')}"
line_query("title_headings", p.title, _TITLE, *words("titles"))
_META = f"^[{c.W}]*([^{c.SEPARATOR}]+)[{c.SEPARATOR}][{c.W}]*([^{c.W}])"
_KEYS = ", ".join(f"'{k}'" for k in p.METADATA_KEYS)


@query("metadata_lines", f"""WITH docs AS (SELECT doc_id, '作者：' || left(text, 12) || chr(10) || ' 书名 : ' || left(text, 30) || chr(10) || text AS text FROM documents), {CTE_LINES},
    x AS (SELECT *, regexp_extract(line, '{_META}', 1) AS k, regexp_extract(line, '{_META}', 2) AS v FROM lines)
    SELECT doc_id, line_no, {STRIP('k')} AS key FROM x WHERE length(line) <= 30 AND length(k) BETWEEN 1 AND {p.MAX_KEY} AND {STRIP('k')} IN ({_KEYS}) AND v <> '' AND v NOT IN ('“', '‘', '「', '『', '﹁', '﹃')""")  # fmt: skip
def metadata_lines(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = d.select("doc_id", F.concat(F.lit("作者："), F.left("text", F.lit(12)), F.lit("\n 书名 : "), F.left("text", F.lit(30)), F.lit("\n"), "text").alias("text"))
    key = c.strip(F.regexp_extract("line", _META, 1))
    return lines(d).where(p.metadata(F.col("line"))).select("doc_id", "line_no", key.alias("key"))


# brackets by reducing a string that is a stack; quotes and single kinds by running sums
_OPEN = "".join(c.PAIRS)
_STACK = "list_reduce(list_prepend('', regexp_extract_all(line, '" + c.any_of(c.BRACKETS) + "')), lambda a, x: CASE WHEN a = '!' THEN a WHEN instr('" + _OPEN + "', x) > 0 THEN translate(x, '" + _OPEN + "', '" + "".join(c.PAIRS.values()) + "') || a WHEN left(a, 1) = x THEN substr(a, 2) ELSE '!' END) <> ''"
line_query("unclosed_brackets", p.unclosed_bracket, _STACK, marked, MARKED_LINES)
_QUOTE_KIND = "CASE " + " ".join(f"WHEN c IN ({', '.join(repr(x) for x in a + b)}) THEN {k}" for k, (a, b) in enumerate(p.QUOTE_COUNTERS)) + " END"
_QUOTE_SUMS = f"""{CHARS}, m AS (SELECT doc_id, line_no, i, {_QUOTE_KIND} AS kind, CASE WHEN c IN ({', '.join(repr(a) for a, _ in p.QUOTE_COUNTERS)}) THEN 1 ELSE -1 END AS v FROM chars),
    r AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, line_no, kind ORDER BY i) AS depth FROM m WHERE kind IS NOT NULL),
    bad AS (SELECT DISTINCT doc_id, line_no FROM (SELECT doc_id, line_no, kind FROM r GROUP BY ALL HAVING sum(v) <> 0 OR min(depth) < 0))"""


@query("unclosed_quotes", f"{MARKED_LINES}, {_QUOTE_SUMS} SELECT doc_id, line_no FROM bad")
def unclosed_quotes(spark, sf):
    return lines(marked(spark, sf)).where(p.unclosed_quote(F.col("line"))).select("doc_id", "line_no")


@query("bracket_balance", f"""{MARKED_LINES}, {CHARS}, r AS (SELECT doc_id, line_no, CASE c WHEN '（' THEN 1 ELSE -1 END AS v, sum(CASE c WHEN '（' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS depth FROM chars WHERE c IN ('（', '）'))
    SELECT doc_id, line_no, (sum(v) = 0 AND min(depth) >= 0) AS balanced, count(*) AS n_marks FROM r GROUP BY doc_id, line_no""")  # fmt: skip
def bracket_balance(spark, sf):
    n = F.regexp_count("line", F.lit("[（）]"))
    return lines(marked(spark, sf)).where(n > 0).select("doc_id", "line_no", p.bracket_balanced(F.col("line"), "（").alias("balanced"), n.alias("n_marks"))


_MOSTLY = lambda s: f"len(regexp_extract_all({s}, '[{c.CJK}]')) > 0 AND len(regexp_extract_all({s}, '[{c.CJK}]')) >= len(regexp_extract_all({s}, '[{c.LETTER}]'))"


_WRAPS = [("《", "》"), (" 【", "）"), ("（", "（）　"), ("（", "）　")]


@query("bracket_boundary", f"""{LINES}, x AS (SELECT doc_id, line_no, {STRIP("CASE line_no % 4 " + " ".join(f"WHEN {k} THEN '{a}' || line || '{b}'" for k, (a, b) in enumerate(_WRAPS)) + " END")} AS s FROM lines),
    y AS (SELECT *, {STRIP("substr(s, 2, length(s) - 2)")} AS inside, left(s, 1) AS a, right(s, 1) AS b FROM x)
    SELECT doc_id, line_no, (inside <> '' AND translate(a, '{_OPEN}', '{"".join(c.PAIRS.values())}') = b AND length(s) - length(replace(s, a, '')) = length(s) - length(replace(s, b, '')) AND {_MOSTLY('inside')}) AS holds FROM y""")  # fmt: skip
def bracket_boundary(spark, sf):
    """Whole lines in brackets: of one kind, of two kinds, one opened twice, with white space behind."""
    own = lines(documents(spark, sf))
    k = F.col("line_no") % 4
    wrapped = F.coalesce(*(F.when(k == n, F.concat(F.lit(a), "line", F.lit(b))) for n, (a, b) in enumerate(_WRAPS)))
    return own.select("doc_id", "line_no", p.bracket_boundary(wrapped).alias("holds"))


_CLAUSES = [("。", ".."), ("了", "…"), ("，", "，；"), ("是", "："), ("大", ".")]
_CLAUSE_TEXT = "text"
for _a, _b in _CLAUSES:
    _CLAUSE_TEXT = f"replace({_CLAUSE_TEXT}, '{_a}', '{_b}' || chr(10))"


@query("clause_ends", f"WITH {CTE_DOCS.replace('docs AS', 'whole AS')}, docs AS (SELECT doc_id, {_CLAUSE_TEXT} AS text FROM whole), {CTE_LINES}, x AS (SELECT *, {LAST('line')} AS last FROM lines) SELECT doc_id, line_no, instr('；;：:', last) > 0 AND last <> '' AS colon_like, {HAS('line', rf'(…|[.][.])[{c.W}]*$')} AS ellipsis, instr('{c.CLAUSE_END}', last) > 0 AND last <> '' AS clause, {HAS('line', f'[{c.COMMA}]')} AS comma FROM x")
def clause_ends(spark, sf):
    """Ends of clauses: soft ones, ellipses whatever stands before them, all of them; commas anywhere.  Lines end in dots, ellipses, colons."""
    s, last = F.col("line"), c.last_char(F.col("line"))
    text = F.col("text")
    for a, b in _CLAUSES:
        text = F.replace(text, F.lit(a), F.lit(b + "\n"))
    return lines(documents(spark, sf).withColumn("text", text)).select("doc_id", "line_no", last.isin("；", ";", "：", ":").alias("colon_like"), p.ends_ellipsis(s).alias("ellipsis"), last.isin(*c.CLAUSE_END).alias("clause"), p.has_comma(s).alias("comma"))


@query("text_cleaning", "SELECT doc_id, md5(text) AS cleaned, md5(regexp_replace(replace(replace(text, '.', chr(13) || chr(10)), ',', chr(8232)), '\\r\\n|[\\r\\f\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g')) AS saved FROM documents")
def text_cleaning(spark, sf):
    """No-break spaces and soft hyphens, and the line ends of a saved file."""
    text = F.col("text")
    odd = F.replace(F.replace(text, F.lit(" "), F.lit("\xa0")), F.lit("e"), F.lit("\xade"))
    ends = F.replace(F.replace(text, F.lit("."), F.lit("\r\n")), F.lit(","), F.lit("\u2028"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(t.drop_soft_hyphens(odd)).alias("cleaned"), F.md5(t.save_newlines(ends)).alias("saved"))


@query("object_bands", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor((l_quantity + l_extendedprice / 1000) * 0.5 / 5)::BIGINT AS band FROM lineitem")
def object_bands(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", t.band(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("band"))


@query("custom_titles", words("titles")[1] + " SELECT doc_id, line_no, regexp_matches(line, '^第.*回') AS holds FROM lines")
def custom_titles(spark, sf):
    own = lines(words("titles")[0](spark, sf))
    return own.select("doc_id", "line_no", p.custom_title(F.col("line"), ShortHeading(custom_regex="^第.*回")).alias("holds"))


@query("list_brackets", f"{MARKED_LINES}, numbered AS (SELECT doc_id, line_no, '1)' || line AS line FROM lines) SELECT doc_id, line_no, ({_STACK.replace('(line', '(substr(line, 3)')}) AS unclosed FROM numbered")
def list_brackets(spark, sf):
    """Brackets behind a list number, whose own bracket does not count."""
    return lines(marked(spark, sf)).select("doc_id", "line_no", p.list_unclosed_bracket(F.concat(F.lit("1)"), "line")).alias("unclosed"))


_CLOSE = "”’」』﹂﹄"
_BOUND = lambda n: f"""SELECT doc_id, line_no FROM (SELECT *, {LAST('line')} AS last, regexp_extract(line, '([^{c.W}])[{c.W}]*[^{c.W}][{c.W}]*$', 1) AS prev, ({_MOSTLY('line')} AND (doc_id, line_no) IN (SELECT doc_id, line_no FROM mostly)) AS most FROM lines) WHERE last <> '' AND (
    instr('{c.STRONG_END}', last) > 0
    {"OR most AND " + HAS("line", f"[{c.CJK}][.:][{c.W}]*$") if n >= 3 else ""}
    OR (instr('{_CLOSE}）)', last) > 0 AND prev <> '' AND (instr('{c.STRONG_END}', prev) > 0 OR prev = '.' AND most AND {HAS("line", f"[{c.CJK}][{c.W}]*[.][{c.W}]*[{_CLOSE}）)][{c.W}]*$")}))
    {"OR most AND (last = '：' OR " + HAS("line", f"(…|[.][.][.])[{c.W}]*$") + ")" if n < 3 else ""}
    {"OR instr('；：;:', last) > 0" if n < 2 else ""})"""  # noqa: E731
_MOSTLY_CTE = SQL["mostly_cjk"].split("WITH ", 1)[1]
_MOSTLY_CTE = f"mostly AS (WITH {_MOSTLY_CTE})"
for _level in (1, 2, 3):

    @query(f"sentence_boundary_l{_level}", f"WITH {CTE_DOCS}, {CTE_LINES}, {_MOSTLY_CTE} {_BOUND(_level)}")
    def sentence_boundary(spark, sf, level=_level):
        return lines(documents(spark, sf)).where(p.sentence_boundary(F.col("line"), level)).select("doc_id", "line_no")


# ---- headings and kinds of lines
_PAIR_SQL = f"(instr('{_OPEN}', left(s, 1)) > 0 AND length(s) >= 3 AND translate(left(s, 1), '{_OPEN}', '{''.join(c.PAIRS.values())}') = last)"
_IS = lambda rx, s="s": HAS(s, rx)
_HEADING = f"""CASE WHEN s = '' OR (starts_with(s, '=== ') AND ends_with(s, '===')) THEN false
    WHEN {_STACK.replace('(line', '(s')} OR badq THEN false
    WHEN instr('：:', last) > 0 AND length(s) <= 8 AND {_IS(f'^[{c.CJK}]+[：:]$')} THEN true
    WHEN last IN ('）', ')') AND NOT {_IS(f'[{c.COMMA}]')} THEN true
    WHEN {_PAIR_SQL} AND most THEN true
    WHEN instr('{c.CLAUSE_END}', last) > 0 OR {_IS(f'[{c.COMMA}]')} THEN false
    WHEN length(s) > CASE WHEN {_IS(r'^[\x00-\x7F]+$')} OR {_IS(f'^[{c.NEUTRAL}]*([{_A}][{_A}{c.NEUTRAL}]*[{c.CJK}]|[{c.CJK}][{c.CJK}{c.NEUTRAL}]*[{_A}])')} THEN 16 ELSE 8 END THEN false
    WHEN {_IS(f'[{c.STRONG_END}]')} THEN false
    ELSE {_IS(r'^[\x00-\x7F]+$')} OR {_IS(f'^[{c.CJK}]+$')} OR {_IS(rf'^[ {c.DIGIT}]*[{c.DIGIT}][ {c.DIGIT}]*$')} OR {_IS(f'^[{c.NEUTRAL}]*([{_A}][{_A}{c.NEUTRAL}]*[{c.CJK}]|[{c.CJK}][{c.CJK}{c.NEUTRAL}]*[{_A}])')} END"""
_SPLIT_DOCS = f"docs AS (SELECT doc_id, regexp_replace(text, '([。，])', chr(92) || '1' || chr(10), 'g') AS text FROM ({LINES} SELECT doc_id, text FROM docs))"
_KINDS = f"""WITH {_SPLIT_DOCS}, {CTE_LINES}, {_QUOTE_SUMS}, {_MOSTLY_CTE.replace(CTE_DOCS + ', ' + CTE_LINES + ', ', '').replace(CHARS + ',', '')},
    x AS (SELECT l.doc_id, l.line_no, l.line, {STRIP('l.line')} AS s, {LAST('l.line')} AS last, b.doc_id IS NOT NULL AS badq, m.doc_id IS NOT NULL AS most FROM lines l LEFT JOIN bad b USING (doc_id, line_no) LEFT JOIN mostly m USING (doc_id, line_no)),
    h AS (SELECT *, {_HEADING} AS heading FROM x)"""


def split_lines(spark, sf):
    return lines(documents(spark, sf).withColumn("text", F.regexp_replace("text", "([。，])", "$1\n")))


@query("short_headings", f"{_KINDS} SELECT doc_id, line_no, line FROM h WHERE heading")
def short_headings(spark, sf):
    return split_lines(spark, sf).where(p.short_heading(F.col("line")))


@query("line_kind_counts", f"""{_KINDS} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, CASE WHEN {HAS('line', f'^[{c.W}{c.DIVIDER}]+$')} AND length(regexp_replace(line, '[{c.W}]', '', 'g')) >= 3 THEN 'divider' WHEN s = '' THEN 'empty' WHEN starts_with(line, '=== ') AND ends_with(line, '===') THEN 'marker'
    WHEN {_TITLE} THEN 'title' WHEN heading THEN 'heading' WHEN {HAS('line', f'^[{c.W}]*[{c.DIALOG_OPEN}]')} THEN 'dialog' WHEN {HAS('line', p.LIST_STARTER)} THEN 'list' ELSE 'text' END AS kind FROM h) GROUP BY kind""")  # fmt: skip
def line_kind_counts(spark, sf):
    s = F.col("line")
    kind = F.when(p.divider(s), "divider").when(c.strip(s) == "", "empty").when(p.page_marker(s), "marker").when(p.title(s), "title").when(p.short_heading(s), "heading").when(p.begins_dialog(s), "dialog").when(p.begins_list(s), "list").otherwise("text")
    return split_lines(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


# ---------------------------------------------------------------- texts
@query("line_split", f"{LINES} SELECT doc_id, line_no, line FROM lines")
def line_split(spark, sf):
    return lines(documents(spark, sf))


@query("newline_normalize", "SELECT doc_id, md5(replace(replace(replace(replace(text, ' ', chr(13) || chr(10)), '.', chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def newline_normalize(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.md5(t.normalize_newlines(F.replace(F.replace("text", F.lit(" "), F.lit("\r\n")), F.lit("."), F.lit("\r")))).alias("digest"))


@query("trim_functions", f"""{LINES} SELECT doc_id, line_no, regexp_replace(line, '^ +', '') AS no_indent, regexp_replace(line, '[{c.W}]+$', '') AS right_trimmed, regexp_replace(line, '^[ \\x{{3000}}]+', '') AS probe,
    regexp_replace(regexp_replace(line, '[{c.W}]+', ' ', 'g'), '^ | $', '', 'g') AS spaced, {HAS("'　　' || line", f"^[{c.W}]{{2,}}")} AS indented FROM lines""")  # fmt: skip
def trim_functions(spark, sf):
    s = F.col("line")
    return lines(documents(spark, sf)).select("doc_id", "line_no", t.strip_half_width_indent(s).alias("no_indent"), t.right_trim(s).alias("right_trimmed"), t.probe(s).alias("probe"), t.normalize_white_space(s).alias("spaced"), p.indented(F.concat(F.lit("　　"), s)).alias("indented"))


@query("blank_lines", "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '.', chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '[' || chr(10) || chr(13) || ']+$', '')) AS digest FROM documents")
def blank_lines(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.md5(t.trim_trailing_newlines(t.cap_blank_lines(F.replace("text", F.lit("."), F.lit("\n"))))).alias("digest"))


_TOKEN_CASE = "CASE " + " ".join(f"WHEN length(w) % {k} = 0 AND length(w) >= {3 * k} AND repeat(left(w, {k}), (length(w) // {k})) = w THEN left(w, {k})" for k in range(4, 11)) + " ELSE w END"


@query("collapse_token", f"""WITH x AS (SELECT doc_id, unnest(list_filter(list_distinct(regexp_split_to_array(text, '[ \\n]+')), lambda w: w <> '')) AS w0 FROM documents), y AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat(left(w0, 6), 4) ELSE w0 END AS w FROM x)
    SELECT doc_id, w AS token, CASE WHEN length(w) BETWEEN 4 AND 100 THEN {_TOKEN_CASE} ELSE w END AS collapsed FROM y""")  # fmt: skip
def collapse_token(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    w = d.select("doc_id", F.explode(F.array_distinct(F.filter(F.split("text", "[ \n]+"), lambda x: x != ""))).alias("w"))
    token = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.left("w", F.lit(6)), F.lit(4))).otherwise(F.col("w"))
    return w.select("doc_id", token.alias("token"), t.collapse_token(token).alias("collapsed"))


#: The first place and the shortest length of a phrase that stands three times, by comparing slices; then the first copy that differs.
_PHRASES = f"""WITH docs AS (SELECT doc_id, text FROM documents), {CTE_LINES},
    w AS (SELECT doc_id, line_no, line, array_to_string(list_slice(string_split(line, ' '), 1, 3), ' ') AS w FROM lines),
    l AS (SELECT doc_id, line_no, concat_ws(' ', w, w, w, line) AS l FROM w),
    t AS (SELECT *, list_filter(regexp_split_to_array(l, '[ \\t]+'), lambda w: w <> '') AS tok FROM l),
    c AS (SELECT doc_id, line_no, s, p FROM (SELECT doc_id, line_no, tok, unnest(range(1, len(tok) + 1)) AS s FROM t) AS x, (SELECT unnest(range(1, 9)) AS p) AS y WHERE s + 3 * p - 1 <= len(tok) AND tok[s:s + p - 1] = tok[s + p:s + 2 * p - 1] AND tok[s:s + p - 1] = tok[s + 2 * p:s + 3 * p - 1]),
    h AS (SELECT doc_id, line_no, min({{'s': s, 'p': p}}) AS h FROM c GROUP BY ALL),
    k AS (SELECT doc_id, line_no, h.s AS s, h.p AS p, tok, coalesce(nullif(list_position(list_transform(range(1, (len(tok) - s + 1) // p), lambda i: tok[s + i * p:s + (i + 1) * p - 1] = tok[s:s + p - 1]), false), 0), (len(tok) - s + 1) // p) AS copies FROM h JOIN t USING (doc_id, line_no)),
    o AS (SELECT t.doc_id, t.line_no, l, t.tok, CASE WHEN k.s IS NULL THEN t.tok ELSE list_concat(t.tok[1:k.s + k.p - 1], t.tok[k.s + k.copies * k.p:]) END AS kept FROM t LEFT JOIN k USING (doc_id, line_no))"""


@query("collapse_phrase", f"{_PHRASES} SELECT doc_id, line_no, CASE WHEN len(tok) = 0 THEN l ELSE array_to_string(list_transform(kept, lambda w: CASE WHEN length(w) BETWEEN 4 AND 100 THEN {_TOKEN_CASE} ELSE w END), ' ') END AS collapsed FROM o")
def collapse_phrase(spark, sf):
    """Every line behind three copies of its first words."""
    d = lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    words = F.concat_ws(" ", F.slice(F.split("line", " "), 1, 3))
    return d.select("doc_id", "line_no", t.collapse_line(F.concat_ws(" ", words, words, words, "line")).alias("collapsed"))


@query("middle_ellipsis", "SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE left(url, 13) || '...' || right(url, 14) END AS short, CASE WHEN length(url) <= 50 THEN url ELSE left(url, 25) || '...' || right(url, 15) END AS name FROM pages")
def middle_ellipsis(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    return d.select("page_id", t.middle_ellipsis(F.col("url"), 30).alias("short"), t.middle_ellipsis(F.col("url"), 50, 25, 15).alias("name"))


@query("progress_bar", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, '[' || repeat('🟩', (least(greatest((l_quantity * 2)::BIGINT, 0), 100) * 10 // 100)::BIGINT) || repeat('🟨', (10 - least(greatest((l_quantity * 2)::BIGINT, 0), 100) * 10 // 100)::BIGINT) || ']' AS bar, CASE WHEN l_partkey <= 20 THEN 1 WHEN l_partkey <= 100 THEN 3 WHEN l_partkey <= 300 THEN 5 ELSE greatest(1, l_partkey // 20) END::BIGINT AS block FROM lineitem")
def progress_bar(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet")
    return d.select("l_orderkey", "l_linenumber", t.progress_bar((F.col("l_quantity") * 2).cast("long")).alias("bar"), t.progress_block(F.col("l_partkey")).alias("block"))


_ROMAN_SQL = " || ".join(f"({x})[(n // {u}) % 10 + 1]" for x, u in zip(t.ROMAN, (100, 10, 1), strict=True))


@query("roman_letters_counters", f"""WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey % 800 + 1)::BIGINT AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN n < 10 THEN '0' || n::VARCHAR ELSE n::VARCHAR END AS zero, {_ROMAN_SQL} AS roman,
    CASE WHEN n > 702 THEN chr(97 + ((n - 703) // 676)::INT) ELSE '' END || CASE WHEN n > 26 THEN chr(97 + (((n - 27) // 26) % 26)::INT) ELSE '' END || chr(97 + ((n - 1) % 26)::INT) AS letters FROM x""")  # fmt: skip
def roman_letters_counters(spark, sf):
    n = (F.col("l_partkey") % 800 + 1).cast("int")
    d = spark.read.parquet(f"{sf}/lineitem.parquet")
    return d.select("l_orderkey", "l_linenumber", *(t.counter(n, F.lit(k)).alias(a) for k, a in (("decimalZero", "zero"), ("upperRoman", "roman"), ("lowerLetter", "letters"))))


@query("selection_splice", "SELECT doc_id, CASE WHEN 5 + 10 <= length(text) THEN left(text, 5) || replace(substr(text, 6, 10), 'e', 'E') || substr(text, 16) ELSE replace(text, 'e', 'E') END AS spliced FROM documents")
def selection_splice(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.col("text")
    large = lambda x: F.replace(x, F.lit("e"), F.lit("E"))
    part = F.when(F.length(text) >= 15, large(F.substr(text, F.lit(6), F.lit(10)))).otherwise(large(text))
    return d.select("doc_id", t.splice(text, F.lit(5), F.lit(10), part).alias("spliced"))


# ---------------------------------------------------------------- quotes
_QDOCS = f"docs AS (SELECT doc_id, translate(text, '{QUOTED[0]}', '{QUOTED[1]}') AS text FROM documents)"
_QLINES = f"WITH {_QDOCS}, {CTE_LINES}"
_SUSPICIOUS = f"""length({STRIP('line')}) >= 2 AND (instr('{c.QUOTE_CLOSE}', left({STRIP('line')}, 1)) > 0 AND instr('{c.QUOTE_OPEN}', right({STRIP('line')}, 1)) > 0
    OR instr('{c.QUOTE_OPEN}', left({STRIP('line')}, 1)) > 0 AND instr('{c.QUOTE_CLOSE}', right({STRIP('line')}, 1)) > 0 AND translate(left({STRIP('line')}, 1), '{c.QUOTE_OPEN}', '{c.QUOTE_CLOSE}') <> right({STRIP('line')}, 1))"""
_ENDS = f"docs AS (SELECT doc_id, regexp_replace(translate(lower(text), 'aeions', '“”「」‘’'), ' ([“”「」‘’])', chr(10) || chr(92) || '1', 'g') AS text FROM documents)"
_ISSUES = f"WITH {_ENDS}, {CTE_LINES}, issues AS (SELECT doc_id, line_no + 1 AS line_number, line AS text FROM lines WHERE {_SUSPICIOUS})"


def ended(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.regexp_replace(F.translate(F.lower("text"), "aeions", "“”「」‘’"), " ([“”「」‘’])", "\n$1").alias("text"))


@query("normalize_quotes", f"""WITH {_QDOCS}, x AS (SELECT doc_id, unnest(generate_series(1, length(text))) AS i, unnest(string_split(text, '')) AS c FROM docs WHERE text <> ''),
    n AS (SELECT *, regexp_matches(coalesce(lag(c) OVER w, ''), '[A-Za-z]') AND regexp_matches(coalesce(lead(c) OVER w, ''), '[A-Za-z]') AND c IN ('''', '‘', '’') AS apostrophe FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    k AS (SELECT *, CASE WHEN apostrophe THEN NULL WHEN c IN ('“', '”', '「', '」', '"') THEN 'd' WHEN c IN ('‘', '’', '『', '』', '''') THEN 's' END AS family, c IN ('"', '''') AS ascii FROM n),
    m AS (SELECT *, max(CASE WHEN NOT ascii AND family IS NOT NULL THEN i END) OVER (PARTITION BY doc_id, family ORDER BY i) AS mk FROM k),
    r AS (SELECT *, first_value(c) OVER (PARTITION BY doc_id, family, mk ORDER BY i) AS since, sum(CASE WHEN ascii THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, family, mk ORDER BY i) AS nth FROM m),
    o AS (SELECT doc_id, i, CASE WHEN family IS NULL OR NOT ascii THEN c WHEN mk IS NOT NULL AND instr('“「‘『', since) > 0 THEN CASE WHEN nth = 1 THEN translate(since, '“「‘『', '”」’』') WHEN family = 'd' THEN CASE WHEN nth % 2 = 0 THEN '“' ELSE '”' END ELSE CASE WHEN nth % 2 = 0 THEN '‘' ELSE '’' END END
      WHEN family = 'd' THEN CASE WHEN nth % 2 = 1 THEN '“' ELSE '”' END ELSE CASE WHEN nth % 2 = 1 THEN '‘' ELSE '’' END END AS c FROM r)
    SELECT doc_id, string_agg(c, '' ORDER BY i) AS text FROM o GROUP BY doc_id""")  # fmt: skip
def normalize_quotes(spark, sf):
    return quoted(spark, sf).select("doc_id", quotes.normalize_quotes(F.col("text")).alias("text"))


@query("validate_quotes", f"{_ISSUES} SELECT doc_id, line_number, text FROM issues")
def validate_quotes(spark, sf):
    return quotes.issues(ended(spark, sf))


@query("quote_issue_counts", f"{_ISSUES} SELECT d.doc_id, count(i.line_number) AS n_issues, count(i.line_number) = 0 AS valid, min(i.line_number) AS first_line FROM docs d LEFT JOIN issues i USING (doc_id) GROUP BY d.doc_id")
def quote_issue_counts(spark, sf):
    found = ended(spark, sf).withColumn("i", quotes.issue_array(F.col("text")))
    return found.select("doc_id", F.size("i").alias("n_issues"), (F.size("i") == 0).alias("valid"), F.try_element_at("i", F.lit(1))["line_number"].alias("first_line"))


@query("quote_summary_top5", f"""{_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM issues),
    s AS (SELECT doc_id, 'Found ' || any_value(n) || ' suspicious dialog quote line(s).' || chr(10) || chr(10) || '{quotes.HINT}' || string_agg(line_number || ': ' || text || chr(10), '' ORDER BY k) FILTER (WHERE k <= 5) || CASE WHEN any_value(n) > 5 THEN '...and ' || (any_value(n) - 5) || ' more.' || chr(10) ELSE '' END AS summary FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(summary, '{quotes.NO_ISSUES}') AS summary FROM docs d LEFT JOIN s USING (doc_id)""")  # fmt: skip
def quote_summary_top5(spark, sf):
    return ended(spark, sf).select("doc_id", quotes.summary(quotes.issue_array(F.col("text"))).alias("summary"))


# ---------------------------------------------------------------- pages and containers
_OBJECTS = f"""objects AS (SELECT doc_id, (1 + pos // 40)::BIGINT AS page_no, pos AS obj_no, CASE WHEN pos % 3 = 0 THEN 'BACKUP COPY' ELSE w END AS raw, ((pos * 7) % 60) * 1.0 AS bottom FROM
    (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(generate_series(1, len(string_split(text, ' '))))::BIGINT - 1 AS pos FROM documents)),
    banded AS (SELECT doc_id, page_no, obj_no, raw, regexp_replace(regexp_replace(raw, '[{c.W}]+', ' ', 'g'), '^ | $', '', 'g') AS norm, floor((bottom + bottom + 3) * 0.5 / 5)::BIGINT AS y_bucket FROM objects),
    counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, norm, y_bucket) AS repeats, list_filter(string_split(norm, ' '), lambda x: x <> '') AS tok FROM banded WHERE norm <> ''),
    kept AS (SELECT doc_id, page_no, obj_no, raw, norm, y_bucket FROM counted WHERE regexp_matches(norm, '^[\\pP\\pS{c.W}]*$') OR NOT (repeats > 4 AND length(norm) BETWEEN 3 AND 200 OR len(tok) >= 6 AND NOT regexp_matches(tok[1], '^[\\pP\\pS{c.W}]*$') AND len(list_filter(tok, lambda x: x = tok[1])) >= len(tok) - 1 AND length(tok[1]) <= 32))"""
_PAGES = "parts AS (SELECT doc_id, page_no, obj_no, CASE WHEN abs(y_bucket - lag(y_bucket) OVER (PARTITION BY doc_id, page_no ORDER BY obj_no)) >= 3 THEN chr(10) ELSE '' END || raw AS part FROM kept), texts AS (SELECT doc_id, page_no, string_agg(part, '' ORDER BY obj_no) AS text FROM parts GROUP BY ALL)"


def objects(spark, sf):
    """Text objects, dealt by page: a page's words travel as one text, and become objects where they arrive."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", F.split("text", " ", -1).alias("words"))
    pages = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(40)), lambda k: F.array_join(F.slice("words", k + 1, 40), " "))
    d = d.select("doc_id", F.posexplode(pages).alias("page", "words")).select("doc_id", (F.col("page") + 1).cast("long").alias("page_no"), "words")
    # objects are ten times their pages' size: a number of partitions that follows the input, which Spark would coalesce by size
    d = overlay.by_page(d, 24 * d.rdd.getNumPartitions()).select("doc_id", "page_no", F.posexplode(F.split("words", " ", -1)).alias("at", "w"))
    d = d.select("doc_id", "page_no", ((F.col("page_no") - 1) * 40 + F.col("at")).cast("int").alias("pos"), "w")
    raw = F.when(F.col("pos") % 3 == 0, "BACKUP COPY").otherwise(F.col("w"))
    bottom = ((F.col("pos") * 7) % 60).cast("double")
    return d.select("doc_id", "page_no", F.col("pos").alias("obj_no"), raw.alias("raw"), t.normalize_white_space(raw).alias("norm"), t.band(bottom, bottom + 3).alias("y_bucket"))


@query("overlay_filter", f"WITH {_OBJECTS} SELECT * FROM kept")
def overlay_filter(spark, sf):
    return overlay.kept_objects(objects(spark, sf), dealt=True)


@query("page_texts", f"WITH {_OBJECTS}, {_PAGES} SELECT * FROM texts")
def page_texts(spark, sf):
    return overlay.page_texts(overlay.kept_objects(objects(spark, sf), dealt=True))


@query("page_assemble", f"""WITH {_OBJECTS}, {_PAGES}, n AS (SELECT doc_id, max(page_no)::BIGINT AS page_count FROM texts GROUP BY doc_id)
    SELECT doc_id, page_count, string_agg('=== [Page ' || page_no || '/' || page_count || '] ===' || chr(10) || {STRIP('text')} || chr(10), '' ORDER BY page_no) AS text FROM texts JOIN n USING (doc_id) GROUP BY doc_id, page_count""")  # fmt: skip
def page_assemble(spark, sf):
    return overlay.documents_of_pages(page_texts(spark, sf))


_MANIFEST = """manifest AS (SELECT conv_id, 'i' || (turn % 7) AS id, turn, CASE turn % 3 WHEN 0 THEN '../text/./c' ELSE 'part' || chr(92) || 'p' END || turn || CASE WHEN turn % 4 = 3 THEN '.png' ELSE '.xhtml' END AS href FROM conversations),
    last AS (SELECT conv_id, id, arg_max(href, turn) AS href FROM manifest GROUP BY ALL), spine AS (SELECT conv_id, turn AS pos, 'i' || (turn % 9) AS idref FROM conversations)"""


@query("spine_manifest_join", f"""WITH {_MANIFEST}, j AS (SELECT s.conv_id, s.pos, m.href FROM spine s JOIN last m ON s.conv_id = m.conv_id AND s.idref = m.id WHERE m.href LIKE '%.xhtml')
    SELECT conv_id, pos::BIGINT AS pos, CASE WHEN starts_with(href, '..') THEN 'text/' || substr(href, 11) ELSE 'OEBPS/' || replace(href, chr(92), '/') END AS path FROM j""")  # fmt: skip
def spine_manifest_join(spark, sf):
    """Spine to manifest (of equal ids the last), HTML parts only, paths resolved inside the container."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    turn = F.col("turn")
    href = F.concat(F.when(turn % 3 == 0, "../text/./c").otherwise("part\\p"), turn.cast("string"), F.when(turn % 4 == 3, ".png").otherwise(".xhtml"))
    manifest = conv.select("conv_id", F.concat(F.lit("i"), (turn % 7).cast("string")).alias("id"), turn, href.alias("href"))
    last = manifest.groupBy("conv_id", "id").agg(F.max_by("href", "turn").alias("href"))
    spine = conv.select("conv_id", turn.alias("pos"), F.concat(F.lit("i"), (turn % 9).cast("string")).alias("id"))
    found = spine.join(last, ["conv_id", "id"]).where(F.col("href").rlike(r"(?i)\.(xhtml|html|htm)$"))
    return found.select("conv_id", "pos", t.combine_path(F.lit("OEBPS/"), F.col("href")).alias("path"))


# ---------------------------------------------------------------- batches
_FILES = "files AS (SELECT page_id AS ins, regexp_extract(url, '[^/?#]*[/]?$', 0) || host || ext AS path FROM (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS host, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.docx' WHEN 3 THEN '.exe' ELSE '.PDF' END AS ext FROM pages) UNION ALL SELECT page_id + 1000000000, CASE WHEN page_id % 2 = 0 THEN 'a_' || page_id % 50 || '.txt' ELSE 'A_' || page_id % 50 || '.txt' END FROM pages)"


def files(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    k = F.col("page_id") % 5
    ext = F.when(k == 0, ".pdf").when(k == 1, ".TXT").when(k == 2, ".docx").when(k == 3, ".exe").otherwise(".PDF")
    path = F.concat(F.regexp_extract("url", "[^/?#]*[/]?$", 0), F.regexp_extract("url", "://([^/]*)", 1), ext)
    again = F.concat(F.when(F.col("page_id") % 2 == 0, "a_").otherwise("A_"), (F.col("page_id") % 50).cast("string"), F.lit(".txt"))
    return d.select(F.col("page_id").alias("ins"), path.alias("path")).union(d.select(F.col("page_id") + 1000000000, again))


_PDF = "lower(regexp_extract(path, '([.][^./]*)$', 1)) = '.pdf'"


@query("batch_order_add", f"WITH {_FILES}, once AS (SELECT path, min(ins) AS ins FROM files GROUP BY path) SELECT path, row_number() OVER (ORDER BY {_PDF}, CASE WHEN NOT {_PDF} THEN upper(path) END NULLS FIRST, ins) AS position FROM once")
def batch_order_add(spark, sf):
    return batch.add_order(files(spark, sf))


@query("batch_order_drop", f"WITH {_FILES}, one AS (SELECT upper(path) AS up, arg_min(path, ins) AS path FROM files GROUP BY 1) SELECT path, row_number() OVER (ORDER BY {_PDF}, up) AS position FROM one")
def batch_order_drop(spark, sf):
    return batch.drop_order(files(spark, sf))


@query("format_dispatch", f"""WITH {_FILES}, e AS (SELECT ins, path, lower(regexp_extract(path, '([.][^./]*)$', 1)) AS e FROM files)
    SELECT ins, path, CASE WHEN e IN ({', '.join(map(repr, batch.OFFICE))}) THEN 'office' WHEN e = '.pdf' THEN 'pdf' WHEN e IN ({', '.join(map(repr, batch.TEXT))}) THEN 'text' ELSE 'skipped' END AS kind FROM e""")  # fmt: skip
def format_dispatch(spark, sf):
    return files(spark, sf).select("ins", "path", batch.kind(F.col("path")).alias("kind"))


@query("output_names", f"""WITH {_FILES} SELECT ins, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', '') || CASE ins % 3 WHEN 0 THEN '_Hans' WHEN 1 THEN '_Hant' ELSE '_t2hk' END || CASE WHEN {_PDF} THEN '.txt' ELSE lower(regexp_extract(path, '([.][^./]*)$', 1)) END AS name FROM files""")
def output_names(spark, sf):
    k = F.col("ins") % 3
    direction = F.when(k == 0, "t2s").when(k == 1, "s2t").otherwise("custom")
    return files(spark, sf).select("ins", batch.output_name(F.col("path"), direction, F.lit("t2hk")).alias("name"))


@query("batch_log", f"WITH {_FILES}, e AS (SELECT ins, path, lower(regexp_extract(path, '([.][^./]*)$', 1)) AS e FROM files) SELECT e AS extension, CASE WHEN e IN ({', '.join(map(repr, batch.OFFICE + batch.TEXT + ['.pdf']))}) THEN 'converted' ELSE 'skipped' END AS status, count(*) AS n, min(ins) AS first_ins FROM e GROUP BY ALL")
def batch_log(spark, sf):
    path = F.col("path")
    status = F.when(batch.kind(path) == "skipped", "skipped").otherwise("converted")
    return files(spark, sf).groupBy(t.extension(path).alias("extension"), status.alias("status")).agg(F.count("*").alias("n"), F.min("ins").alias("first_ins"))


@query("latest_request", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_request(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type")
    return dic.latest_requests(e, "user_id", "event_id")


# ---------------------------------------------------------------- dictionaries
def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(table.items())) + "}"


def _convert_sql(text: str, config: str, punctuation: bool) -> str:
    for slots in dic.rounds(config, punctuation):
        if table := dic.round_table(slots, dic.SAMPLE):
            text = f"array_to_string(list_transform(regexp_extract_all({text}, '{dic.pattern(table)}'), lambda w: coalesce({_map_sql(table)}[w], w)), '')"
    return text


@query("fmm_convert", f"WITH {CTE_DOCS} SELECT doc_id, {_convert_sql('text', 's2twp', True)} AS text FROM docs")
def fmm_convert(spark, sf):
    return documents(spark, sf).select("doc_id", dic.convert(F.col("text"), "s2twp", punctuation=True).alias("text"))


@query("dictionary_convert", """WITH d AS (SELECT DISTINCT regexp_extract(text, '[a-z]{2,}', 0) AS key FROM benchmark), e AS (SELECT key, upper(key) || '!' AS value FROM d WHERE key <> ''),
    p AS (SELECT '(?s)' || string_agg(key, '|' ORDER BY length(key) DESC, key) || '|.' AS p, map_from_entries(list((key, value))) AS m FROM e)
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, p), lambda w: coalesce(m[w], w)), '') AS text FROM documents, p""")  # fmt: skip
def dictionary_convert(spark, sf):
    """Documents through a dictionary that is a table: words of the benchmark."""
    key = F.regexp_extract("text", "[a-z]{2,}", 0)
    dictionary = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lit("STPhrases").alias("slot"), key.alias("key"), F.concat(F.upper(key), F.lit("!")).alias("value"))
    return matching.convert_texts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), dictionary, "s2t")


_CONFIG = "CASE o_orderkey % 4 WHEN 0 THEN ' ' || upper({c}) WHEN 1 THEN {c} || ' (label)' WHEN 2 THEN 'x' || {c} ELSE {c} END"


@query("config_rounds", f"""WITH k AS (SELECT o_orderkey, {_CONFIG.format(c="list_extract([" + ", ".join(map(repr, dic.CONFIGS)) + "], (o_orderkey % 20 + 1)::INT)")} AS label FROM orders), n AS (SELECT o_orderkey, split_part(lower(trim(label)), ' ', 1) AS c FROM k),
    p AS (SELECT o_orderkey, CASE WHEN c IN ({", ".join(map(repr, dic.CONFIGS))}) THEN c ELSE 's2t' END AS config FROM n), f AS (SELECT *, split_part(config, '2', 1) AS a, split_part(config, '2', 2) AS b FROM p)
    SELECT o_orderkey, config, (CASE WHEN a IN ('tw', 'hk') THEN 1 + (ends_with(config, 'p') AND b <> 'jp')::INT ELSE 0 END + (a = 's')::INT + (a = 'jp')::INT + (rtrim(b, 'p') = 's')::INT + CASE WHEN b IN ('tw', 'hk') THEN 1 WHEN b IN ('twp', 'hkp') THEN 2 ELSE 0 END + (b = 'jp')::INT)::BIGINT AS n_rounds FROM f""")  # fmt: skip
def config_rounds(spark, sf):
    """Labels of configurations, some in capitals, some with a remark, some unknown, and how many rounds each has."""
    o, key = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, dic.CONFIGS)), (key % 20 + 1).cast("int"))
    k = key % 4
    label = F.when(k == 0, F.concat(F.lit(" "), F.upper(name))).when(k == 1, F.concat(name, F.lit(" (label)"))).when(k == 2, F.concat(F.lit("x"), name)).otherwise(name)
    config = dic.config_of(label)
    return o.select("o_orderkey", config.alias("config"), F.element_at(F.create_map(*(F.lit(x) for c_, r in dic.ROUNDS.items() for x in (c_, len(r)))), config).alias("n_rounds"))


_SPECS = [(0, "STPhrases", "Append", "p0"), (1, "STPhrases", "Override", "p1"), (2, "STCharacters", "Append", "p2"), (3, "STPhrases", "Append", "p3")]


@query("dict_overlay", """WITH base AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'STPhrases' ELSE 'STCharacters' END AS slot, p_name || p_partkey AS key, p_brand AS value FROM part),
    custom AS (SELECT 'p' || (p_partkey % 4) AS path, p_name || (p_partkey + p_size % 3) AS key, p_type AS value FROM part), specs(ord, slot, mode, path) AS (VALUES """ + ", ".join(map(str, _SPECS)) + """),
    all_rows AS (SELECT -1 AS ord, * FROM base UNION ALL SELECT ord, slot, key, value FROM custom JOIN specs USING (path)), reset AS (SELECT slot, max(ord) AS since FROM specs WHERE mode = 'Override' GROUP BY slot)
    SELECT slot, key, arg_max(value, {'o': ord, 'v': value}) AS value FROM all_rows LEFT JOIN reset USING (slot) WHERE since IS NULL OR ord >= since GROUP BY slot, key""")  # fmt: skip
def dict_overlay(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    base = part.select(F.when(F.col("p_size") % 2 == 0, "STPhrases").otherwise("STCharacters").alias("slot"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("value"))
    custom = part.select(F.concat(F.lit("p"), (F.col("p_partkey") % 4).cast("string")).alias("path"), F.concat("p_name", (F.col("p_partkey") + F.col("p_size") % 3).cast("string")).alias("key"), F.col("p_type").alias("value"))
    return dic.overlay(base, custom, spark.createDataFrame(_SPECS, "ord int, slot string, mode string, path string"))


_PAIRS = {k: v for k, v in dic.SAMPLE["STCharacters"].items() if k != v}
_S, _T = "".join(sorted(_PAIRS)), "".join(sorted(set(_PAIRS.values()) - set(_PAIRS)))


@query("lang_check", f"WITH {CTE_DOCS}, x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN translate(text, '{_S}', '{''.join(_PAIRS[k] for k in _S)}') ELSE regexp_replace(text, '[{_S}]', '', 'g') END AS text FROM docs), n AS (SELECT doc_id, len(regexp_extract_all(text, '[{_S}]')) AS s, len(regexp_extract_all(text, '[{_T}]')) AS t FROM x) SELECT doc_id, CASE WHEN s = 0 AND t = 0 THEN 0 WHEN t > s THEN 1 ELSE 2 END::BIGINT AS script FROM n")
def lang_check(spark, sf):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.col("text")).when(k == 1, F.translate("text", _S, "".join(_PAIRS[x] for x in _S))).otherwise(F.regexp_replace("text", f"[{_S}]", ""))
    return documents(spark, sf).select("doc_id", dic.script_of(text).alias("script"))


_RARE = {"𠀀": "甲", "𪜀": "乙", "𰀀": "丙"}


@query("detofu", f"WITH {CTE_DOCS} SELECT doc_id, translate(text, '的一是', '甲𪜀丙') AS b, translate(text, '的一是', '𠀀乙丙') AS c FROM docs".replace("'甲𪜀丙'", "'甲乙丙'"))
def detofu(spark, sf):
    rare = F.translate("text", "的一是", "".join(_RARE))
    return documents(spark, sf).select("doc_id", dic.detofu(rare, _RARE, "ExtB").alias("b"), dic.detofu(rare, _RARE, "ExtC").alias("c"))


#: A dash, an astral ideograph, a radical that Unicode maps and one that it doesn't.
_ODD = "".join([list(dic.COMPAT)[0], list(dic.COMPAT)[-1], list(dic.COMPAT_EXTENDED)[-1], list(dic.COMPAT_EXTENDED)[0]])


@query("compat_normalize", f"WITH {CTE_DOCS}, x AS (SELECT doc_id, translate(text, '的一是了', '{_ODD}') AS text FROM docs) SELECT doc_id, translate(text, '⸺\U0002FA1D', '—\U0002A600') AS plain, translate(text, '⸺\U0002FA1D⿕⻚', '—\U0002A600龠页') AS extended FROM x")
def compat_normalize(spark, sf):
    odd = F.translate("text", "的一是了", _ODD)
    return documents(spark, sf).select("doc_id", dic.normalize_compat(odd).alias("plain"), dic.normalize_compat(odd, True).alias("extended"))


# ---------------------------------------------------------------- reflow
@query("reflow_novel")
def reflow_novel(spark, sf):
    return reflow.reflow(documents(spark, sf)).select("doc_id", "reflowed", F.size("segments").alias("n_segments"))


@query("reflow_compact")
def reflow_compact(spark, sf):
    options = PdfOptions(compact=True, short_heading=ShortHeading(max_len=12))
    return reflow.reflow(documents(spark, sf), options, level=1).select("doc_id", "reflowed", F.size("segments").alias("n_segments"))


@query("reflow_paragraphs")
def reflow_paragraphs(spark, sf):
    return reflow.paragraphs(reflow.reflow(documents(spark, sf)))


@query("reflow_latin", f"WITH heads AS (SELECT doc_id, text, left(regexp_replace(text, '[{c.W}]', '', 'g'), 200) AS head FROM documents) SELECT doc_id, md5(text) AS digest FROM heads WHERE {_LATIN_SQL}")
def reflow_latin(spark, sf):
    """Latin texts leave reflow as they came."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return reflow.reflow(d).where(p.latin_leading(F.col("text"))).select("doc_id", F.md5("reflowed").alias("digest"))


# ---------------------------------------------------------------- lists, parts, slots and settings
_PARAGRAPHS = """paragraphs AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS num_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 4 END AS ilvl, 's' || (o_orderkey % 2) AS style_id FROM orders),
    styles AS (SELECT c_custkey AS doc_id, 's1' AS style_id, 1 AS num_id, c_nationkey % 3 AS ilvl FROM customer),
    r AS (SELECT p.doc_id, p.pos, coalesce(p.num_id, s.num_id) AS num, least(greatest(CASE WHEN p.num_id IS NOT NULL THEN coalesce(p.ilvl, 0) ELSE s.ilvl END, 0), 8) AS level FROM paragraphs p LEFT JOIN styles s USING (doc_id, style_id))"""


def paragraphs(spark, sf):
    o, key = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    p_ = o.select(F.col("o_custkey").alias("doc_id"), key.alias("pos"), F.when(key % 3 != 0, key % 2).alias("num_id"), F.when(key % 5 != 0, key % 4).alias("ilvl"), F.concat(F.lit("s"), (key % 2).cast("string")).alias("style_id"))
    styles = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit("s1").alias("style_id"), F.lit(1).alias("num_id"), (F.col("c_nationkey") % 3).alias("ilvl"))
    return numbering.resolved(p_, styles)


_G = [f"sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, num ORDER BY pos) AS g{k}" for k in range(4)]
_N = [f"(sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, num, g{k} ORDER BY pos))::BIGINT AS n{k}" for k in range(4)]


@query("list_counters", f"WITH {_PARAGRAPHS}, g AS (SELECT *, {', '.join(_G)} FROM r WHERE num IS NOT NULL) SELECT doc_id, pos, num::BIGINT AS num, level::BIGINT AS level, {', '.join(_N)} FROM g")
def list_counters(spark, sf):
    return numbering.counters(paragraphs(spark, sf), 4)


@query("list_levels", f"""WITH {_PARAGRAPHS}, nums AS (SELECT c_custkey AS doc_id, 1 AS num_id, c_nationkey % 2 AS abstract_id FROM customer), levels AS (SELECT c_custkey AS doc_id, c_nationkey % 2 AS abstract_id, c_nationkey % 3 AS ilvl, c_mktsegment AS num_fmt, '%' || (c_nationkey % 3 + 1) || '.' AS lvl_text FROM customer)
    SELECT r.doc_id, r.pos, r.num::BIGINT AS num, r.level::BIGINT AS level, l.num_fmt, l.lvl_text FROM r LEFT JOIN nums n ON r.doc_id = n.doc_id AND r.num = n.num_id LEFT JOIN levels l ON r.doc_id = l.doc_id AND n.abstract_id = l.abstract_id AND r.level = l.ilvl""")  # fmt: skip
def list_levels(spark, sf):
    c_ = spark.read.parquet(f"{sf}/customer.parquet")
    doc, kind, level = F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") % 2).alias("abstract_id"), F.col("c_nationkey") % 3
    nums = c_.select(doc, F.lit(1).alias("num_id"), kind)
    levels = c_.select(doc, kind, level.alias("ilvl"), F.col("c_mktsegment").alias("num_fmt"), F.concat(F.lit("%"), (level + 1).cast("string"), F.lit(".")).alias("lvl_text"))
    return numbering.defined(paragraphs(spark, sf), nums, levels)


_ENTRY = "CASE turn % 8 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'word/header' || turn || '.xml' WHEN 2 THEN 'word/Footer' || (turn % 3) || '.xml' WHEN 3 THEN 'word/footer2.xml' WHEN 4 THEN 'word/media/i.png' WHEN 5 THEN 'word/comments.xml' WHEN 6 THEN 'word/HEADER1.xml' ELSE 'word/endnotes.xml' END"


@query("part_order", f"""WITH e AS (SELECT conv_id AS doc_id, {_ENTRY} AS name FROM conversations), k AS (SELECT *, CASE lower(name) WHEN 'word/document.xml' THEN 1 WHEN 'word/footnotes.xml' THEN 2 WHEN 'word/endnotes.xml' THEN 3 WHEN 'word/comments.xml' THEN 4 ELSE CASE WHEN lower(name) LIKE 'word/header%.xml' THEN 5 WHEN lower(name) LIKE 'word/footer%.xml' THEN 6 END END AS rank FROM e),
    one AS (SELECT doc_id, rank, upper(name) AS up, min(name) AS name FROM k WHERE rank IS NOT NULL GROUP BY ALL) SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY rank, up) AS part_no FROM one""")  # fmt: skip
def part_order(spark, sf):
    return tables.wanted_parts(spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.expr(_ENTRY).alias("name")))


_ACTIVE = ["HKPhrases", "Zeta", "STPhrases", "Alpha", "STCharacters", "STPhrases"]


@query("slot_order", f"WITH a AS (SELECT p_partkey, list_slice([{', '.join(map(repr, _ACTIVE))}], 1 + p_size % 3, 6) AS x FROM part) SELECT p_partkey, array_to_string(list_concat(list_filter([{', '.join(map(repr, tables.SLOT_ORDER))}], lambda s: list_contains(x, s)), list_filter(['Zeta', 'Alpha'], lambda s: list_contains(x, s))), ',') AS slots FROM a")
def slot_order(spark, sf):
    active = F.slice(F.array(*map(F.lit, _ACTIVE)), F.col("p_size") % 3 + 1, F.lit(6))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(tables.ordered_slots(active), ",").alias("slots"))


_SETTINGS = "d AS (SELECT 'a.' || c_custkey AS path, c_mktsegment AS value FROM customer), u AS (SELECT 'a.' || (c_custkey + 40) AS path, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer)"


def _settings(spark, sf):
    c_ = spark.read.parquet(f"{sf}/customer.parquet")
    path = lambda k: F.concat(F.lit("a."), k.cast("string")).alias("path")
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return c_.select(path(F.col("c_custkey")), F.col("c_mktsegment").alias("value")), c_.select(path(F.col("c_custkey") + 40), value.alias("value"))


@query("settings_difference", f"WITH {_SETTINGS} SELECT * FROM u EXCEPT ALL SELECT * FROM d")
def settings_difference(spark, sf):
    return tables.flat_difference(*_settings(spark, sf))


@query("settings_overlay", f"WITH {_SETTINGS} SELECT path, CASE WHEN u.path IS NOT NULL THEN u.value ELSE d.value END AS value FROM d FULL JOIN u USING (path)")
def settings_overlay(spark, sf):
    return tables.flat_overlay(*_settings(spark, sf))


@query("settings_tables", """WITH s AS (SELECT c_custkey AS owner, 'a/k' || (c_nationkey % 5) AS kp, '"' || c_mktsegment || '"' AS kv, '[' || (c_custkey % 3) || ']' AS l, (c_custkey % 7)::VARCHAR AS b FROM customer), d AS (SELECT * FROM s ORDER BY owner LIMIT 1)
    SELECT owner, kp AS path, kv AS value FROM s UNION ALL SELECT owner, 'a/list', l FROM s UNION ALL SELECT owner, 'b', b FROM s UNION ALL SELECT s.owner, d.kp, d.kv FROM s, d WHERE s.kp <> d.kp""")  # fmt: skip
def settings_tables(spark, sf):
    """Nested settings of all customers, flattened, over those of the first."""
    c_, n = spark.read.parquet(f"{sf}/customer.parquet"), F.col("c_custkey")
    text = F.concat(F.lit('{"a": {"k'), (F.col("c_nationkey") % 5).cast("string"), F.lit('": "'), "c_mktsegment", F.lit('", "list": ['), (n % 3).cast("string"), F.lit(']}, "b": '), (n % 7).cast("string"), F.lit("}"))
    own = settings.flattened(c_.select(n.alias("owner"), text.alias("settings")))
    first = c_.agg(F.min("c_custkey")).first()[0]
    return settings.overlaid(own.where(F.col("owner") == first).select("path", "value"), own)


_HELD = "held AS (SELECT 'A_' || page_id % 20 || '.txt' AS path FROM pages)"


@query("batch_new_files", f"WITH {_FILES}, {_HELD} SELECT ins, path FROM files WHERE upper(path) NOT IN (SELECT upper(path) FROM held)")
def batch_new_files(spark, sf):
    held = spark.read.parquet(f"{sf}/pages.parquet").select(F.concat(F.lit("A_"), (F.col("page_id") % 20).cast("string"), F.lit(".txt")).alias("path"))
    return tables.new_files(files(spark, sf), held, ignore_case=True)


@query("uri_paths", "SELECT page_id, '/' || regexp_extract(url, '://(.*)$', 1) || ' +' AS path FROM pages")
def uri_paths(spark, sf):
    uri = F.concat(F.lit("file:///"), F.regexp_extract("url", "://(.*)$", 1), F.lit("%20+"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", path_of_uri(uri).alias("path"))


@query("count_labels", f"WITH {_OBJECTS} SELECT doc_id, max(page_no)::BIGINT AS n_pages, format('{{:,}}', sum(length(raw))::BIGINT) AS label FROM objects GROUP BY doc_id")
def count_labels(spark, sf):
    return objects(spark, sf).groupBy("doc_id").agg(F.max("page_no").alias("n_pages"), F.format_number(F.sum(F.length("raw")), 0).alias("label"))
