"""URL filter with a path-template tree, with DataFrame functions only.

Rules decide first; pages that a rule decides are the labels of the method for the others.  For each
host, a path's segments that are frequent at their depth stay, the others become wildcards: that is the
page's template.  Above the templates of a host stands its shape, wildcards only; a template whose share
of blocked labels does not differ from its shape's by Z standard errors is merged with it.  The purity
of a template is its share of blocked labels, smoothed by SMOOTH pages of what stands above it: the
shape on the host, the same template on all hosts, the shape on all hosts, all labels.  Templates with a
purity of THRESHOLD or more are rejected.

Only sums by host, depth and template are gathered; they meet the pages by a join that is a broadcast
where their written size allows it, and otherwise one whose skewed hosts Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import written

Rule = tuple[str, str, str]
#: (verdict, host, path)
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A segment stays if so many pages of the host have it at its depth, and this share of those that reach the depth.
MIN_PAGES, MIN_SHARE = 5, 0.05
SMOOTH, Z, THRESHOLD = 5.0, 2.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """STRUCT<length, rule, verdict> of the longest rule that fits; null where none does."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r[1], []).append(r)
    if not by:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    row = lambda r: F.struct(F.lit(len(r[1] + r[2])).alias("length"), F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"), F.lit(r[2]).alias("path"))
    table = F.create_map(*(x for h, rs in by.items() for x in (F.lit(h), F.array(*map(row, rs)))))
    names = F.split(host, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(table, e)), lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    best = F.array_max(fits)
    return F.struct(best["length"].alias("length"), best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def _smooth(b: str, n: str, above: Column) -> Column:
    return (F.coalesce(b, F.lit(0.0)) + SMOOTH * above) / (F.coalesce(n, F.lit(0)) + SMOOTH)


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template) for every row.

    Null urls and those without ``://`` have an empty host and path, which is a host like any other.
    Repeated rows count each.  Ties: of rules of one length the larger text wins; a purity of just
    THRESHOLD is rejected.  Without labels all templates are allowed.  Null ids stay.  An empty table
    gives no rows; other columns are not read.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("best", matched(F.col("host"), F.col("path"), rules))
    own = own.withColumn("segments", F.filter(F.split("path", "/", -1), lambda s: s != ""))

    at = own.select("host", F.posexplode("segments").alias("depth", "segment")).groupBy("host", "depth", "segment").agg(F.count("*").alias("n"))
    reach = at.groupBy(F.col("host").alias("h"), F.col("depth").alias("d")).agg(F.sum("n").alias("total"))
    stay = at.where(F.col("n") >= MIN_PAGES).join(reach, (F.col("host") == F.col("h")) & (F.col("depth") == F.col("d"))).where(F.col("n") >= MIN_SHARE * F.col("total"))
    stay = written(stay.groupBy(F.col("host").alias("h")).agg(F.collect_list(F.struct("depth", "segment")).alias("stay")), "segments")
    own = own.join(stay, F.col("host") == F.col("h"), "left")
    words = F.transform("segments", lambda s, i: F.when(F.array_contains("stay", F.struct(i.alias("depth"), s.alias("segment"))), s).otherwise("*"))
    own = own.withColumns({"template": F.concat(F.lit("/"), F.array_join(words, "/")), "shape": F.concat(F.lit("/"), F.array_join(F.transform("segments", lambda _: F.lit("*")), "/"))})

    labelled = F.col("best.rule").isNotNull()
    sums = own.groupBy("host", "template", "shape").agg(F.sum(labelled.cast("long")).alias("n"), F.sum((F.col("best.verdict") == "block").cast("double")).alias("b"))
    sums = written(sums.fillna(0, ["n"]).fillna(0.0, ["b"]), "templates")
    add = lambda *keys: sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    named = lambda df, p: df.withColumnsRenamed({"n": f"{p}_n", "b": f"{p}_b"})
    tree = sums.join(named(add("host", "shape"), "hm"), ["host", "shape"]).join(named(add("template"), "ct"), "template").join(named(add("shape"), "cm"), "shape")
    all_n, all_b = add().first()
    tree = tree.withColumn("s_cm", _smooth("cm_b", "cm_n", F.lit((all_b or 0.0) / ((all_n or 0) + SMOOTH))))
    tree = tree.withColumns({"s_ct": _smooth("ct_b", "ct_n", F.col("s_cm")), "s_hm": _smooth("hm_b", "hm_n", F.col("s_cm"))})
    share, above = F.try_divide("b", "n"), F.try_divide("hm_b", "hm_n")
    similar = (share - above) * (share - above) * F.col("n") <= Z * Z * above * (1 - above)
    purity = F.when(F.col("n") == 0, F.col("s_ct")).when(similar, F.col("s_hm")).otherwise(_smooth("b", "n", F.col("s_hm")))
    judged = written(tree.select(F.col("host").alias("h"), F.col("template").alias("t"), F.when(purity >= THRESHOLD, "block").otherwise("allow").alias("found")), "verdicts")

    out = own.drop("h").join(judged, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "found").alias("verdict"), "template")


def filter_sql(pages: str, rules: list[Rule] = RULES) -> str:
    """The same rows by SQL."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    url = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    smooth = lambda b, n, above: f"({b} + {SMOOTH} * {above}) / ({n} + {SMOOTH})"
    return f"""
    WITH rules AS (SELECT * FROM (VALUES {values}) x(verdict, host, path)),
    p AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '{url}', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM {pages}),
    fit AS (SELECT p.r, max({{'length': length(x.host || x.path), 'rule': x.host || x.path, 'verdict': x.verdict}}) AS best FROM p JOIN rules x ON (p.host = x.host OR ends_with(p.host, '.' || x.host)) AND starts_with(p.path, x.path) GROUP BY p.r),
    own AS (SELECT p.*, best.rule AS rule, best.verdict AS verdict, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM p LEFT JOIN fit USING (r)),
    seg AS (SELECT r, host, unnest(segments) AS segment, unnest(generate_series(1, len(segments))) AS depth FROM own),
    seg_n AS (SELECT host, depth, segment, count(*) AS n FROM seg GROUP BY ALL),
    reach AS (SELECT host, depth, sum(n) AS total FROM seg_n GROUP BY ALL),
    stay AS (SELECT host, depth, segment FROM seg_n JOIN reach USING (host, depth) WHERE n >= {MIN_PAGES} AND n >= {MIN_SHARE} * total),
    words AS (SELECT r, string_agg(CASE WHEN stay.segment IS NULL THEN '*' ELSE seg.segment END, '/' ORDER BY seg.depth) AS template, string_agg('*', '/') AS shape FROM seg LEFT JOIN stay USING (host, depth, segment) GROUP BY r),
    t AS (SELECT own.*, '/' || coalesce(template, '') AS template, '/' || coalesce(shape, '') AS shape FROM own LEFT JOIN words USING (r)),
    sums AS (SELECT host, template, shape, count(rule)::DOUBLE AS n, count(*) FILTER (WHERE verdict = 'block')::DOUBLE AS b FROM t GROUP BY ALL),
    hm AS (SELECT host, shape, sum(n) AS hm_n, sum(b) AS hm_b FROM sums GROUP BY ALL),
    ct AS (SELECT template, sum(n) AS ct_n, sum(b) AS ct_b FROM sums GROUP BY ALL),
    cm AS (SELECT shape, sum(n) AS cm_n, sum(b) AS cm_b FROM sums GROUP BY ALL),
    tree AS (SELECT *, (SELECT sum(b) / (sum(n) + {SMOOTH}) FROM sums) AS s_all FROM sums JOIN hm USING (host, shape) JOIN ct USING (template) JOIN cm USING (shape)),
    s1 AS (SELECT *, {smooth("cm_b", "cm_n", "s_all")} AS s_cm FROM tree),
    s2 AS (SELECT *, {smooth("ct_b", "ct_n", "s_cm")} AS s_ct, {smooth("hm_b", "hm_n", "s_cm")} AS s_hm FROM s1),
    judged AS (SELECT host, template, CASE WHEN n = 0 THEN s_ct WHEN (b / n - hm_b / hm_n) * (b / n - hm_b / hm_n) * n <= {Z * Z} * (hm_b / hm_n) * (1 - hm_b / hm_n) THEN s_hm ELSE {smooth("b", "n", "s_hm")} END AS purity FROM s2)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN purity >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, template FROM t JOIN judged USING (host, template)"""
