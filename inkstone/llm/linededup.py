"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host (column ``host_col``) every distinct line is counted once a page; a line on more than
``ratio`` of the host's pages, and on ``min_pages`` of them at least, is boilerplate and goes from all
pages of the host.  Pages of one host with the same text are one page in these counts: a page that is
copied often is no template, and goes to the near-duplicate operators whole.  A host has fewer than (mean lines a page) / ratio such lines, so that its
boilerplate fits one array: the texts meet the arrays by host and are filtered in place.  No text is
shuffled unless the arrays of all hosts exceed the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import fresh, written

RATIO = 0.05
MIN_PAGES = 5


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """What stands for a line, as lines are too long to be shuffled: 64 bits.

    A line goes wrongly only if it shares its key with a boilerplate line of its host: with 3e11 different
    lines of a host and 100 boilerplate lines, 2e-6 lines are expected to.
    """
    return F.xxhash64(line)


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = True) -> DataFrame:
    """(host, n_pages, gone): the keys of the lines to drop, for each host that has any.

    Empty lines are not counted.  Null hosts are one host; null texts are no pages.  With ``distinct``,
    pages of a host with the same text are one page; without, each row is a page.
    """
    own = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where("text is not null")
    keys = F.array_distinct(F.transform(F.filter(lines(F.col("text")), lambda x: F.length(x) > 0), line_key))
    if distinct:
        page = F.struct(F.xxhash64("text").alias("x"), F.hash("text").alias("m"))
        once = own.select("host", page.alias("page"), keys.alias("keys")).groupBy("host", "page").agg(F.first("keys").alias("keys"))
        total = own.select("host", page.alias("page")).distinct()
    else:
        once, total = own.select("host", keys.alias("keys")), own
    once = once.select("host", F.explode("keys").alias("k"))
    total = total.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("n_pages"))
    counted = once.groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counted.join(total, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return often.groupBy("host", "n_pages").agg(F.collect_list("k").alias("gone"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken from ``text_col`` and two more columns, n_lines and n_dropped.

    The other lines keep their order and bytes, and are joined by a newline.  Null texts stay null with
    0 and 0; an empty text has one (empty) line.  Rows with a null host form a host.  Repeated rows are
    pages of their own.  A line counts once a page however often it stands there, and all its copies
    go.  Hosts with fewer than ``min_pages`` pages lose nothing.  An empty table gives no rows.  Columns
    of ``docs`` that are named like a new one are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    site, gone, left = fresh("_site", docs), fresh("_gone", docs), fresh("_left", docs)
    found = boilerplate(docs, host_col, text_col, ratio, min_pages, distinct)
    found = written(found.select(F.col("host").alias(site), F.col("gone").alias(gone)), "boilerplate")  # its size is known then
    joined = docs.join(found, F.col(host_col).eqNullSafe(F.col(site)), "left")
    all_lines = lines(F.col(text_col))
    # the page's own boilerplate by one hashed intersection, then each line is looked up among those few
    own = F.array_intersect(F.transform(all_lines, line_key), F.col(gone))
    kept = F.transform(F.array(own), lambda bad: F.filter(all_lines, lambda x: ~F.array_contains(bad, line_key(x))))[0]
    out = joined.withColumn(left, F.when(F.col(gone).isNull(), all_lines).otherwise(kept))
    n = F.coalesce(F.size(all_lines), F.lit(0))
    n_left = F.coalesce(F.size(left), F.lit(0))
    zero = F.col(text_col).isNull()
    out = out.withColumns({"n_lines": F.when(zero, 0).otherwise(n).cast("long"), "n_dropped": F.when(zero, 0).otherwise(n - n_left).cast("long")})
    return out.withColumn(text_col, F.when(F.col("n_dropped") == 0, F.col(text_col)).otherwise(F.array_join(left, "\n"))).drop(site, gone, left)


def dropped_lines_sql(table: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """SQL for the text of every row of ``table`` without boilerplate: (doc_id, text, n_lines, n_dropped)."""
    return f"""
    WITH pages AS (SELECT row_number() OVER () AS r, doc_id, {host} AS host, text FROM {table}),
    page AS (SELECT host, text, min(r) AS r FROM pages WHERE text IS NOT NULL GROUP BY host, text),
    total AS (SELECT host, count(*) AS n_pages FROM page GROUP BY host),
    line AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM pages WHERE text IS NOT NULL),
    often AS (SELECT l.host, l.line FROM (SELECT DISTINCT r, host, line FROM line WHERE r IN (SELECT r FROM page) AND line <> '') l
      JOIN total t ON l.host IS NOT DISTINCT FROM t.host GROUP BY l.host, l.line, t.n_pages
      HAVING count(*) >= {min_pages} AND count(*) > {ratio} * t.n_pages),
    marked AS (SELECT l.r, l.pos, l.line, o.line IS NOT NULL AS gone FROM line l LEFT JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.line = o.line),
    kept AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY r)
    SELECT p.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped FROM pages p LEFT JOIN kept k USING (r)"""
