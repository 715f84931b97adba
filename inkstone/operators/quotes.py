"""Dialog quotation marks: normalising ASCII marks by context, and finding ends that make no pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import normalize_newlines
from inkstone.operators.predicates import suspicious_quotes


def normalize_quotes(text: Column, keep_latin: bool = True) -> Column:
    """ASCII quotes become the opening or closing mark that the marks before them call for.

    The double and the single family each remember what was opened last: a curly or corner mark is closed
    by the like, and where nothing is open a curly mark opens.  A single mark between ASCII letters is
    an apostrophe: it stays and tells nothing (``keep_latin``).  Length and all other characters stay;
    null stays null.
    """
    # a fold over the pieces that begin with a mark (but for the first); an apostrophe begins none
    single = r"(?<![A-Za-z])(?=['‘’])|(?<=[A-Za-z])(?=['‘’](?![A-Za-z]))" if keep_latin else "(?=['‘’])"
    pieces = F.split(text, rf'(?=["“”「」『』])|{single}')
    start = F.struct(F.lit("").alias("d"), F.lit("").alias("s"), F.lit("").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        c = F.left(piece, F.lit(1))
        double = F.when(c.isin("“", "「"), c).when(c.isin("”", "」"), "").when((c == '"') & (a["d"] == ""), "“").when(c == '"', "").otherwise(a["d"])
        single = F.when(c.isin("‘", "『"), c).when(c.isin("’", "』"), "").when((c == "'") & (a["s"] == ""), "‘").when(c == "'", "").otherwise(a["s"])
        closing = lambda f: F.translate(f, "“「‘『", "”」’』")
        mark = F.when(c == '"', F.when(a["d"] == "", "“").otherwise(closing(a["d"]))).when(c == "'", F.when(a["s"] == "", "‘").otherwise(closing(a["s"]))).otherwise(c)
        return F.struct(double.alias("d"), single.alias("s"), F.concat(a["out"], mark, F.substr(piece, F.lit(2))).alias("out"))

    return F.when(text.rlike("[\"']"), F.aggregate(pieces, start, step, lambda a: a["out"])).otherwise(text)


def issues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_number from 1, text) of every line whose ends make no pair."""
    lines = docs.select(id_col, F.posexplode(F.split(normalize_newlines(F.col(text_col)), "\n", -1)).alias("n", "line"))
    return lines.where(suspicious_quotes(F.col("line"))).select(id_col, (F.col("n") + 1).cast("int").alias("line_number"), F.col("line").alias("text"))


def issue_array(text: Column) -> Column:
    """The same in place, as an array of structs: no shuffle brings a document's lines together."""
    lines = F.transform(F.split(normalize_newlines(text), "\n", -1), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("text")))
    return F.filter(lines, lambda x: suspicious_quotes(x["text"]))


# ---- fixed values: the report's wording
NO_ISSUES = "No suspicious dialog quote issues found."
HINT = "Hint:\nThe actual typo is often a missing, extra, reversed, or mixed dialog quote\non the reported line or a few lines above it.\nFix the source text and validate again.\n\n"
# ---- end of fixed values


def summary(issues_: Column, most: int = 5) -> Column:
    """Count, hint, the first few lines, and how many more there are."""
    n = F.size(issues_)
    rows = F.array_join(F.transform(F.slice(issues_, 1, most), lambda x: F.concat(x["line_number"].cast("string"), F.lit(": "), x["text"], F.lit("\n"))), "")
    more = F.when(n > most, F.concat(F.lit("...and "), (n - most).cast("string"), F.lit(" more.\n"))).otherwise("")
    found = F.concat(F.lit("Found "), n.cast("string"), F.lit(" suspicious dialog quote line(s).\n\n" + HINT), rows, more)
    return F.when(n == 0, NO_ISSUES).otherwise(found)
