"""Planning a batch: what each file is, in which order, under which name, and what happens to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import extension, stem
from inkstone.operators.ordinals import numbered

# ---- fixed values: extensions by kind
TEXT = [".txt", ".srt", ".vtt", ".ass", ".xml", ".ttml2", ".csv", ".json", ".html", ".cs", ".py", ".java", ".md", ".js"]
OFFICE = [".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".epub"]
# ---- end of fixed values


def kind(path: Column) -> Column:
    """office, pdf, text, or skipped."""
    e = extension(path)
    return F.when(e.isin(OFFICE), "office").when(e == ".pdf", "pdf").when(e.isin(TEXT), "text").otherwise("skipped")


def suffix(direction: Column, config: Column) -> Column:
    """t2s and s2t have suffixes of their own; any other direction carries its configuration."""
    return F.when(direction == "t2s", "_Hans").when(direction == "s2t", "_Hant").otherwise(F.concat(F.lit("_"), config))


def output_name(path: Column, direction: Column, config: Column) -> Column:
    """Stem, suffix and extension; a PDF becomes a text."""
    e = extension(path)
    return F.concat(stem(path), suffix(direction, config), F.when(e == ".pdf", ".txt").otherwise(e))


def add_order(files: DataFrame) -> DataFrame:
    """Added one by one: (path, position), others by upper-cased path, then PDF in the order they came; a path is taken once."""
    once = files.groupBy("path").agg(F.min("ins").alias("ins")).withColumn("is_pdf", extension(F.col("path")) == ".pdf")
    return numbered(once, [F.col("is_pdf"), F.when(~F.col("is_pdf"), F.upper("path")), F.col("ins")]).select("path", "position")


def drop_order(files: DataFrame) -> DataFrame:
    """Dropped together: both halves by upper-cased path; paths that differ in case only are one, the first stays."""
    first = files.groupBy(F.upper("path").alias("up")).agg(F.min_by("path", "ins").alias("path"), F.min("ins").alias("ins")).withColumn("is_pdf", extension(F.col("path")) == ".pdf")
    return numbered(first, [F.col("is_pdf"), F.col("up")]).select("path", "position")
