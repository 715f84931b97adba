"""Small set and order operations of the file lists, parts, slots and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: parts of a word-processing file in reading order, and slots in display order
FIXED_PARTS = ["word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"]
SLOT_ORDER = ["STCharacters", "STPhrases", "STPunctuations", "TSCharacters", "TSPhrases", "TSPunctuations", "TWVariants", "TWPhrases", "HKVariants", "HKPhrases"]
# ---- end of fixed values


def part_rank(name: Column) -> Column:
    """Place of a part's kind: the fixed four, headers, footers; null for other entries."""
    fixed = F.array_position(F.array(*map(F.lit, FIXED_PARTS)), F.lower(name))
    return F.when(fixed > 0, fixed).when(name.rlike(r"(?i)^word/header[^/]*\.xml$"), 5).when(name.rlike(r"(?i)^word/footer[^/]*\.xml$"), 6)


def wanted_parts(entries: DataFrame) -> DataFrame:
    """(doc_id, name, part_no) of the parts that are read; of names that differ in case only the first by name."""
    own = entries.withColumn("rank", part_rank(F.col("name"))).where("rank is not null")
    one = own.groupBy("doc_id", "rank", F.upper("name").alias("up")).agg(F.min("name").alias("name"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "up", "name")))
    return one.groupBy("doc_id").agg(ordered.alias("p")).select("doc_id", F.posexplode("p").alias("n", "x")).select("doc_id", "x.name", (F.col("n") + 1).alias("part_no"))


def ordered_slots(active: Column) -> Column:
    """Distinct slots, those with a place in the display order first, the others after in the order they came."""
    names = F.array_distinct(active)
    order = F.array(*map(F.lit, SLOT_ORDER))
    return F.concat(F.array_intersect(order, names), F.array_except(names, order))


def flat_difference(default: DataFrame, now: DataFrame) -> DataFrame:
    """(path, value) rows of ``now`` that ``default`` lacks or has otherwise."""
    return now.select("path", "value").exceptAll(default.select("path", "value"))


def flat_overlay(default: DataFrame, user: DataFrame) -> DataFrame:
    """(path, value): the user's where there is one."""
    u = user.select("path", F.col("value").alias("own"), F.lit(True).alias("set"))
    return default.join(u, "path", "full").select("path", F.when(F.col("set"), F.col("own")).otherwise(F.col("value")).alias("value"))


def without(files: DataFrame, path: str) -> DataFrame:
    """A batch list with one file taken away."""
    return files.where(F.col("path") != path)


def new_files(files: DataFrame, held: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Files that a list does not hold yet."""
    key = F.upper if ignore_case else (lambda c: F.col(c))
    there = held.select(key("path").alias("_held")).distinct()
    return files.join(there, key("path") == F.col("_held"), "left_anti")
