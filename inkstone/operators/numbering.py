"""List numbers over tables of paragraphs: which level applies, and its counters, by joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """``paragraphs`` (doc_id, pos, num_id, ilvl, style_id) with the number and level that apply.

    A paragraph's own number goes before its style's, level 0 where it has none; levels are clamped to 0..8.
    """
    s = styles.select("doc_id", "style_id", F.col("num_id").alias("s_num"), F.col("ilvl").alias("s_level"))
    own = F.col("num_id").isNotNull()
    level = F.when(own, F.coalesce("ilvl", F.lit(0))).otherwise(F.col("s_level"))
    out = paragraphs.join(s, ["doc_id", "style_id"], "left")
    return out.select("doc_id", "pos", F.when(own, F.col("num_id")).otherwise(F.col("s_num")).alias("num"), F.least(F.greatest(level, F.lit(0)), F.lit(8)).alias("level"))


def defined(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """Number to abstract list to the level's format; a paragraph without one has nulls."""
    out = paragraphs.join(nums.select("doc_id", F.col("num_id").alias("num"), "abstract_id"), ["doc_id", "num"], "left")
    lv = levels.select("doc_id", "abstract_id", F.col("ilvl").alias("level"), "num_fmt", "lvl_text")
    return out.join(lv, ["doc_id", "abstract_id", "level"], "left").select("doc_id", "pos", "num", "level", "num_fmt", "lvl_text")


def counters(paragraphs: DataFrame, depth: int = 9) -> DataFrame:
    """(doc_id, pos, num, level, n0, n1 ..): a level counts its paragraphs since one that was shallower, in its document and list."""
    w = Window.partitionBy("doc_id", "num").orderBy("pos")
    out = paragraphs.where("num is not null").select("doc_id", "pos", "num", "level")
    out = out.withColumns({f"_g{k}": F.sum((F.col("level") < k).cast("int")).over(w) for k in range(1, depth)} | {"_g0": F.lit(0)})
    for k in range(depth):
        since = Window.partitionBy("doc_id", "num", f"_g{k}").orderBy("pos")
        out = out.withColumn(f"n{k}", F.sum((F.col("level") == k).cast("int")).over(since))
    return out.drop(*(f"_g{k}" for k in range(depth)))
