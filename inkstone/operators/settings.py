"""Nested settings of many owners as tables: flattened level by level, laid over defaults, and reduced to what differs.

A settings text is a JSON object.  Its leaves are rows (owner, path, value): the path is the keys joined by
``/`` (``~`` and ``/`` inside a key are ``~0`` and ``~1``), the value is JSON; arrays and empty objects are leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.sources.shared import kept_table

EMPTY = "{}"
#: Leaves that the one tree of defaults may have.
MOST_DEFAULTS = 5000


def flattened(settings: DataFrame, owner: str = "owner", text: str = "settings") -> DataFrame:
    """(owner, path, value) of every leaf; null and broken texts have none, and a text that is no object is one leaf with an empty path.

    One pass for each level of nesting, over what is still an object; an owner's repeated rows are repeated.
    """
    spark = settings.sparkSession
    rows = settings.select(F.col(owner).alias("owner"), F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    leaves = None
    while True:
        inner = F.schema_of_variant("v").startswith("OBJECT<") & (F.to_json("v") != EMPTY)
        now = kept_table(rows.select("owner", "path", F.to_json("v").alias("value"), inner.alias("inner")), "settings")
        found = now.where(~F.col("inner")).select("owner", "path", "value")
        leaves = found if leaves is None else leaves.unionByName(found)
        if now.where("inner").isEmpty():
            return leaves
        nested = now.where("inner").withColumn("v", F.parse_json("value")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key"), F.col("value").alias("child")))
        key = F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        rows = nested.select("owner", F.when(F.col("path") == "", key).otherwise(F.concat_ws("/", "path", key)).alias("path"), F.col("child").alias("v"))


def _above(path: Column, itself: bool) -> Column:
    """A path's ancestors, the whole tree (an empty path) among them, with itself or without."""
    keys = F.split(path, "/")
    inner = F.transform(F.slice(keys, F.lit(1), F.size(keys) - 1), lambda _, n: F.array_join(F.slice(keys, F.lit(1), n + 1), "/"))
    root = F.array(F.lit(""))
    return F.array_union(F.array_union(root, inner), F.array(path)) if itself else F.when(path == "", F.slice(root, 1, 0)).otherwise(F.array_union(root, inner))


def overlaid(default: DataFrame, own: DataFrame) -> DataFrame:
    """(owner, path, value): for each owner of ``own`` the ``default`` leaves (path, value) with the owner's laid over them.

    Objects are merged; all else, arrays too, is replaced, with whatever lies below it.  An empty object
    replaces what is no object and changes nothing of one.  Defaults are one settings tree, as many rows as
    it has leaves; the result has them for each owner, which is what is asked for.
    """
    leaves = default.select(F.col("path").alias("d_path"), F.col("value").alias("d_value"))
    up = leaves.select("d_path", F.explode(_above(F.col("d_path"), True)).alias("above"))
    objects = up.where("above <> d_path").select("above").distinct()
    kept = own.join(objects, (F.col("path") == F.col("above")) & (F.col("value") == EMPTY), "left_anti").select("owner", "path", "value")
    # a default leaf goes if the owner has a leaf at it or above it, or something below it
    over = kept.select("owner", "path").join(up, F.col("path") == F.col("above")).select("owner", "d_path")
    below = kept.select("owner", F.explode(_above(F.col("path"), False)).alias("above")).join(leaves.select("d_path"), F.col("above") == F.col("d_path")).select("owner", "d_path")
    gone = over.unionByName(below).distinct().select(F.col("owner").alias("g_owner"), F.col("d_path").alias("g_path"))
    one = default.select("path", "value").limit(MOST_DEFAULTS + 1).collect()
    if len(one) > MOST_DEFAULTS:
        raise ValueError(f"the defaults have more than {MOST_DEFAULTS} leaves")
    tree = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in one)) if one else F.array().cast("array<struct<path: string, value: string>>")
    each = own.select("owner").distinct().select("owner", F.explode(tree).alias("x")).select("owner", "x.path", "x.value")
    rest = each.join(gone, F.col("owner").eqNullSafe(F.col("g_owner")) & (F.col("path") == F.col("g_path")), "left_anti")
    return rest.unionByName(kept)


def differing(default: DataFrame, own: DataFrame) -> DataFrame:
    """(owner, path, value): the smallest overlay of each owner that ``overlaid`` turns back into ``own``, keys that are missing aside."""
    objects = default.select(F.explode(_above(F.col("path"), False)).alias("above")).distinct()
    there = default.select(F.col("path").alias("d_path"), F.col("value").alias("d_value"))
    changed = own.join(there, (F.col("path") == F.col("d_path")) & (F.col("value") == F.col("d_value")), "left_anti")
    return changed.join(objects, (F.col("path") == F.col("above")) & (F.col("value") == EMPTY), "left_anti").select("owner", "path", "value")
