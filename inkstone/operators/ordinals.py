"""Positions 1, 2, 3 .. over a whole table in a given order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.sources.shared import fresh, kept_table


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place in ``order``, nulls first, as a long; a column called ``name`` is replaced.

    Rows are dealt by range, sorted and numbered within their partition, and written with both numbers.
    The partitions' sizes are read from the very table that the rows are read from, so that they agree
    whatever the planner does with partitions; only these sizes are summed in one task.  Rows that the
    order leaves equal have neighbouring places in either order.  An empty table gives no rows.
    """
    df = df.drop(name)
    part, row = fresh("part", df), fresh("row", df)
    keys = [fresh(f"key{k}", df) for k in range(len(order))]
    sort = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*sort).sortWithinPartitions(*sort)
    marked = dealt.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = kept_table(marked.drop(*keys), "ordinals")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, before.alias(fresh("before", rows)))  # a row for each partition
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(fresh("before", rows)) + F.col(row) + 1).select(*df.columns, name)
