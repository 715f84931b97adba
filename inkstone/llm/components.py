"""Connected components of a graph given as edges, by alternating star contraction.

Every round is a pair of group-and-join steps on DataFrames; partitions are contracted with a
union-find first, so that few edges are shuffled.  Nothing is collected to the driver but two sums
that tell when the edges no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import dropped, written

#: Edges that a task contracts at once; bounds its memory.
CHUNK = 1_000_000
#: Nodes with many edges that are broadcast, at most, and the edges that make a node one of them, at least.
HUBS, LEAST_HUB = 1000, 1000
_SCHEMA = "u long, v long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a-b, without the smallest nodes themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # follow the labels to their ends
            step = new[new]
            if np.array_equal(step, new):
                break
            new = step
        if np.array_equal(new, label):
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> Iterator[pa.RecordBatch]:
        if rows:
            t = pa.Table.from_batches(held)
            u, v = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
            yield from pa.table({"u": u, "v": v}).to_batches()

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield from out()
            held, rows = [], 0
    yield from out()


def _with_low(e: DataFrame, edges: int) -> DataFrame:
    """Edges (u, v) with m, the least v of each u.

    A node of many edges would be one task's work in a join: those of more than a thousandth of all edge
    ends, which are HUBS at most, are broadcast, so that only the others' edges are dealt by node.
    """
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    limit = max(LEAST_HUB, 2 * edges // HUBS)
    hubs = F.broadcast(low.where(F.col("n") > limit).select("u", "m"))
    rest = low.where(F.col("n") <= limit).select("u", "m")
    return e.join(hubs, "u", "left_anti").join(rest, "u").unionByName(e.join(hubs, "u"))


def _star(e: DataFrame, edges: int) -> DataFrame:
    """One large-star and one small-star step over edges u > v, of which there are so many."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = F.least("u", "m")
    large = _with_low(both, edges).where((F.col("v") > F.col("u")) & (F.col("v") > m)).select(F.col("v").alias("u"), m.alias("v")).distinct()
    small = _with_low(large, edges).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
    return small.select("x.u", "x.v").where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that is not the smallest of its component; root is the smallest.

    Null ends, self links and repeated edges are allowed and add nothing; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = written(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).mapInArrow(_contract, _SCHEMA), "edges")
    last = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, old = now, e
        e = written(_star(e, now[0]).mapInArrow(_contract, _SCHEMA), "edges")
        dropped(old)
