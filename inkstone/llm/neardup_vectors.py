"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so that cosine c is distance sqrt(2 - 2c).  A table projects them on Gaussian
directions and quantises each projection into cells of WIDTH with a random offset; the cells and the
label are the bucket.  A table has so many directions that a vector of the largest label meets about
MEETS that are at a right angle to it, as matrix products compare hundreds for what a further table
costs, so that the work grows with the number of vectors and a small power of it; and so many tables are
made that a pair at the threshold misses all of them with probability MISS at most.  A vector's buckets
are computed once, and it is dealt to each of them.  There, exact cosines are computed block by block in
double precision, those of small buckets many at a time.  A pair is counted in the first table that
brings it together, so that each vector's links can be summed; the pairs themselves are never emitted,
only counts and a spanning forest.  Equal vectors are one vector with a weight from the beginning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import broadcast_if_small, dropped, sliced, written
from inkstone.llm.components import components, forest

COSINE = 0.93
WIDTH, MISS = 3.0, 1e-3
#: Vectors at a right angle that one meets in a table, about, and directions of a table, at least.
MEETS, LEAST_HASHES = 512, 4
SEED = 20240229
#: Vectors of a bucket that are compared at once, about; a larger bucket is a grid of pairs of blocks, each a group of its own.
BLOCK = 512
#: Projections of a batch that are held at once.
PROJECTIONS = 1 << 22
#: Buckets of at most SMALL vectors are compared together, about MERGED vectors in one product.
SMALL, MERGED = 64, 256


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection brings two vectors at a distance together."""
    if distance == 0:
        return 1.0
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def hashes(vectors: int, width: float = WIDTH) -> int:
    """Directions of a table with which one of so many vectors meets about MEETS that are at a right angle to it."""
    return max(LEAST_HASHES, math.ceil(math.log(max(vectors / MEETS, 1)) / -math.log(collision(math.sqrt(2), width))))


def tables(directions: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS) -> int:
    """Tables that bound the probability to miss a pair at the threshold."""
    together = collision(math.sqrt(max(0.0, 2 - 2 * cosine)), width) ** directions
    return 1 if together == 1 else math.ceil(math.log(miss) / math.log1p(-together))


class Hash:
    """Buckets of normalised vectors.  Vectors and directions are rounded to integers, so that sums are exact and
    a vector's buckets are the same wherever they are computed."""

    def __init__(self, dimensions: int, count: int, hashes: int, width: float = WIDTH):
        rng = np.random.default_rng([SEED, dimensions])
        self.directions = np.rint(rng.standard_normal((dimensions, count * hashes)) * (1 << 12))
        self.offset = np.rint(rng.random(count * hashes) * width * 2.0**32)
        self.width, self.count, self.hashes = width * 2.0**32, count, hashes
        self.mix = rng.integers(1, 1 << 62, hashes, np.int64) * 2 + 1

    def __call__(self, unit: np.ndarray, count: int | None = None) -> np.ndarray:
        """(vector, table) buckets as 64-bit hashes, of the first ``count`` tables."""
        count = self.count if count is None else count
        k = count * self.hashes
        cell = np.floor((np.rint(unit * (1 << 20)) @ self.directions[:, :k] + self.offset[:k]) / self.width).astype(np.int64)
        h = (cell.reshape(len(unit), count, self.hashes) * self.mix).sum(axis=2)
        return (h ^ (h >> 29)) * np.int64(0x1E3779B97F4A7C15)


def units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0)[:, None]  # so that no square leaves the range of doubles
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def links(x: np.ndarray, y: np.ndarray | None, table: int, hasher: Hash, cosine: float, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y or x) at the threshold that no earlier table brings together; of the same bucket, if x has rows of several."""
    near = x @ (x if y is None else y).T >= cosine
    if y is None:
        near = np.triu(near, 1)
    if bucket is not None:
        near &= bucket[:, None] == bucket
    a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(a):
        return a, b
    near = near[np.ix_(a, b)]
    if table:
        s, t = hasher(x[a], table), hasher((x if y is None else y)[b], table)
        for k in range(table):
            near &= s[:, k, None] != t[None, :, k]
    i, j = np.nonzero(near)
    return a[i], b[j]


def _result(node: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) for the nodes of the pairs i-j; the roots connect them as the pairs do."""
    n = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
    at = np.flatnonzero(n)
    root = node.copy()
    inner, roots = forest(i, j)
    root[inner] = node[roots]
    return node[at], n[at].astype(np.int64), root[at]


def _keys(count: int, directions: int, kind: str):
    """Vectors with their buckets in every table, as keys that the label and the length are part of."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hash] = {}
        for b in sliced(it, max(1, PROJECTIONS // (count * directions))):
            size = b.column(1).to_numpy()
            for length in np.unique(size).tolist():
                part = b.filter(pa.array(size == length))
                hasher = hashers.setdefault(length, Hash(length, count, directions))
                own = part.column(0).to_numpy() * np.int64(0x2545F4914F6CDD1D) + np.int64(length)
                keys = hasher(units(part.column(4).to_pylist(), kind)) + (own ^ (own >> 31))[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), count).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    return run


_GROUP = ["tab", "key", "i", "j", "label", "size"]


def _verify(count: int, directions: int, cosine: float, kind: str):
    """Over rows sorted by group and block: (node, links, root) of each group, the vectors of a bucket's block or of two."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hash] = {}
        held: list[tuple[int, int, int, bytes]] = []
        small: list[tuple[int, int, int, bytes]] = []  # whole buckets of one table and length, one behind the other
        sizes: list[int] = []
        group, kept, out, waiting = None, None, [], 0

        def found(rows: list[tuple[int, int, int, bytes]], tab: int, size: int, high: int | None = None, bucket: np.ndarray | None = None) -> None:
            nonlocal waiting
            block, node, weight = np.array([h[:3] for h in rows]).T
            x = units([h[3] for h in rows], kind)
            cut = len(x) if high is None else int(np.searchsorted(block, high))
            if size not in hashers:
                hashers[size] = Hash(size, count, directions)
            i, j = links(x[:cut], None if high is None else x[cut:], tab, hashers[size], cosine, bucket)
            if len(i):
                out.append(_result(node, weight, i, j + (0 if high is None else cut)))
                waiting += len(out[-1][0])

        def merged() -> None:
            nonlocal small, sizes
            if small:
                found(small, *kept, bucket=np.repeat(np.arange(len(sizes)), sizes))
            small, sizes = [], []

        def close() -> None:
            nonlocal kept
            if len(held) < 2:
                return
            tab, _, low, high, _, size = group
            if low != high or len(held) > SMALL:
                found(held, tab, size, None if low == high else high)
                return
            if kept != (tab, size) or len(small) + len(held) > MERGED:
                merged()
                kept = (tab, size)
            small.extend(held)
            sizes.append(len(held))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "n", "root"])

        for b in it:
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(len(_GROUP))])
            edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])).tolist() if b.num_rows else []
            rows = list(zip(*(b.column(k).to_pylist() for k in range(len(_GROUP), len(_GROUP) + 4)), strict=True))
            for s, e in zip(edge, [*edge[1:], b.num_rows], strict=True) if edge else ():
                now = tuple(key[:, s].tolist())
                if now != group:
                    close()
                    group, held = now, []
                held += rows[s:e]
            if waiting > 50_000:
                yield done()
                out, waiting = [], 0
        close()
        merged()
        if out:
            yield done()

    return run


def _packed(kind: str):
    """Vectors as bytes in the column's own precision; null where they link with nothing."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            vec = []
            for v in b.column(2).to_pylist():
                x = np.array([np.nan if e is None else e for e in v or [0.0]], np.float64)
                vec.append(x.astype(kind).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vec, pa.binary())], ["id", "label", "vec"])

    return run


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those with a null
    label, link with nothing: 0 links, their own component, kept.  Vectors of different lengths don't
    link.  Every row is a vector of its own, equal ones link.  A null id has its component's smallest
    id, or null where it has none.  An empty table gives no rows; other columns are not read.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"  # what is shuffled; cosines are double
    v = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    rows = written(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).mapInArrow(_packed(kind), "id long, label long, vec binary"), "vectors")
    own = rows.where("label is not null and vec is not null")
    reps = own.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    reps = written(reps.select("*", F.monotonically_increasing_id().alias("node")), "distinct-vectors")
    sized = reps.select("label", (F.length("vec") / int(kind[-1])).cast("int").alias("size"), "node", "weight", "vec")
    directions = hashes(sized.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0)
    count = tables(directions, cosine, miss=miss)
    keyed = written(sized.mapInArrow(_keys(count, directions, kind), "label long, size int, node long, weight long, vec binary, keys array<long>"), "buckets")
    keys = keyed.select("label", "size", "node", "weight", "vec", F.posexplode("keys").alias("tab", "key"))
    # A large bucket's members are dealt over blocks of about the same size, and meet in a cell for each two blocks.
    large = written(keys.groupBy("tab", "key").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1"), "large-buckets")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    met = keys.join(broadcast_if_small(large), ["tab", "key"], "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*_GROUP, "block", "node", "weight", "vec")
    dealt = cells.repartition("tab", "key", "i", "j").sortWithinPartitions(*_GROUP, "block")
    result = written(dealt.mapInArrow(_verify(count, directions, cosine, kind), "node long, n long, root long"), "links")
    dropped(keyed)
    dropped(large)
    n = result.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(result, "node", "root").withColumnRenamed("node", "inner")
    of = reps.join(n, "node", "left").join(roots, F.col("node") == F.col("inner"), "left")
    of = of.select("label", "vec", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(least, "root").select(F.col("label").alias("l"), F.col("vec").alias("v"), "n_links", "component_id")
    out = rows.join(of, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")), "left")
    alone = F.col("l").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
