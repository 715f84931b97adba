"""Near-dedup of texts by SimHash with Golay-code fuzzy hashing, and by the Jaccard similarity of their shingles.

Two texts link if their sets of distinct shingles of 5 words (as simhash has them: lower-cased, between
ASCII white space) have similarity 0.8 or more.  A SimHash of each set goes through the Golay keys of
simhash, which find all fingerprints at most 4 bits apart.  Linked texts differ in ten bits on average at
similarity 0.8, and in four or fewer one time in forty, so that others follow: 192 MinHashes of whole texts make
38 keys of 5 hashes each, and a sketch of one bit a hash.  Texts of similarity 0.8 share no key with
probability 3e-7, and differ in more than FAR of the sketch's bits with about as much, so that fewer than
one such pair in a million is missed; of more similar pairs, fewer still.  Fingerprints, keys and sketches
only say which texts are compared: a link counts after the sets themselves were compared, so that none is
wrong.

Equal sets collapse first.  In a MinHash key, a breadth-first search links by sketches; the groups that
come of this and of the fingerprints hold all links, and each brings its members' sets together once.  A
group beyond SHINGLES is cut into blocks, each pair of blocks a group of its own.  There a breadth-first
search gives a spanning forest of the exact links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import broadcast_if_small, dropped, sliced, written
from inkstone.llm.components import components
from inkstone.llm.decontaminate import _parts, text_hashes
from inkstone.llm.simhash import fingerprint_edges, first_rows, majority, one_of_each, rooted, row_hash

WIDTH = 5
#: Similarity of linked texts, as a fraction of integers.
NUMERATOR, DENOMINATOR = 4, 5
HASHES, KEYS, ROWS = 192, 38, 5
#: Bits that sketches of linked texts differ in at most; 19 are expected at similarity 0.8.
FAR = 42
#: Texts of one key that a task compares by sketch; all texts of a larger key are one group.
BLOCK = 50_000
#: Shingles of a group that a task holds, about; a larger group is cut into blocks.
SHINGLES = 8_000_000

_ODD = np.random.default_rng(42).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at once, so that they stay in a core's cache.
_RUN = 1 << 16
_IS_WORD = np.array([c not in b"\0\t\n\v\f\r " for c in range(256)])


def sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words one of all its words, of one without words none."""
    out: list[np.ndarray] = []
    for part in _parts(texts, 1 << 19):
        row, h = text_hashes([texts[i].replace("\0", " ") for i in part], width, _IS_WORD)
        order = np.argsort(row, kind="stable")
        at = np.searchsorted(row[order], np.arange(len(part) + 1)).tolist()
        h = h[order]
        out += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def minhashes(own: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set, a row each; of an empty set zeros."""
    out = np.zeros((len(own), HASHES), np.uint64)
    for n, s in enumerate(own):
        if len(s):
            low = None
            for k in range(0, len(s), max(1, _RUN // HASHES)):
                m = np.multiply.outer(_ODD, s[k : k + max(1, _RUN // HASHES)]).min(axis=1)
                low = m if low is None else np.minimum(low, m)
            out[n] = low
    return out


def marks(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, keys, sketch) of each set."""
    digest = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in own], np.uint64).view(np.int64)
    low = minhashes(own)
    mixed = (low ^ (low >> np.uint64(31))) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    sketch = np.packbits((mixed >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
    keys = np.zeros((len(own), KEYS), np.uint64) + np.arange(1, KEYS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        keys = (keys ^ mixed[:, r : KEYS * ROWS : ROWS]) * _MIX
        keys ^= keys >> np.uint64(32)
    return digest, keys.view(np.int64), sketch


def simhash(own: np.ndarray) -> int:
    """SimHash of a set of shingle hashes."""
    mixed = (own ^ (own >> np.uint64(31))) * _MIX
    return majority(mixed ^ (mixed >> np.uint64(29)))


def _marked(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            own = sets(pc.fill_null(b.column(1), "").to_pylist(), width)
            digest, keys, sketch = marks(own)
            sim = pa.array([simhash(s) for s in own], pa.int64())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), KEYS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest), lists, *(pa.array(np.ascontiguousarray(c)) for c in sketch.T), sim], ["id", "t", "fp", "keys", "s0", "s1", "s2", "sim"])

    return run


def _apart(sketch: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count((sketch ^ other).view(np.uint64)).sum(axis=1, dtype=np.int64)


def search(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning forest of ``n`` members by breadth-first search; ``near`` tells which of some members link with one."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(n)
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            hit = near(x, left)
            new = left[hit].tolist()
            a += [x] * len(new)
            b += new
            front += new
            left = left[~hit]
    return a, b


# ---------------------------------------------------------------- candidates
def _by_simhash(marked: DataFrame, block: int) -> DataFrame:
    """Edges (a, b) that connect the sets whose SimHashes differ in few bits, through one set of each SimHash."""
    of = marked.select("sim", "fp").distinct()
    one = written(of.groupBy("sim").agg(F.min("fp").alias("one")), "simhashes")
    near = fingerprint_edges(one.select(F.col("sim").alias("fp")), block)
    a, b = (one.select(F.col("sim").alias(x), F.col("one").alias(f"one_{x}")) for x in "ab")
    edges = near.join(a, "a").join(b, "b").select(F.col("one_a").alias("a"), F.col("one_b").alias("b"))
    edges = written(edges.union(of.join(one, "sim").where("fp <> one").select("fp", "one")), "near-simhashes")
    dropped(near)
    dropped(one)
    return edges


def _candidates(block: int):
    """Over rows sorted by key: edges between the texts of a key that are near by their sketches."""

    def edges(fp: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = search(len(fp), lambda x, left: _apart(sketch[left], sketch[x]) <= FAR)
        return fp[a], fp[b]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)

        def done(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            two = start[size == 2]
            hit = _apart(rows[two, 1:], rows[two + 1, 1:]) <= FAR
            a, b = [rows[two[hit], 0]], [rows[two[hit] + 1, 0]]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = edges(rows[s : s + n, 0], rows[s : s + n, 1:])
                a.append(x)
                b.append(y)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in it:
            c = [batch.column(k).to_numpy() for k in range(5)]
            key, rows = np.concatenate([key, c[0]]), np.concatenate([rows, np.stack(c[1:], axis=1)])
            if len(key) < block:
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from done(key[:cut], rows[:cut])
                key, rows = key[cut:], rows[cut:]
            if len(key) >= block:  # one key: all its texts are a group; the last stands for them from here on
                yield pa.RecordBatch.from_arrays([pa.array(rows[:-1, 0]), pa.array(rows[1:, 0])], ["a", "b"])
                key, rows = key[-1:], rows[-1:]
                whole = key[0]
                for more in it:
                    c = [more.column(k).to_numpy() for k in range(5)]
                    n = int(np.searchsorted(c[0], whole, "right"))
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rows[0, 0])), pa.array(c[1][:n])], ["a", "b"])
                    if n < len(c[0]):
                        key, rows = c[0][n:], np.stack(c[1:], axis=1)[n:]
                        break
                else:
                    key, rows = key[:0], rows[:0]
        if len(key):
            yield from done(key, rows)

    return run


# ---------------------------------------------------------------- verification
def _with_sets(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            own = sets(pc.fill_null(b.column(1), "").to_pylist(), width)
            fp, _, sketch = marks(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array([len(s) for s in own], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T), pa.array([s.tobytes() for s in own], pa.binary())], ["root", "fp", "n", "s0", "s1", "s2", "own"])

    return run


def links(own: list[np.ndarray], sketch: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the sets whose similarity is 4/5 or more."""
    n = np.array([len(s) for s in own], np.int64)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        hit = _apart(sketch[left], sketch[x]) <= FAR
        hit &= np.minimum(n[left], n[x]) * DENOMINATOR >= np.maximum(n[left], n[x]) * NUMERATOR
        for k in np.flatnonzero(hit).tolist():
            s = own[left[k]]
            at = np.searchsorted(own[x], s)
            shared = int((own[x][np.minimum(at, len(own[x]) - 1)] == s).sum()) if len(own[x]) else 0
            hit[k] = shared * DENOMINATOR >= (len(s) + len(own[x]) - shared) * NUMERATOR
        return hit

    return search(len(own), near)


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (root, i, j, fp, s0, s1, s2, own) sorted by (root, i, j): the exact links of each group."""
    group, fp, sketch, own = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(fp) > 1:
            a, b = links(own, np.array(sketch, np.int64))
            if a:
                f = np.array(fp, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], ["a", "b"])

    for batch in it:
        c = [batch.column(k).to_pylist() for k in range(7)]
        for k, g in enumerate(zip(*c[:3], strict=True)):
            if g != group:
                yield from done()
                group, fp, sketch, own = g, [], [], []
            fp.append(c[3][k])
            sketch.append((c[4][k], c[5][k], c[6][k]))
            own.append(np.frombuffer(batch.column(7)[k].as_buffer(), np.uint64))
    yield from done()


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, block: int, shingles: int) -> DataFrame:
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_hash(text_col).alias("t"))
    marked = written(text.mapInArrow(_marked(width), "id long, t long, fp long, keys array<long>, s0 long, s1 long, s2 long, sim long"), "marks")
    fps = written(first_rows(marked), "distinct-sets")
    close = _by_simhash(marked, block)
    spread = marked.select("fp", "keys", "s0", "s1", "s2").dropDuplicates(["fp"]).select(F.explode("keys").alias("key"), "fp", "s0", "s1", "s2")
    spread = spread.repartition("key").sortWithinPartitions("key", "fp")
    # edges are written before they are contracted, as one stage of two Python steps would keep twice the workers
    found = written(spread.mapInArrow(_candidates(block), "a long, b long"), "near")
    roots = components(close.union(found), "a", "b")
    dropped(close)
    dropped(found)
    near = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    texts = marked.groupBy("fp").agg(F.min("t").alias("t"))
    near = written(near.join(texts, "fp").select("t", "root"), "candidates")  # one text of each set
    own = text.select("text", "t").join(broadcast_if_small(near), "t").dropDuplicates(["t"]).select("root", "text")
    own = written_sets = written(own.mapInArrow(_with_sets(width), "root long, fp long, n long, s0 long, s1 long, s2 long, own binary"), "sets")
    size = own.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(shingles)).cast("long").alias("k")).where("k > 1")
    own = own.join(size, "root", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long")))
    own = own.withColumn("x", F.pmod(F.xxhash64("fp"), "k")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    cells = own.where("k = 1 or x <> y").select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "fp", "s0", "s1", "s2", "own")
    edges = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verified, "a long, b long")
    edges = written(edges, "links")
    roots = components(edges, "a", "b")
    dropped(edges)
    dropped(written_sets)
    dropped(near)
    return rooted(marked, fps, roots)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """(id, component_id) for every row: the smallest id of those that links connect.

    Null and empty texts and those without words are copies of each other.  Repeated rows stay, each
    with its component.  Null ids get the smallest id of their component, which is null only where all
    its ids are.  An empty table gives no rows; other columns are not read.
    """
    return _components(docs, id_col, text_col, width, block, shingles).select(F.col("id").alias(id_col), F.col("low.id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """``docs`` with one row of each component, as ``one_of_each`` says."""
    return one_of_each(docs, _components(docs, id_col, text_col, width, block, shingles), id_col, text_col)
