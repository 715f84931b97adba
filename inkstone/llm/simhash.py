"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit SimHash is cut into segments A (23 bits), B (23) and C (18, zero-padded to 23).  The perfect
binary Golay code has a codeword within 3 bits of any 23-bit word, and all codewords within 4 bits of
a word are one (nearest at 0 to 2 bits) or six (nearest at 3 bits).  Two facts give the keys:

* words at most 2 bits apart share a codeword among those within 4 bits;
* of words at most 1 bit apart, the nearest codeword of either is within 4 bits of the other.

Two fingerprints that differ in at most 4 bits have errors (e1 <= e2 <= e3) over the three segments
with e1 = 0 and e2 <= 2, or e1 = e2 = 1.  The first case is caught by keys (segment X exactly, a
codeword near Y) for the six ordered pairs, the second by keys (a codeword near X, a codeword near Y),
where one side takes its nearest codeword in X and all in Y and the other the reverse.  So no pair is
missed, with about 64 keys for each *distinct* fingerprint; copies never meet each other.  Within a key,
a breadth-first search verifies distances and returns a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import broadcast_if_small, dropped, fresh, sliced, written
from inkstone.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of one key that a task holds; more are cut into blocks and compared block by block.
BLOCK = 200_000
#: Keys with at most so many fingerprints are compared in one vector operation over all of them.
SMALL = 12

# ---------------------------------------------------------------- fingerprints
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash as a signed 64-bit integer; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    h64 = xxhash.xxh64_intdigest
    return majority(np.array([h64(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; 0 of none."""
    by = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(by, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(it):
        fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["id", "t", "fp"])


# ---------------------------------------------------------------- Golay keys
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; for each syndrome the error patterns of weight 4 or less, and their number."""
    generator = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= generator << (k - 11)
        parity[m] = r
    weight = lambda n: np.array([sum(1 << i for i in c) for c in combinations(range(23), n)], np.int64)
    syndrome = lambda e: parity[e >> 11] ^ (e & 2047)
    patterns, number = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for n in range(4):
        e = weight(n)
        patterns[syndrome(e), 0] = e
        number[syndrome(e)] = 6 if n == 3 else 1
    e = weight(4)
    e = e[np.argsort(syndrome(e), kind="stable")]
    patterns[np.flatnonzero(number == 6), 1:] = e.reshape(-1, 5)
    return parity, patterns, number


_PARITY, _PATTERNS, _NUMBER = _golay()


def nearest(x: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each 23-bit word."""
    return (x ^ _PATTERNS[_PARITY[x >> 11] ^ (x & 2047), 0]) >> 11


def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all codewords within 4 bits of each 23-bit word."""
    s = _PARITY[x >> 11] ^ (x & 2047)
    n = _NUMBER[s]
    row = np.repeat(np.arange(len(x)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (x[row] ^ _PATTERNS[s[row], k]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows, such that fingerprints at most 4 bits apart share a key."""
    u = fp.view(np.uint64)
    parts = [(u >> np.uint64(41)).astype(np.int64), ((u >> np.uint64(18)) & np.uint64(0x7FFFFF)).astype(np.int64), (u & np.uint64(0x3FFFF)).astype(np.int64)]
    close, first = [near(p) for p in parts], [nearest(p) for p in parts]
    rows, out, kind = [], [], 0
    for x in range(3):
        for y in range(3):
            if x != y:
                row, k = close[y]
                rows.append(row)
                out.append((kind << 35) | (parts[x][row] << 12) | k)
                kind += 1
    for x, y in ((0, 1), (0, 2), (1, 2)):
        row, k = close[y]
        rows.append(row)
        out.append((kind << 35) | (first[x][row] << 12) | k)
        row, k = close[x]
        other = k != first[x][row]  # the nearest of both sides is there already
        row, k = row[other], k[other]
        rows.append(row)
        out.append((kind << 35) | (k << 12) | first[y][row])
        kind += 1
    return np.concatenate(out), fp[np.concatenate(rows)]


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        k, fp = keys(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp)], ["key", "fp"])


# ---------------------------------------------------------------- verification
def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def linked(fp: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the fingerprints at most MAX_BITS apart, by breadth-first search.

    With ``other``, only links between ``fp`` and ``other`` count, for the blocks of a large key.
    """
    a, b = [], []
    if other is not None:
        for x in fp:
            hit = other[_apart(other, x) <= MAX_BITS]
            a.append(np.full(len(hit), x))
            b.append(hit)
        return np.concatenate([*a, fp[:0]]), np.concatenate([*b, fp[:0]])
    left = fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = _apart(left, x) <= MAX_BITS
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), x))
                b.append(new)
                front.extend(new.tolist())
                left = left[~hit]
    return np.concatenate([*a, fp[:0]]), np.concatenate([*b, fp[:0]])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return start, np.diff(np.append(start, len(key)))


def _verify(block: int):
    """Over rows sorted by (key, fp): edges (block null), and the fingerprints of keys that are too large for a task (b null)."""

    def rows(a, b, key=None, part=None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(np.full(n, key)), none if part is None else pa.array(np.full(n, part, np.int64))], ["a", "b", "key", "block"])

    def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, n = _runs(key)
        small = np.repeat(n <= SMALL, n)
        k, f = key[small], fp[small]
        a, b = [fp[:0]], [fp[:0]]
        for s in range(1, SMALL):
            same = k[s:] == k[:-s]
            if not same.any():
                break
            x, y = f[s:][same], f[:-s][same]
            hit = _apart(x, y) <= MAX_BITS
            a.append(x[hit])
            b.append(y[hit])
        for i in np.flatnonzero(n > SMALL):
            x, y = linked(fp[start[i] : start[i] + n[i]])
            a.append(x)
            b.append(y)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        if pairs.shape[1]:
            yield rows(pairs[0], pairs[1])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        number = 0  # blocks of the last key so far
        for b in it:
            key, fp = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([fp, b.column(1).to_numpy()])
            if len(key) < block:
                continue
            cut = int(np.searchsorted(key, key[-1])) if key[-1] != key[0] else 0
            if cut:
                if number:  # the first key began in an earlier batch
                    end = int(np.searchsorted(key, key[0], "right"))
                    yield rows(fp[:end], None, key[0], number)
                yield from done(key[:cut], fp[:cut])
                key, fp, number = key[cut:], fp[cut:], 0
            while len(key) >= block:
                yield rows(fp[:block], None, key[0], number)
                yield from done(key[:block], fp[:block])
                key, fp, number = key[block:], fp[block:], number + 1
        if len(key):
            if number:
                end = int(np.searchsorted(key, key[0], "right"))
                yield rows(fp[:end], None, key[0], number)
            yield from done(key, fp)

    return run


def _cells(pdf):
    """Links between two blocks of a large key."""
    import pandas as pd

    low = pdf["block"] == pdf["i"]
    a, b = linked(pdf["a"][low].to_numpy(np.int64), pdf["a"][~low].to_numpy(np.int64))
    a, b = forest_edges(a, b)
    return pd.DataFrame({"a": a, "b": b})


def forest_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from inkstone.llm.components import forest

    return forest(a, b) if len(a) else (a, b)


def fingerprint_edges(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` of ``fps`` as links of MAX_BITS bits or fewer do."""
    spread = fps.select("fp").mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = written(spread.mapInArrow(_verify(block), "a long, b long, key long, block long"), "simhash")
    edges = found.where("b is not null").select("a", "b")
    large = found.where("b is null")
    if not large.isEmpty():  # an exact way for keys that exceed a task: each pair of blocks is a group of its own
        top = large.groupBy("key").agg(F.max("block").alias("top"))
        cells = large.join(top, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "top"))).where("other != block")
        cells = cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        edges = edges.union(cells.groupBy("key", "i", "j").applyInPandas(_cells, "a long, b long"))
    return edges


def row_hash(text_col: str) -> Column:
    """What tells apart rows that share an id."""
    return F.xxhash64(F.col(text_col))


def first_rows(marked: DataFrame) -> DataFrame:
    """(fp, low, ...) of rows (id, t, fp, ...): the smallest id with a text's hash that has each fingerprint."""
    return marked.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "t"))).alias("low"))


def rooted(marked: DataFrame, fps: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, t, fp, low) for every row of ``marked``: low is the smallest (id, t) of the row's component."""
    of = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("low").alias("low"))
    of = of.select("fp", "root").join(least, "root").select("fp", "low")
    return marked.select("id", "t", "fp").join(of, "fp")


def _components(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_hash(text_col).alias("t"))
    marked = written(marked.mapInArrow(_fingerprints, "id long, t long, fp long"), "fingerprints")
    fps = written(first_rows(marked), "distinct-fingerprints")
    edges = fingerprint_edges(fps, block)
    roots = components(edges, "a", "b")
    dropped(edges)
    return rooted(marked, fps, roots)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, fingerprint hex, component_id) for every row.

    Null and empty texts have fingerprint 0 and link like any other.  Repeated rows stay, each with its
    component.  Null ids keep their fingerprint and get the smallest id of their component, which is
    null only where all its ids are.  Ties: the smallest id wins.  An empty table gives no rows; other
    columns are not read.
    """
    return _components(docs, id_col, text_col, block).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component, as ``one_of_each`` says."""
    return one_of_each(docs, _components(docs, id_col, text_col, block), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``found`` (id, t, low): one of its smallest id.

    Of rows that share this id the one whose text has the smallest hash stays, and one only of rows with
    the same id and text; rows that share an id but are of different components are judged apart.  Rows
    with a null id stay.  ``docs`` may have any columns.
    """
    key, text = fresh("_key", docs), fresh("_text_key", docs)
    found = written(found.where(F.col("id").isNotNull()).select(F.col("id").alias(key), F.col("t").alias(text), "low"), "components")
    first = (F.col(key) == F.col("low.id")) & (F.col(text) == F.col("low.t"))
    # what goes is small beside what stays: the number of its rows decides whether texts are shuffled at all
    gone = broadcast_if_small(written(found.where(~first).select(key, text).distinct(), "copies"))
    again = broadcast_if_small(written(found.where(first).groupBy(key, text).count().where("count > 1").select(key, text), "repeated-rows"))
    is_row = (docs[f"`{id_col}`"] == F.col(key)) & (row_hash(f"`{text_col}`") == F.col(text))
    stay = docs.join(gone, is_row, "left_anti")
    if again.isEmpty():
        return stay
    once = stay.join(again, is_row, "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(again, is_row, "left_anti").unionByName(once)
