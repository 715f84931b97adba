"""Benchmark decontamination: size-partitioned MinHash containment search.

The test items are short and the documents long, so that a fixed sketch of a document says nothing
about a passage in it.  Therefore the sketch is the item's: the items are partitioned by their number
of distinct shingles q, and in a partition each item keeps its q - ceil(0.8 q) + 1 smallest shingle
hashes (a bottom-k MinHash whose k follows the size).  A document that holds 0.8 of an item's shingles
holds one of those at least, by counting, so the search loses nothing.  The documents are streamed
once: the shingle hashes of whole texts are made by vector operations over a batch's bytes and looked
up in the sorted sketches.  Candidates are then verified exactly, on the shingles' words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import broadcast_if_small, fresh, sliced, small_batches, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Items a task searches at once; a larger benchmark is searched in blocks of so many.
ITEMS = 20_000
#: Bytes hashed at once.
BLOCK = 1 << 20

_WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)
_P_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_IS_WORD = np.array([bool(chr(c).isalnum()) if c < 128 else True for c in range(256)])


def words(text: str | None) -> list[str]:
    """Lower-cased runs of ASCII letters and digits and of any characters beyond ASCII."""
    return _WORD.findall((text or "").lower())


def shingles(text: str | None, width: int = SHINGLE) -> set[str]:
    """Distinct shingles; of a text with fewer words the whole sequence, of one without words none."""
    w = words(text)
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        with np.errstate(over="ignore"):
            out = np.cumprod(out, dtype=np.uint64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x ^= x >> np.uint64(29)
    x *= _ODD
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word in UTF-8 bytes that are lower case already, by polynomials over blocks of bytes."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # cut between words; a word that fills a block makes it longer
            gaps = np.flatnonzero(~is_word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and is_word[data[end]]:
                    end += 1
        part = data[at:end]
        powers, inverse = _tables(len(part))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word[part], [False]]).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=total[1:])
        starts.append(start + at)
        hashes.append(_mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


@cache
def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_P, size), _powers(_P_INV, size)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(BLOCK) if n <= BLOCK else (_powers(_P, n), _powers(_P_INV, n))


def shingle_hashes(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * _P + h[k : len(h) - width + 1 + k]
    return _mixed(out)


def text_hashes(texts: list[str], width: int = SHINGLE, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle of whole texts, repeats included; texts hold no NUL."""
    data = np.frombuffer("\0".join(texts).lower().encode("utf-8", "replace"), np.uint8)
    texts_at = np.concatenate([[0], np.flatnonzero(data == 0) + 1])
    start, h = word_hashes(data, is_word)
    of = np.searchsorted(texts_at, start, "right") - 1
    row, s = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) >= width:
        s = shingle_hashes(h, width)
        whole = of[: len(s)] == of[width - 1 :]
        row, s = of[: len(s)][whole], s[whole]
    n = np.bincount(of, minlength=len(texts))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.searchsorted(of, short)
        more = np.array([shingle_hashes(h[f : f + k], k)[0] for f, k in zip(first.tolist(), n[short].tolist(), strict=True)], np.uint64)
        row, s = np.concatenate([row, short]), np.concatenate([s, more])
    return row, s


def sketches(items: list[tuple[int, str]], containment: float = CONTAINMENT, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Sorted sketch hashes, the item of each, and the items' shingles."""
    parts: dict[int, list[int]] = {}
    own: dict[int, set[str]] = {}
    for n, (_, text) in enumerate(items):
        s = shingles(text, width)
        if s:
            own[n] = s
            parts.setdefault(len(s), []).append(n)
    at, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for q, members in sorted(parts.items()):  # a partition: items of one size share the length of the sketch
        k = q - math.ceil(containment * q) + 1
        for n in members:
            _, h = text_hashes([items[n][1].replace("\0", " ")], width)
            low = np.unique(h)[:k]
            at.append(low)
            of.append(np.full(len(low), n))
    at, of = np.concatenate(at), np.concatenate(of)
    order = np.argsort(at, kind="stable")
    return at[order], of[order], own


def _search(items: list[tuple[int, str]], containment: float, width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of, own = sketches(items, containment, width)
        for b in sliced(it):
            out: list[tuple] = []
            texts = pc.fill_null(b.column(1), "").to_pylist()
            for part in _parts(texts):
                row, h = text_hashes([texts[i].replace("\0", " ") for i in part], width)
                left = np.searchsorted(at, h)
                hit = np.flatnonzero(at[np.minimum(left, len(at) - 1)] == h) if len(at) else left[:0]
                found = set()
                for i, l, x in zip(row[hit].tolist(), left[hit].tolist(), h[hit], strict=True):
                    while l < len(at) and at[l] == x:
                        found.add((part[i], int(of[l])))
                        l += 1
                known: dict[int, set[str]] = {}
                for i, n in sorted(found):
                    if i not in known:
                        known = {i: shingles(texts[i], width)}
                    shared = len(own[n] & known[i])
                    if shared >= containment * len(own[n]) - 1e-9:
                        out.append((i, items[n][0], shared, len(own[n])))
            take = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], ["id", "item", "n_shared", "n_item"])

    return run


def _parts(texts: list[str], size: int = 1 << 21) -> Iterator[list[int]]:
    """Numbers of consecutive texts with about ``size`` characters together."""
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        n += len(t) + 1
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, width: int = SHINGLE) -> DataFrame:
    """(id, item, n_shared, n_item, containment): every document that holds ``containment`` of an item's distinct shingles.

    The benchmark is read to the driver in blocks of ITEMS items, each searched in all documents.  Null
    and empty texts and items, and those without words, match nothing; an item of fewer than ``width``
    words is one shingle, matched by a document that is just those words.  Null ids are kept as null.
    Repeated rows give repeated pairs; repeated item ids are items of their own.  Empty tables give no
    rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, n_shared long, n_item long"
    found, block = own.where("false").selectExpr("id", "id as item", "id as n_shared", "id as n_item"), []
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).where(F.col(item_text).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS:
            found, block = found.union(own.mapInArrow(_search(block, containment, width), schema)), []
    if block:
        found = found.union(own.mapInArrow(_search(block, containment, width), schema))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null id stay."""
    leak = fresh("_leak", docs)
    bad = written(contaminated(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias(leak)).distinct(), "leaks")
    return docs.join(broadcast_if_small(bad), F.col(id_col) == F.col(leak), "left_anti")


def contaminated_sql(docs: str, benchmark: str, containment: float = CONTAINMENT, width: int = SHINGLE) -> str:
    """The same pairs by joining all shingles, for DuckDB."""
    word = r"[^\x00-/:-@\[-`{-\x7f]+"
    cut = f"list_distinct(list_transform(generate_series(1, greatest(1, len(w) - {width - 1})), lambda i: array_to_string(list_slice(w, i, i + {width - 1}), ' ')))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{word}') AS w FROM {docs}),
    i AS (SELECT row_number() OVER () AS n, item_id, regexp_extract_all(lower(text), '{word}') AS w FROM {benchmark}),
    ds AS (SELECT r, doc_id, unnest({cut}) AS s FROM d WHERE len(w) > 0),
    its AS (SELECT n, item_id, {cut} AS all_s FROM i WHERE len(w) > 0),
    one AS (SELECT n, item_id, len(all_s) AS n_item, unnest(all_s) AS s FROM its)
    SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
    FROM ds JOIN one USING (s) GROUP BY r, doc_id, n, item_id, n_item HAVING count(*) >= {containment} * n_item - 1e-9"""
