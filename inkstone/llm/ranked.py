"""Ranked lexical search by Fagin's threshold algorithm over pieces of an index.

Documents are indexed once, in pieces of bounded size: each has its own term list, document frequencies and,
for each document, the terms with their counts (the forward index).  Queries come in blocks.  One pass over
the term lists sums the block's document frequencies; a second runs the algorithm in every piece: postings of
the block's terms are sorted by impact, lists are read round-robin, a bit deeper each round, every document
that appears is scored at once through the forward index, and reading stops when the threshold, the score of
a document that had the next impact of every list, falls strictly below the k-th score so far.  A task keeps
its k best of each query from piece to piece, so that later pieces stop earlier; the best of all tasks are
ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm import terms
from inkstone.llm.common import dropped, small_batches, written

TOP = 50
#: Documents, and terms with repeats, of a piece; a longer document is a piece of its own.
PIECE_DOCS, PIECE_TERMS = 4096, 1 << 21
#: Queries of a block, and bytes of their texts; a longer query is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Distinct query terms whose impacts are a dense table of a piece at once; a query with more is alone.
DENSE_TERMS = 2048
#: Places of each list that the first round reads; each later round reads twice as many.
DEPTH = 32
_RX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def packed(**columns: np.ndarray | pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    return t[name].chunk(0) if t.num_rows else pa.array([], t.schema.field(name).type)


# ---------------------------------------------------------------- the index
class Piece:
    """Documents that are being indexed."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.size = self.known = 0

    def add(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, words: pa.Array) -> None:
        self.pairs.append((doc, term + self.known, tf))
        self.words.append(words)
        self.known += len(words)
        self.size += int(tf.sum())

    def row(self) -> dict:
        doc, term, tf = (np.concatenate([p[k] for p in self.pairs]) if self.pairs else np.zeros(0, np.int64) for k in range(3))
        coded = pa.concat_arrays(self.words).dictionary_encode() if self.words else pa.array([], pa.string()).dictionary_encode()
        kinds = max(1, len(coded.dictionary))
        key = doc * kinds + coded.indices.to_numpy()[term] if len(doc) else doc
        if len(key) and not (np.diff(key) > 0).all():  # documents of several blocks, and words whose numbers have changed
            key, at = np.unique(key, return_inverse=True)
            tf = np.bincount(at, tf).astype(np.int64)
        doc, term = key // kinds, key % kinds
        n = np.bincount(doc, tf, minlength=self.docs).astype(np.int64)
        return {
            "ids": pa.concat_arrays(self.ids),
            "docs": int((n > 0).sum()),
            "tokens": int(n.sum()),
            "words": packed(word=coded.dictionary, df=np.bincount(term, minlength=len(coded.dictionary))),
            "forward": packed(doc=doc.astype(np.int32), term=term.astype(np.int32), tf=tf.astype(np.int64)),
        }


def _indexed(names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = Piece()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal piece
            if piece.docs:
                r = piece.row()
                ids = pa.ListArray.from_arrays(pa.array([0, len(r["ids"])], pa.int32()), r["ids"])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k]]) for k in names[1:])], names)
            piece = Piece()

        for batch in it:
            going = False  # the block's first text has begun in the block before; it stays in its piece
            for b in terms.blocks(batch.column(1), terms.LETTERS_DIGITS):
                kinds, first, last = len(b.distinct), int(b.row[0]), int(b.row[-1])
                inner = b.of != b.end
                keys, tf = np.unique(b.row[inner] * kinds + b.of[inner], return_counts=True)
                row, term = keys // kinds, keys % kinds
                sizes = np.bincount(row - first, tf, minlength=last - first + 1).astype(np.int64).tolist()
                low, number, size = first, piece.docs - going, piece.size  # the run's first text, its number in the piece
                for r in range(first, last + 2):
                    more = r <= last
                    full = more and (r > first or not going) and (piece.docs >= PIECE_DOCS or size and size + sizes[r - first] > PIECE_TERMS)
                    if full or not more:
                        at = slice(*np.searchsorted(row, [low, r]))
                        piece.add(row[at] - low + number, term[at], tf[at], b.distinct)
                    if full:
                        yield from out()
                        low, number, size = r, 0, 0
                    if more:
                        size += sizes[r - first]
                        if r > first or not going:
                            piece.ids.append(batch.column(0).slice(r, 1))
                            piece.docs += 1
                going = b.of[-1] != b.end
        yield from out()

    return run


# ---------------------------------------------------------------- queries
@dataclass
class Block:
    """Queries as numbers among their distinct terms."""

    words: pa.StringArray
    items: list[tuple[int, np.ndarray]]  # (number, ascending terms)

    @staticmethod
    def of(texts: list[tuple[int, str | None]]) -> Block:
        number, rows, words = {}, [set() for _ in texts], []
        for b in terms.blocks(pa.array([t for _, t in texts], pa.string()), terms.LETTERS_DIGITS):
            own = [number.setdefault(w, len(number)) for w in b.distinct.to_pylist()]
            for r, o in zip(b.row.tolist(), b.of.tolist(), strict=True):
                if o != b.end:
                    rows[r].add(own[o])
        words = pa.array(list(number), pa.string())
        return Block(words, [(n, np.array(sorted(r), np.int64)) for (n, _), r in zip(texts, rows, strict=True) if r])

    def parts(self, most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
        """The queries in runs with so many distinct terms at most."""
        run, had = [], set()
        for n, own in self.items:
            if run and len(had | set(own.tolist())) > most:
                yield run
                run, had = [], set()
            run.append((n, own))
            had |= set(own.tolist())
        if run:
            yield run


def blocks(items: DataFrame, text_col: str) -> Iterator[list[tuple]]:
    """(number, row) of queries, so many at a time; they come from the executors partition by partition."""
    held, size = [], 0
    for n, r in enumerate(items.toLocalIterator()):
        held.append((n, r))
        size += len(r[text_col] or "")
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequencies(block):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = block.value.words
        total = np.zeros(len(words), np.int64)
        for b in it:
            for data in b.column(0).to_pylist():
                t = unpacked(data)
                at = pc.index_in(words, value_set=column(t, "word"))
                some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[some] += column(t, "df").to_numpy()[at.to_numpy(zero_copy_only=False)[some].astype(np.int64)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


class Lists:
    """Impact-sorted lists and the forward table of a piece, for some query terms."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, kinds: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(kinds + 1))
        self.forward = np.zeros((docs, kinds), np.int32)
        self.forward[doc, term] = impact


def best(lists: Lists, own: np.ndarray, w: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of all that can be among the k best by score, ties included; own: the query's lists, w: their weights.

    ``floor`` is a score that k documents are known to reach elsewhere.
    """
    low, end = lists.start[own], lists.start[own + 1]
    some = (w > 0) & (end > low)
    own, w, low, end = own[some], w[some], low[some], end[some]
    seen = np.zeros(len(lists.forward), bool)
    docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    depth, kth = DEPTH, floor
    while len(low):
        at = low[:, None] + np.arange(depth)
        new = np.unique(lists.doc[at[at < end[:, None]]])
        new = new[~seen[new]]
        seen[new] = True
        score = lists.forward[np.ix_(new, own)].astype(np.int64) @ w
        good = score >= max(kth, 1)
        docs.append(new[good])
        scores.append(score[good])
        if sum(map(len, scores)) > k:
            s = np.concatenate(scores)
            kth = max(kth, int(np.partition(s, len(s) - k)[len(s) - k]))
        low = np.minimum(low + depth, end)
        going = low < end
        threshold = int((w[going] * lists.impact[low[going]]).sum())  # a list that is read adds nothing
        if threshold < max(kth, 1):
            break
        depth *= 2
    d, s = np.concatenate(docs), np.concatenate(scores)
    good = s >= max(kth, 1)
    return d[good], s[good]


class Ranking:
    """The k best (score, id) of a query so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        return self.rows[-1][1] if len(self.rows) == self.k else 0

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows += zip(ids, scores, strict=True)
        self.rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] if r[0] is not None else 0))
        del self.rows[self.k :]


def _searched(block, weights, n: int, total: int, k: int, id_type: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = block.value, weights.value
        found: dict[int, Ranking] = {}
        for batch in it:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                words, forward = unpacked(batch.column(1)[i].as_py()), unpacked(batch.column(2)[i].as_py())
                doc, term, tf = (column(forward, c).to_numpy() for c in ("doc", "term", "tf"))
                length = np.bincount(doc, tf, minlength=len(ids)).astype(np.int64)
                m = 50 + 50 * length * n // max(total, 1)
                number = pc.fill_null(pc.index_in(column(words, "word"), value_set=queries.words), -1).to_numpy().astype(np.int64)
                some = np.flatnonzero(number[term] >= 0) if len(term) else np.zeros(0, np.int64)
                doc, term, tf = doc[some], number[term[some]] if len(some) else term[:0].astype(np.int64), tf[some]
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
                for part in queries.parts(DENSE_TERMS):
                    use = np.unique(np.concatenate([own for _, own in part]))
                    place = np.full(len(queries.words), -1)
                    place[use] = np.arange(len(use))
                    at = np.flatnonzero(place[term] >= 0) if len(term) else np.zeros(0, np.int64)
                    lists = Lists(len(ids), doc[at], place[term[at]], impact[at], len(use))
                    for q, own in part:
                        r = found.setdefault(q, Ranking(k))
                        d, s = best(lists, place[own], w[own], k, r.floor)
                        r.add(ids.take(pa.array(d)).to_pylist(), s.tolist())
        for q, r in found.items():
            if r.rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r.rows), q)), pa.array([x for x, _ in r.rows], id_type), pa.array([s for _, s in r.rows], pa.int64())], ["query", "doc", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """(item, rank, id, score): each query's ``k`` best documents with a score above 0, equal scores by ascending id.

    Every row of ``items`` is a query of its own, repeated ids too; null and empty queries find nothing.  Null
    and empty texts are no documents.  Repeated documents each have a rank; null ids come after others of the
    same score.  Very long texts are read in blocks and are pieces of their own.  Empty tables give no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type, item_type = (df.select(c).schema[0].dataType.simpleString() for df, c in ((docs, id_col), (items, item_col)))
    names = ["ids", "docs", "tokens", "words", "forward"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = written(rows.mapInArrow(_indexed(names), f"ids array<{id_type}>, docs long, tokens long, words binary, forward binary"), "index")
    n, total = (int(x or 0) for x in index.agg(F.sum("docs"), F.sum("tokens")).first())
    arrow_type = spark.createDataFrame([], f"id {id_type}").toArrow().schema.field(0).type
    out = []
    for held in blocks(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), "text"):
        block = Block.of([(q, r["text"]) for q, r in held])
        shared = spark.sparkContext.broadcast(block)  # of BLOCK_ITEMS and BLOCK_BYTES at most, or one query
        df = np.zeros(len(block.words), np.int64)
        for t, c in index.select("words").mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # the block's terms
            df[t] = c
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64))
        near = index.select("ids", "words", "forward").mapInArrow(_searched(shared, weights, n, total, k, arrow_type), f"query long, doc {id_type}, score long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
        named = spark.createDataFrame([(q, r["item"]) for q, r in held], f"query long, item {item_type}")
        ranked = near.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(named), "query")  # a block's ids
        out.append(written(ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score"), "ranked"))
    dropped(index)
    if not out:
        return spark.createDataFrame([], f"{item_col} {item_type}, rank int, {id_col} {id_type}, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def search_sql(docs: str, items: str) -> str:
    """The same in DuckDB's SQL."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '{_RX}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS ts FROM {docs}),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts) * n) // l AS m FROM d, s),
q AS (SELECT DISTINCT i, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS i, item_id, {cut} AS ts FROM {items})),
c AS (SELECT i, item_id, f.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w ON q.term = w.term JOIN f ON f.term = q.term JOIN m ON m.r = f.r GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""
