"""A hashed maximum-entropy language model with class-factored softmax.

A word's probability is its class's times its own within the class.  The most frequent words make HEADS
classes of WIDE words each, in order of frequency; all others are dealt to TAILS classes by their ending.
The class, and a head word within its class, come from a softmax over sums of weight rows, one row for each
feature: the word before, the two before together, and, as a skip, the second before alone.
Features are hashed to rows, so that the model has a fixed size whatever the vocabulary.  Within a tail
class a word has its share of the class's training tokens, one added to each and one slot left for unknown
words: probabilities of all words and the slots add up to one.

Training: documents are dealt to rounds; in each round every task starts from the same weights, takes
AdaGrad steps over its documents, and hands over the rows it has changed; a row's new weights are the mean
over the tasks, weighted by how often each has seen its feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import terms
from inkstone.llm.common import dropped, small_batches, written

HEADS, WIDE, TAILS = 16, 32, 16
#: Rows of weights for classes, and for words within classes; powers of two.
CLASS_ROWS, WORD_ROWS = 1 << 16, 1 << 15
#: Words whose counts every task has; counts of rarer ones come by a join.
KNOWN = 1 << 18
#: Words that are features themselves; rarer ones count by their endings.
CONTEXT = 1 << 14
ROUNDS, RATE, STEP = 2, 0.8, 1 << 13
#: Tokens whose probabilities are in memory at once.
CHUNK = 1 << 12
#: Bound of a sum of weights, so that its exponential is a number.
LARGEST = 60.0
#: Weight rows that travel together.
PART = 512
#: Bytes of input that train one task's weights, at least.
SHARD = 16 << 20
#: Longer words are never among the known.
KNOWN_BYTES = 64
#: Distinct words that a task counts before it hands them over.
HELD = 1 << 20

_MIX = np.random.default_rng(11).integers(1, 1 << 62, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def _row(h: np.ndarray, rows: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)


def tail_class(words: pa.StringArray) -> np.ndarray:
    """The class of words that are in no head class, by their endings."""
    return HEADS + _row(terms.endings(words).astype(np.uint64) * _MIX[7], TAILS)


@dataclass
class Vocabulary:
    """What training has counted: the KNOWN most frequent words in order, all tokens, all words, and each tail class's."""

    words: pa.StringArray
    counts: np.ndarray
    tokens: int
    distinct: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    order: np.ndarray | None = None
    sorted: np.ndarray | None = None

    def look_up(self, distinct: pa.StringArray) -> tuple[np.ndarray, ...]:
        """Of distinct words: place among the known (-1: not there), class, place in it (-1: a tail class), and hash as a feature."""
        h = terms.hashes(distinct)
        known = np.full(len(h), -1)
        if len(self.words):
            if self.order is None:
                own = terms.hashes(self.words)
                self.order = np.argsort(own, kind="stable")
                self.sorted = own[self.order]
            at = self.order[np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)]
            known = np.where(pc.equal(self.words.take(pa.array(at)), distinct).to_numpy(zero_copy_only=False), at, -1)
        head = (known >= 0) & (known < HEADS * WIDE)
        ends = terms.endings(distinct).astype(np.uint64)
        cls = np.where(head, known // WIDE, tail_class(distinct))
        return known, cls, np.where(head, known % WIDE, -1), np.where((known >= 0) & (known < CONTEXT), h, ends * _MIX[6])


class Model:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        n = np.zeros(HEADS * WIDE)
        n[: min(len(n), len(vocabulary.counts))] = vocabulary.counts[: len(n)]
        n = n.reshape(HEADS, WIDE) + 1
        by = np.concatenate([n.sum(axis=1), vocabulary.tail_tokens + 1.0])
        self.class_bias = np.log(by / by.sum()).astype(np.float32)
        self.word_bias = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)
        self.classes = np.zeros((CLASS_ROWS, HEADS + TAILS), np.float32)
        self.words = np.zeros((WORD_ROWS, WIDE), np.float32)
        self.room = np.empty((2, 0, 1), np.float32)

    def features(self, before: np.ndarray) -> np.ndarray:
        """Hashes of the features, a row for each: ``before`` has the hashes of the last and the second last word."""
        a, b = before
        return np.stack([a * _MIX[0], a * _MIX[1] + b * _MIX[2], b * _MIX[3]])

    def logits(self, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of all outcomes, one row for each token; the next call uses the same memory."""
        if at.shape[1] > len(self.room[0]):
            self.room = np.empty((2, at.shape[1], max(HEADS + TAILS, WIDE)), np.float32)
        x, y = (r.reshape(-1)[: at.shape[1] * weights.shape[1]].reshape(-1, weights.shape[1]) for r in self.room)
        weights.take(at[0], axis=0, out=x, mode="clip")
        for k in at[1:]:
            x += weights.take(k, axis=0, out=y, mode="clip")
        x += bias
        np.clip(x, -LARGEST, LARGEST, out=x)
        x -= np.log(np.exp(x, out=y) @ np.ones(x.shape[1], np.float32))[:, None]
        return x

    def parts(self, f: np.ndarray, cls: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """(weights, bias, rows, outcome, tokens) of the class step and of the step within head classes."""
        yield "classes", self.class_bias, _row(f, CLASS_ROWS), cls, slice(None)
        some = np.flatnonzero(place >= 0)
        if len(some):
            g = f[:, some] + (cls[some].astype(np.uint64) + np.uint64(1)) * _MIX[5]
            yield "words", self.word_bias[cls[some]], _row(g, WORD_ROWS), place[some], some

    def log_probabilities(self, before: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural logarithm of the class's, and for head words the word's, probability."""
        out = np.zeros(len(cls))
        for k in range(0, len(cls), CHUNK):
            s = slice(k, k + CHUNK)
            own = out[s]
            for what, bias, at, y, of in self.parts(self.features(before[:, s]), cls[s], place[s]):
                own[of] += self.logits(getattr(self, what), bias, at)[np.arange(len(y)), y]
        return out


class Trainer:
    """AdaGrad steps over batches, with one sum of squares for each row."""

    def __init__(self, model: Model):
        self.m = model
        self.squares = {"classes": np.full(CLASS_ROWS, 1.0, np.float32), "words": np.full(WORD_ROWS, 1.0, np.float32)}
        self.rooms = np.empty((3, 0), np.float32)
        self.seen = {"classes": np.zeros(CLASS_ROWS, np.float32), "words": np.zeros(WORD_ROWS, np.float32)}

    def learn(self, before: np.ndarray, cls: np.ndarray, place: np.ndarray) -> None:
        for k in range(0, len(cls), STEP):
            s = slice(k, k + STEP)
            for what, bias, at, y, _ in self.m.parts(self.m.features(before[:, s]), cls[s], place[s]):
                self.step(what, bias, at, y)

    def step(self, what: str, bias: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        weights, squares, seen = getattr(self.m, what), self.squares[what], self.seen[what]
        g = self.m.logits(weights, bias, at)
        np.exp(g, out=g)
        np.negative(g, out=g)
        g[np.arange(len(y)), y] += 1
        flat = at.ravel().astype(np.uint16)  # sorts in a few passes
        order = np.argsort(flat, kind="stable")
        rows, n, up = self.summed(flat[order], g, order % len(y))
        rows = rows.astype(np.int64)
        squares[rows] += np.einsum("ij,ij->i", up, up) / n
        up *= (RATE / np.sqrt(squares[rows] * n))[:, None]
        up += weights.take(rows, axis=0, out=self.rooms[2].reshape(-1)[: up.size].reshape(up.shape), mode="clip")
        weights[rows] = up
        seen[rows] += n

    def summed(self, keys: np.ndarray, g: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ascending keys the distinct ones, how many of each, and the sums of rows g[of]: neighbours are added by twos, again and again."""
        if (len(keys) + 1) * g.shape[1] > self.rooms.shape[1]:
            self.rooms = np.empty((3, (len(keys) + 1) * g.shape[1]), np.float32)
        room = lambda k, n: self.rooms[k, : n * g.shape[1]].reshape(n, g.shape[1])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(first, append=len(keys))
        at = np.arange(len(keys)) - np.repeat(first, n)
        now, other = 0, 1
        g.take(of, axis=0, out=room(now, len(keys)), mode="clip")
        while len(at) > len(first):
            x = room(now, len(at) + 1)
            x[-1] = 0
            even = np.flatnonzero(~at & 1)
            partner = np.append(at[1:], 0)[even] & 1  # the next one has an odd place, so it has the same key
            partner = np.where(partner, even + 1, len(at))
            y = x.take(even, axis=0, out=room(other, len(even)), mode="clip")
            y += x.take(partner, axis=0, out=room(2, len(even)), mode="clip")
            at, now, other = at[even] >> 1, other, now
        return keys[first], n, room(now, len(at))


# ---------------------------------------------------------------- over documents
_BEFORE = np.uint64(0x5DEECE66D)  # stands before a text's first word


class Stream:
    """Blocks of terms as the model sees them; the words before a block are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def blocks(self, texts: pa.Array) -> Iterator[tuple]:
        """(block, places among the known, classes, places within classes, hashes before), the middle three of distinct words."""
        rows, tail = np.full(2, -1), np.full(2, _BEFORE)
        for b in terms.blocks(texts, terms.WORDS):
            known, cls, place, h = self.v.look_up(b.distinct)
            r, x = np.concatenate([rows, b.row]), np.concatenate([tail, h[b.of]])
            before = np.stack([np.where(r[2:] == r[2 - k : -k], x[2 - k : -k], _BEFORE) for k in (1, 2)])
            rows, tail = r[-2:], x[-2:]
            yield b, known, cls, place, before


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, its tail class, count), summed over many batches."""
    held, n = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        for b in t.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tail_class(b.column(0))), b.column(1)], ["word", "cls", "n"])

    for batch in it:
        for b in terms.blocks(batch.column(0), terms.WORDS):
            held.append(pa.table({"word": b.distinct, "n": np.bincount(b.of, minlength=len(b.distinct))}))
            n += len(b.distinct)
            if n >= HELD:
                held = [merged()]
                n = held[0].num_rows
                if n >= HELD // 2:
                    yield from out(held[0])
                    held, n = [], 0
    if held:
        yield from out(merged())


def _trained(weights, vocabulary):
    """Over texts: (kind, part, seen, weights) of the weight rows that a task has changed, in parts of PART rows; weights travel in 16 bits."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(vocabulary.value)
        model.classes, model.words = (x.copy() for x in weights.value)
        trainer = Trainer(model)
        for batch in it:
            for b, _, cls, place, before in Stream(model.v).blocks(batch.column(0)):
                trainer.learn(before, cls[b.of], place[b.of])
        for kind, what in enumerate(("classes", "words")):
            seen, w = trainer.seen[what], getattr(model, what)
            parts = np.flatnonzero(seen.reshape(-1, PART).any(axis=1))
            if len(parts):
                own = [slice(p * PART, (p + 1) * PART) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), kind)), pa.array(parts), pa.array([seen[s].tobytes() for s in own], pa.binary()), pa.array([np.where(seen[s, None] > 0, w[s], 0).astype(np.float16).tobytes() for s in own], pa.binary())], ["kind", "part", "seen", "weights"])

    return run


_PARTS = "kind long, part long, seen binary, weights binary"


def _mean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of equal parts' rows, by how often each was seen; a task holds its parts once, however many tasks have sent them."""
    by: dict[tuple, list[np.ndarray]] = {}
    for b in it:
        for kind, part, seen, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = np.frombuffer(seen, np.float32).astype(float)
            sums = np.frombuffer(weights, np.float16).reshape(PART, -1) * n[:, None]
            old = by.get((kind, part), [0, 0])
            by[kind, part] = [old[0] + n, old[1] + sums]
    for (kind, part), (n, sums) in by.items():
        mean = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part]), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["kind", "part", "seen", "weights"])


def _scored(weights, vocabulary, names: list[str]):
    """Over (id, held_out, text): a row for each text, with the words whose counts are not at hand."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        model = Model(v)
        model.classes, model.words = weights.value
        known_log = np.log10(v.counts + 1.0)
        tail_log, base = np.log10(v.tail_tokens + v.tail_words + 1.0), np.log10(v.tokens + v.distinct + 1.0)
        key = TaskContext.get().partitionId() << 40
        for batch in it:
            n = batch.num_rows
            sums = {k: np.zeros(n, t) for k, t in (("n_tokens", np.int64), ("n_known", np.int64), ("base", float), ("score", float))}
            rows, words, counts = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            for b, known, cls, place, before in Stream(v).blocks(batch.column(2)):
                add = lambda what, x, b=b: sums.__setitem__(what, sums[what] + np.bincount(b.row, x, minlength=n))
                log = np.where(known >= 0, known_log[known] if len(known_log) else 0.0, 0.0)
                add("n_tokens", None)
                add("n_known", (known >= 0)[b.of])
                add("base", (log - base)[b.of])
                within = np.where(place >= 0, 0.0, log - tail_log[np.maximum(cls - HEADS, 0)])
                add("score", model.log_probabilities(before, cls[b.of], place[b.of]) / np.log(10) + within[b.of])
                rare = np.flatnonzero(known[b.of] < 0)
                pairs, m = np.unique(b.row[rare] * len(known) + b.of[rare], return_counts=True)
                rows.append(pairs // len(known))
                words.append(b.distinct.take(pa.array(pairs % len(known))))
                counts.append(m)
            at = np.searchsorted(np.concatenate(rows), np.arange(n + 1)).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.concat_arrays(words), pa.array(np.concatenate(counts))], ["word", "n"]))
            keys = key + np.arange(n)
            key += n
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), batch.column(1), *(pa.array(sums[k].astype(np.int64) if k.startswith("n_") else sums[k]) for k in sums), tail], names)

    return run


def held_out(id_col: str):
    """Rows kept from learning: the CRC-32 of the id as text has remainder 2 by 7; null ids are neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, cls, n) of all words and ends of texts; written."""
    small_batches(texts.sparkSession)
    return written(texts.select(text_col).mapInArrow(_counted, "word string, cls long, n long").groupBy("word", "cls").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The KNOWN most frequent words (of KNOWN_BYTES at most), and sums over all; equal counts go by the word."""
    by = {r["cls"]: (r["t"], r["w"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("t"), F.count("*").alias("w")).collect()}  # a row for each tail class
    top = counts.where(F.octet_length("word") <= KNOWN_BYTES).orderBy(F.desc("n"), "word").limit(KNOWN).select("word", "n").toArrow().combine_chunks()
    words = (top["word"].chunk(0) if top.num_rows else pa.array([], pa.string())).cast(pa.string())
    n = top["n"].to_numpy()
    tokens, kinds = (np.array([by.get(k, (0, 0))[j] for k in range(HEADS, HEADS + TAILS)], np.int64) for j in (0, 1))
    total, distinct = int(tokens.sum()), int(kinds.sum())
    head = slice(0, HEADS * WIDE)
    cls = tail_class(words[head]) - HEADS
    tokens -= np.bincount(cls, n[head], minlength=TAILS).astype(np.int64)
    kinds -= np.bincount(cls, minlength=TAILS)
    return Vocabulary(words, n, total, distinct, tokens, kinds)


def train(texts: DataFrame, id_col: str, text_col: str, v: Vocabulary, rounds: int = ROUNDS):
    """The weights of classes and of words after ``rounds`` rounds, which share the texts among them by a hash of the id; every text counts in one.

    A task sends some megabytes of weights, so that small input splits are joined: SHARD bytes a task, but two tasks a core.
    """
    spark = texts.sparkSession
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = int(min(1 << 30, max(2 * spark.sparkContext.defaultParallelism, size // SHARD)))
    model, shared = Model(v), spark.sparkContext.broadcast(v)  # KNOWN words of KNOWN_BYTES at most
    for k in range(rounds):
        weights = spark.sparkContext.broadcast([model.classes, model.words])  # of fixed size
        own = texts.where(F.pmod(F.xxhash64(id_col), F.lit(rounds)) == k).select(text_col).coalesce(tasks)
        parts = own.mapInArrow(_trained(weights, shared), _PARTS).repartition("kind", "part").mapInArrow(_mean, _PARTS)
        for kind, part, seen, own in zip(*(c.to_pylist() for c in parts.toArrow().columns), strict=True):  # the weights, once
            some = np.frombuffer(seen, np.float32) > 0
            (model.classes, model.words)[kind][part * PART : (part + 1) * PART][some] = np.frombuffer(own, np.float32).reshape(PART, -1)[some]
        weights.unpersist()
    return model, shared


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; see the module.

    A text's tokens are its words, A-Z lower-cased, and one end.  base_score is that of single words' counts,
    one added to each and one slot for the unknown; score is the model's; both are sums of log10 over tokens.
    Rows that are not held out are learned from.  Null texts are empty: one end.  Null ids are scored, neither
    held out nor learned from.  Repeated rows are scored, and learned from, each.  Very long texts are read
    whole, in blocks.  Equal counts: the lesser word comes first.  Where nothing can be learned, base_score is 0.
    An empty table gives no rows; other columns are not read.  The last digits of score depend on how rows
    are dealt over tasks, since tasks train apart.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    learn = rows.where(~F.col("held") & F.col("id").isNotNull())
    counts = count_words(learn, "text")
    v = vocabulary(counts)
    model, shared = train(learn, "id", "text", v)
    weights = docs.sparkSession.sparkContext.broadcast([model.classes, model.words])
    names = ["key", "id", "held", "n_tokens", "n_known", "base", "score", "tail"]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"key long, id {kind}, held boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word: string, n: long>>"
    found = written(rows.mapInArrow(_scored(weights, shared, names), schema), "scores")
    # words outside the KNOWN most frequent are rare, so that no count meets many rows
    rare = found.select("key", F.explode("tail").alias("x")).select("key", "x.word", "x.n").join(counts.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("s"), F.sum("n").alias("m"))
    s = F.coalesce("s", F.lit(0.0))
    out = found.drop("tail").join(rare, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("m", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + s).alias("base_score"),
        (F.col("score") + s).alias("score"),
    )
    result = written(out, "lm")
    dropped(found)
    dropped(counts)
    return result
