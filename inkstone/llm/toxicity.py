"""Toxicity by a linear-chain conditional random field.

Documents are labelled, tokens are not, so that the tokens' states are hidden: a clean document's tokens
are all clean, and of a toxic document's at least one is toxic, whichever it is.  The field (two states;
features of the token and of it with the one before, transitions) is fitted by gradient
ascent on the likelihood of that, P(all clean) for clean documents and 1 - P(all clean) for toxic ones,
both from forward-backward sums; which tokens of a toxic document are taken for toxic is what the field
itself expects.  A document's score is a logistic function of its tokens' marginals: how many are
expected to be toxic, the surest one, and the length.  Offsets of the tokens whose marginal is MARK or
more are the offending spans.

Features are words and their beginnings and ends, and pairs of words, that are likelier in toxic documents
of a bounded sample; they are counted where the sample is, and only the places of features come to the
driver, never a text.  Documents are cut into chains of CHAIN tokens for vector operations; messages are
carried over the cuts, so that the sums are those of the whole document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import broadcast_if_small, dropped, sliced, small_batches, written

#: About so many rows of each label are fitted to, whole, chosen by a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
#: A feature is in so many toxic documents of the sample, and so many times likelier in those.
MIN_DOCUMENTS, MIN_RATIO = 4, 10.0
#: Tokens of a chain; a document is a row of chains.
CHAIN = 128
MARK = 0.5
#: Characters of texts that are scored together; a longer text is scored alone.
BLOCK = 4_000_000
_SPACE = " \t\n\v\f\r"
_TOKEN = re.compile(f"[^{_SPACE}]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_of(token: str) -> str:
    return _EDGE.sub("", token.lower())


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 8 letters and its ends of 4 and 5."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in range(3, min(8, n - 1) + 1)), *("$" + word[-k:] for k in (4, 5) if k < n)]


# ---------------------------------------------------------------- chains
class Chains:
    """Documents of ``n`` tokens each as rows of chains, and the sums over them."""

    def __init__(self, n: np.ndarray, chain: int | None = None):
        self.n, self.length = n, chain or CHAIN
        rows = -(-n // self.length)
        self.start = np.cumsum(rows) - rows  # of each document
        total = int(rows.sum())
        offsets = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(offsets, n)
        self.row, self.col = np.repeat(self.start, n) + place // self.length, place % self.length
        self.valid = np.zeros((total, self.length), bool)
        self.valid[self.row, self.col] = True
        self.document = np.repeat(np.arange(len(n)), rows)
        self.level = np.arange(total) - np.repeat(self.start, rows)  # number of a row in its document
        self.levels = int(rows.max(initial=0))
        order = np.argsort(self.level, kind="stable")
        ends = np.searchsorted(self.level[order], np.arange(self.levels + 1))
        self.at_level = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def spread(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(self.valid.shape)
        out[self.row, self.col] = tokens
        return out

    def _over(self, up: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For each row the matrix (state after, state before) that carries the forward message over it."""
        m = np.zeros((2, 2, len(up)))
        m[0, 0] = m[1, 1] = 1
        for k in range(self.length):
            new = np.einsum("ij,ikn->jkn", t, m)
            if k == 0:
                new[:, :, self.level == 0] = m[:, :, self.level == 0]  # nothing stands before a document
            new[1] *= up[:, k]
            new /= new.sum(axis=(0, 1))
            m = np.where(self.valid[:, k], new, m)
        return m

    def messages(self, e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
        """(forward with the place's potential, backward without) probabilities of the toxic state, by place and row; potentials and transitions as factors; the forward message before each row."""
        total = len(e)
        up, t = np.exp(np.clip(e, -30, 30)).T.copy(), np.exp(moves)
        before, after = np.full(total, 0.5), np.full(total, 0.5)  # messages at the ends of rows
        if self.levels > 1:
            m = self._over(up.T, t)
            for rows in self.at_level[1:]:
                prior = before[rows - 1]
                one, zero = m[1, 0, rows - 1] * (1 - prior) + m[1, 1, rows - 1] * prior, m[0, 0, rows - 1] * (1 - prior) + m[0, 1, rows - 1] * prior
                before[rows] = one / (one + zero)
            for rows in reversed(self.at_level[1:]):
                later = after[rows]
                one, zero = m[0, 1, rows] * (1 - later) + m[1, 1, rows] * later, m[0, 0, rows] * (1 - later) + m[1, 0, rows] * later
                after[rows - 1] = one / (one + zero)
        f, b = np.empty((self.length, total)), np.empty((self.length, total))
        for k in range(self.length):
            prior = before if k == 0 else f[k - 1]
            one, zero = (t[0, 1] * (1 - prior) + t[1, 1] * prior) * up[k], t[0, 0] * (1 - prior) + t[1, 0] * prior
            f[k] = one / (one + zero)
            if k == 0:
                f[0] = np.where(self.level == 0, up[0] / (1 + up[0]), f[0])
        b[-1] = after
        for k in range(self.length - 2, -1, -1):
            u, v = up[k + 1] * b[k + 1], 1 - b[k + 1]
            one, zero = t[1, 0] * v + t[1, 1] * u, t[0, 0] * v + t[0, 1] * u
            b[k] = np.where(self.valid[:, k + 1], one / (one + zero), after)
        return f, b, up, t, before

    def marginals(self, e: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each token."""
        if not len(e):
            return np.zeros(0)
        f, b, *_ = self.messages(e, moves)
        return self._posterior(f, b)[self.col, self.row]

    @staticmethod
    def _posterior(f: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, zero = f * b, (1 - f) * (1 - b)
        return one / (one + zero)

    def sums(self, e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals by row and place, expected transitions of each row (from, to), and each document's log P(all clean)."""
        f, b, up, t, before = self.messages(e, moves)
        p = self._posterior(f, b).T * self.valid
        pairs, clean = np.zeros((2, 2, len(e))), np.zeros(len(e))
        for k in range(self.length):
            valid = self.valid[:, k]
            moved = valid & (self.level > 0) if k == 0 else valid
            prior = before if k == 0 else f[k - 1]
            one, zero = up[k] * b[k], 1 - b[k]
            joint = np.array([[(1 - prior) * t[0, 0] * zero, (1 - prior) * t[0, 1] * one], [prior * t[1, 0] * zero, prior * t[1, 1] * one]])
            pairs += np.where(moved, joint / joint.sum(axis=(0, 1)), 0)
            stays = np.where(moved, t[0, 0] * zero / (t[0, 0] * zero + t[0, 1] * one), zero / (zero + one))
            clean += np.where(valid, np.log(np.maximum(stays, 1e-300)), 0)
        return p, pairs, np.bincount(self.document, clean, len(self.n))


# ---------------------------------------------------------------- the field
class Field:
    """Weights of features, bias and transitions (from, to), as log potentials of the toxic state or the pair; weights of the document's measures."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias = -6.0
        self.moves = np.zeros((2, 2))
        self.document = np.array([-3.0, 1.0, 1.0, 0.0])

    def ready(self) -> None:
        """A word has a feature only if its first three or its last four letters have one."""
        self.short = {f[1:] for f in self.weights if f[0] == "="}
        self.heads = {f[1:4] for f in self.weights if f[0] == "^"}
        self.tails = {f[-4:] for f in self.weights if f[0] == "$"}
        pairs = [(f[1:].split(" "), w) for f, w in self.weights.items() if f[0] == "&"]
        self.left = {x: k for k, x in enumerate(sorted({a for (a, _), _ in pairs}))}
        self.right = {x: k for k, x in enumerate(sorted({b for (_, b), _ in pairs}))}
        codes = sorted((self.left[a] * len(self.right) + self.right[b], w) for (a, b), w in pairs)
        self.codes, self.coded = np.array([c for c, _ in codes], np.int64), np.array([w for _, w in codes])

    def own(self, word: str) -> float:
        """Potential by the word alone."""
        if word in self.short or word[:3] in self.heads or word[-4:] in self.tails:
            return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return self.bias

    def potentials(self, tokens: list[str], at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of all tokens of documents of ``n`` tokens each, which are numbers of different tokens."""
        words = list(map(word_of, tokens))
        e = np.array([self.own(w) for w in words])[at] if words else np.zeros(0)
        inner = np.ones(len(at), bool)  # not the first of a document
        inner[(np.cumsum(n) - n)[n > 0]] = False
        places = np.flatnonzero(inner)
        if len(places) and len(self.codes):
            left, right = np.array([self.left.get(w, -1) for w in words]), np.array([self.right.get(w, -1) for w in words])
            places = places[(left[at[places - 1]] >= 0) & (right[at[places]] >= 0)]
            code = left[at[places - 1]] * len(self.right) + right[at[places]]
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            e[places] += np.where(self.codes[k] == code, self.coded[k], 0.0)
        return e

    # ------------------------------------------------------------ scoring
    def measures(self, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected toxic tokens, surest, length in logs) of each document, and the tokens' marginals."""
        chains = Chains(n)
        p = chains.marginals(chains.spread(e), self.moves)
        out = np.zeros((len(n), 3))
        some = n > 0
        if some.any():
            starts = (np.cumsum(n) - n)[some]
            out[some, 0] = np.log1p(np.add.reduceat(p, starts))
            out[some, 1] = np.maximum.reduceat(p, starts)
        out[:, 2] = np.log1p(n) / 10
        return out, p

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > BLOCK:
                out.append(self._scores(part))
                part, size = [], 0
        if part:
            out.append(self._scores(part))
        return np.concatenate([*out, np.zeros(0)])

    def _scores(self, texts: list[str]) -> np.ndarray:
        stripped = [t.strip(_SPACE) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([t for t in stripped if t], pa.large_string()))
        n = np.zeros(len(texts), np.int64)
        n[[bool(t) for t in stripped]] = np.diff(lists.offsets.to_numpy())
        tokens = lists.values.dictionary_encode()
        e = self.potentials(tokens.dictionary.to_pylist(), tokens.indices.to_numpy(), n)
        return self.logistic(self.measures(e, n)[0])

    def logistic(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.document[0] + measures @ self.document[1:], -30, 30)))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the toxic tokens, in characters."""
        at = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        n = np.array([len(at)])
        _, p = self.measures(self.potentials([text[a:b] for a, b in at], np.arange(len(at)), n), n)
        return [(a, b, float(x)) for (a, b), x in zip(at, p, strict=True) if x >= MARK]


# ---------------------------------------------------------------- fitting
def _words(text: str) -> list[str]:
    return list(map(word_of, _TOKEN.findall(text)))


def _document_features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (toxic, text): (toxic, feature) for the different features of each document."""
    for b in sliced(it, 200):
        toxic, found = [], []
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = _words(text)
            own = {f for w in set(words) if w for f in features(w)} | {f"&{a} {c}" for a, c in set(zip(words, words[1:], strict=False)) if a and c}
            toxic += [y] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.bool_()), pa.array(found, pa.string())], ["toxic", "feature"])


def _places(index: dict[str, int]):
    """Over (toxic, text): (toxic, n, at, feature): tokens, and the places of features."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 200):
            rows = []
            for text in b.column(1).to_pylist():
                words = _words(text)
                of = {w: [index[f] for f in features(w) if f in index] for w in set(words)}
                at, found = [], []
                for k, w in enumerate(words):
                    own = of[w]
                    if k and (pair := f"&{words[k - 1]} {w}") in index:
                        own = [*own, index[pair]]
                    at += [k] * len(own)
                    found += own
                rows.append((len(words), at, found))
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *lists], ["toxic", "n", "at", "feature"])

    return run


def fit(names: list[str], n: np.ndarray, toxic: np.ndarray, of: np.ndarray, at: np.ndarray, feature: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 2e-5) -> Field:
    """A field from documents of ``n`` tokens with labels, and the features (document, place, number of the name) in them.

    Without labels of both kinds it finds nothing.
    """
    field = Field()
    if not toxic.any() or toxic.all():
        field.document = np.array([30.0 if len(toxic) and toxic.all() else -30.0, 0, 0, 0])
        field.ready()
        return field
    chains = Chains(n)
    cell = (chains.start[of] + at // CHAIN) * CHAIN + at % CHAIN
    moves_in = np.bincount(chains.document, (chains.valid & ~((chains.level == 0)[:, None] & (np.arange(CHAIN) == 0))).sum(axis=1), len(n))
    theta = np.concatenate([np.zeros(len(names)), [field.bias], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        e = theta[len(names)] + np.bincount(cell, theta[feature], chains.valid.size).reshape(chains.valid.shape)
        p, pairs, clean = chains.sums(e, moves)
        # the gradient of log P(all clean), times what the document's likelihood makes of it
        share = np.where(toxic, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), 1.0)
        by_row = share[chains.document]
        rest = -p * by_row[:, None]
        moved = -(pairs * by_row).sum(axis=2)
        moved[0, 0] += share @ moves_in
        g = np.concatenate([np.bincount(feature, rest.ravel()[cell], len(names)), [rest.sum()], moved.ravel()]) / len(n)
        g[: len(names)] -= decay * theta[: len(names)]
        g[-4:] -= decay * theta[-4:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights, field.bias, field.moves = dict(zip(names, theta[: len(names)].tolist(), strict=True)), float(theta[len(names)]), theta[-4:].reshape(2, 2).copy()
    field.ready()
    e = theta[len(names)] + np.bincount(cell, theta[feature], chains.valid.size).reshape(chains.valid.shape)
    field.document = _calibrated(field.measures(e[chains.row, chains.col], n)[0], toxic)
    return field


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the document's measures, by Newton steps with a little ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(4)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(4)
        beta += np.linalg.solve(h, x.T @ (y - q) - 1e-2 * beta)
    return beta


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the CRC-32 of the id as text is divisible by 5; null ids are neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field from the labelled documents that are not held out; null ids, texts and labels are left out, labels other than 0 are toxic."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).alias("toxic")).dropna().where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = dict(known.groupBy("toxic").count().collect())
    share = lambda toxic, most: F.lit(int(min(1.0, most / max(1, n.get(toxic, 0))) * (1 << 20)))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.when(F.col("toxic"), share(True, SAMPLE_TOXIC)).otherwise(share(False, SAMPLE_CLEAN)))
    known = written(known, "labelled")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).dropna().join(broadcast_if_small(known), F.col("doc") == F.col("id"))
    sample = written(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "sample")  # repeated ids don't lengthen it
    sizes = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    seen = sample.mapInArrow(_document_features, "toxic boolean, feature string").groupBy("feature").agg(F.sum(F.col("toxic").cast("long")).alias("c1"), F.sum((~F.col("toxic")).cast("long")).alias("c0"))
    seen = seen.where((F.col("c1") >= MIN_DOCUMENTS) & ((F.col("c1") + 0.5) / max(1, n1) >= MIN_RATIO * (F.col("c0") + 0.5) / max(1, n0)))
    chosen = sorted(r["feature"] for r in seen.collect()) if n1 and n0 else []  # of the words of SAMPLE_TOXIC rows
    words = {f[1:] for f in chosen if f[0] == "="}
    names = [f for f in chosen if f[0] != "&" or not words.intersection(f[1:].split(" "))]
    small_batches(docs.sparkSession)
    t = sample.mapInArrow(_places({f: k for k, f in enumerate(names)}), "toxic boolean, n long, at array<int>, feature array<int>").toArrow()
    dropped(sample)
    dropped(known)
    size = t["n"].to_numpy()
    at, feature = (t[c].combine_chunks() for c in ("at", "feature"))
    of = np.repeat(np.arange(len(size)), np.diff(at.offsets.to_numpy()))
    return fit(names, size, t["toxic"].to_numpy(), of, at.flatten().to_numpy(), feature.flatten().to_numpy())


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row; null and empty texts are scored as texts without tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            score = field.scores(pc.fill_null(b.column(1), "").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, score double, predicted int")


def toxic_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, probability) of every toxic token of every row: offsets in characters, the end excluded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            found = [(i, *s) for i, t in enumerate(b.column(1).to_pylist()) for s in field.spans(t or "")]
            ids = b.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.float64())], [id_col, "start", "end", "probability"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, start long, end long, probability double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Repeated rows and null ids stay; of repeated labels of an id any toxic one counts, and of repeated ids
    the smallest text is learned from.  Null and empty texts have no tokens; very long ones count whole.
    A score of just 0.5 is toxic.  Empty tables: no rows, or without labels of both kinds a score near 0
    for all (near 1 where all labels are toxic).  Other columns are not read.
    """
    field = learn(docs, labels, id_col, text_col, label_col)
    return score_documents(docs, field, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
