"""Language identification with language-bitmask n-gram filters.

A filter is a Bloom filter whose slots are bit masks: bit l of a slot belongs to language l, so that the
AND of an n-gram's slots gives all languages that contain it at once (the bit-sliced layout of as many
Bloom filters as there are languages, 64 to a word of the mask; there is no limit to the languages).  A
language contains an n-gram if it is frequent there in comparison with the language where it is most
frequent; rare loans and quotations don't count.  A text's n-grams are looked up by vector operations,
whole texts in windows of bounded size that share their edges; the popcount of each language, corrected
for its false positives, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import dropped, small_batches, written

NGRAM = 4
#: About so many labelled documents of each language are learned from, chosen by a hash of their id.
SAMPLE = 3000
#: A language contains an n-gram seen MIN_COUNT times, at SHARE of the rate of its most frequent language at least.
MIN_COUNT, SHARE = 3, 0.2
HASHES, SLOTS_A_GRAM = 3, 12
UNKNOWN = "und"
#: Characters looked up at once; the windows of a longer text overlap, so that no n-gram is lost or made.
BLOCK = 1 << 20
#: Languages in a word of the mask.
WORD = 64

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = chr(c).isalpha()
    return out


def grams(low: str, before: str = " ") -> np.ndarray:
    """A hash of each n-gram of lower-cased letters; a word's ends count as characters, other characters as ends.

    The characters between the first and the last of an n-gram are letters, or, in short words, the
    second one is.  An n-gram begins at ``before`` and at each character of ``low`` but the last NGRAM - 1.
    """
    c = np.frombuffer((before + low).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    x = np.where(letter, c, 0).astype(np.uint64)
    n = max(0, len(x) - NGRAM + 1)
    h = x[:n].copy()
    for k in range(1, NGRAM):
        h *= _M2
        h += x[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * _M1
    return np.where(letter[1 : n + 1], h ^ (h >> np.uint64(32)), 0)  # 0: no n-gram


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, n-gram) over whole texts, in windows of bounded size; the windows make no difference."""
    part: list[int] = []
    size = 0
    low: list[str] = []

    def out() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        joined = "".join([t + " " * NGRAM for t in low])
        ends = np.cumsum([len(t) + NGRAM for t in low])
        for at in range(0, len(joined), BLOCK):
            g = grams(joined[at : at + BLOCK + NGRAM - 2], joined[at - 1] if at else " ")
            some = np.flatnonzero(g)
            yield np.array(part)[np.searchsorted(ends, some + at, "right")], g[some]

    for i, t in enumerate(texts):
        low.append(t.lower())  # before it is cut: a letter's case can depend on its neighbours
        part.append(i)
        size += len(low[-1]) + NGRAM
        if size >= BLOCK:
            yield from out()
            part, low, size = [], [], 0
    if part:
        yield from out()


class Filters:
    """The bit masks, and each language's rate of false positives."""

    def __init__(self, languages: list[str], grams: np.ndarray | None = None, masks: np.ndarray | None = None):
        """grams: n-grams; masks: for each, the words of the mask of the languages that contain it."""
        self.languages = languages
        words = max(1, -(-len(languages) // WORD))
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(len(languages), WORD))
        grams = np.zeros(0, np.uint64) if grams is None else grams
        bits = max(10, (len(grams) * SLOTS_A_GRAM - 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.zeros((words, 1 << bits), kind)
        for w in range(words if len(grams) else 0):
            for k in range(HASHES):
                np.bitwise_or.at(self.slots[w], self._slot(grams, k), masks[w].astype(kind))
        fill = np.array([((self.slots[k // WORD] & kind(1 << k % WORD)) != 0).mean() for k in range(len(languages))])
        self.false = fill**HASHES

    def _slot(self, g: np.ndarray, k: int) -> np.ndarray:
        step = (g >> np.uint64(32)) | np.uint64(1)
        return ((g + np.uint64(k) * step) & self.mask).astype(np.int64)

    def containing(self, g: np.ndarray) -> Iterator[np.ndarray]:
        """The words of the mask of the languages that contain each n-gram, one word of all after the other."""
        at = [self._slot(g, k) for k in range(HASHES)]
        for slots in self.slots:
            out = slots[at[0]]
            for x in at[1:]:
                out = out & slots[x]
            yield out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and the popcount of each language."""
        total, by = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        for of, g in blocks(texts):
            total += np.bincount(of, minlength=len(texts))
            for w, m in enumerate(self.containing(g)):
                for k in range(w * WORD, min(len(self.languages), (w + 1) * WORD)):
                    by[:, k] += np.bincount(of[(m & m.dtype.type(1 << k % WORD)) != 0], minlength=len(texts))
        return total, by

    def corrected(self, total: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.maximum(0, (by - total[:, None] * self.false) / (1 - self.false))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: its share of all languages' corrected popcounts."""
        total, by = self.counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        true = self.corrected(total, by)
        best = true.argmax(axis=1)
        score = true.max(axis=1) / np.maximum(true.sum(axis=1), 1e-9)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], np.where(total > 0, np.clip(score, 0, 1), 0.0)


def _tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (language number, text): (language number, n-gram, count) of each batch."""
    for b in it:
        lang = b.column(0).to_numpy()
        for of, g in blocks(b.column(1).to_pylist()):
            for k in np.unique(lang[of]):
                x, n = np.unique(g[lang[of] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k)), pa.array(x.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the CRC-32 of the id as text is divisible by 5; null ids are neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Filters:
    """Filters from about ``sample`` rows of each language, chosen by a hash of their ids; null texts, labels and ids are left out.

    The n-grams that some language contains are brought to the driver: they come from ``sample`` rows of
    each language at most, however large the table is.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    n = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())
    languages = [name for name, _ in n]
    if not n:
        return Filters([])
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(name, k, int(min(1.0, sample / c) * (1 << 20))) for k, (name, c) in enumerate(n)], "name string, k long, share long")
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("name")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share"))  # a row for each language
    tally = chosen.select("k", "text").mapInArrow(_tally, "lang long, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = written(tally, "grams")  # read twice below
    total = counts.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(total), F.col("lang") == F.col("l")).select("gram", "lang", "n", (F.col("n") / F.col("total")).alias("rate"))  # a row for each language
    by = rate.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("own"))
    own = F.filter("own", lambda x: (x["n"] >= MIN_COUNT) & (x["rate"] >= SHARE * F.col("top")))
    found = by.select("gram", F.transform(own, lambda x: x["lang"]).alias("langs")).where(F.size("langs") > 0).toArrow()
    dropped(counts)
    langs = found["langs"].combine_chunks()
    lang = langs.flatten().to_numpy()
    row = np.repeat(np.arange(len(langs)), np.diff(langs.offsets.to_numpy()))
    masks = np.zeros((-(-len(languages) // WORD), len(langs)), np.uint64)
    np.bitwise_or.at(masks, (lang // WORD, row), np.uint64(1) << (lang % WORD).astype(np.uint64))
    return Filters(languages, found["gram"].combine_chunks().to_numpy().view(np.uint64), masks)


def predict_languages(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added.

    ``und`` and 0 for null texts, texts without a letter, and where nothing was learned.  A text none of
    whose n-grams is known gets the first language and score 0; of equal languages the first by name
    wins.  All rows stay, repeated ones too; columns named like the new ones are replaced.
    """
    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        lang, score = filters.predict([t or "" for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    small_batches(docs.sparkSession)
    return docs.drop("lang_pred", "score").withColumn("_lang", predicted(F.col(text_col))).select("*", "_lang.lang_pred", "_lang.score").drop("_lang")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; rows that are not held out teach the filters.

    Null texts and texts without a letter are ``und`` with score 0, and all texts are where nothing can be
    learned.  Very long texts count whole.  Null ids are neither held out nor learned from.  Repeated rows
    stay; a repeated id is learned from with each of its rows.  Ties: the first language by name.  An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"), F.col(lang_col).alias("_label"))
    filters = learn(rows.where(~held_out(id_col)), id_col, "_text", "_label", sample)
    out = predict_languages(rows.select(id_col, "_text"), filters, "_text")
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those in which no language is found.

    These are null texts, texts without letters, and texts of which no language contains more n-grams than
    its false positives explain (score 0): letters of a script or a jumble that nothing was learned of.
    Where nothing can be learned at all only the first two go.  Other rows stay as they are, repeated ones,
    null ids and null labels too; an empty table gives no rows.
    """
    filters = learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col, sample)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("_text"))
    found = predict_languages(own, filters, "_text")
    keep = F.col("score") > 0 if filters.languages else F.coalesce(F.col("_text").rlike(r"\p{IsAlphabetic}"), F.lit(False))
    return found.where(keep).select("_row.*")
