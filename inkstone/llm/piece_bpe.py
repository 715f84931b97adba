"""SentencePiece BPE encoding and decoding with a prefix table.

For every prefix of a text there is one token that ends its encoding.  With an automaton's matches, the
tokens that end at a place are tried; the one whose preceding prefix ends in a token it is compatible
with is the prefix's last token.  Two tokens are compatible if merging would stop at just that pair:
their merges are undone, latest first, and no pair across the border may have been due earlier.  The
ids are recovered backwards, from the last token of the whole text.  The work is linear in the text.

No token has a word mark after another character, so that a text falls into chunks (marks, then
characters) which are encoded alone; a worker remembers a bounded number of chunks.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import sliced, small_batches

MARK = "▁"
#: Chunks in each of the two generations that a worker remembers, about 330 bytes each; fewer where the ids themselves
#: are made, as that is a stage among others whose workers keep what they had.
MEMO, MEMO_OF_STAGE = 400_000, 100_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Pieces:
    """Tables of a BPE model with byte fallback, dummy prefix and identity normalisation; pickled to the workers."""

    def __init__(self, model_file: str, memo: int | None = None):
        import sentencepiece

        self.room = memo or MEMO

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.surface = [b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.byte_id: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        for i in range(size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.surface[i] = bytes([int(p[1:-1], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.ids[p] = i
        if len(self.byte_id) != 256 or any(MARK in p.lstrip(MARK) or "\n" in p or any(c not in self.ids for c in p) for p in self.ids):
            raise ValueError("a BPE model with byte fallback is needed, whose tokens have word marks in front only")
        order = {s: n for n, s in enumerate(sorted({model.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = [-1] * size  # single characters are there from the beginning
        for p, i in self.ids.items():
            if len(p) > 1:
                self.rank[i] = order[model.get_score(i)]
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) > 1 and (pair := self._last_merge(p)):
                self.halves[i] = pair
                self.merged[pair] = self.rank[i]
        self._ready()

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens whose merge makes the piece, by merging the best pair, leftmost first, again and again."""
        parts = list(piece)
        while len(parts) > 2:
            due = [(self.rank[self.ids[x]], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.ids and len(x) < len(piece)]
            if not due:
                return None  # never reached by merges
            k = min(due)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def _ready(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or i in self.halves:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: list[dict[str, tuple[bytes, bytes]]] = [{}, {}]
        self.old: list[dict[str, tuple[bytes, bytes]]] = [{}, {}]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "fits", "memo", "old")}

    def __reduce__(self):
        state = self.__getstate__()
        return _kept, (hashlib.sha256(pickle.dumps(state)).hexdigest(), state)  # of all that encoding depends on

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' characters is the two tokens."""
        pair = (left, right)
        if (known := self.fits.get(pair)) is not None:
            return known
        rank, halves, limit = self.rank, self.halves, 1 << 60
        fits = True
        while True:
            if self.merged.get((left, right), 1 << 60) < limit:  # this merge was due before the one undone last
                fits = False
                break
            if rank[left] > rank[right]:
                limit, left = rank[left], halves[left][1]
            elif rank[right] >= 0:  # of equal merges the right one comes last, and the border's comes before it
                limit, right = rank[right] + 1, halves[right][0]
            else:
                break
        if len(self.fits) > self.room:
            self.fits.clear()
        self.fits[pair] = fits
        return fits

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        if (whole := self.ids.get(text)) is not None and (len(text) == 1 or whole in self.halves):
            return [whole]
        n = len(text)
        last, width = [-1] * (n + 1), [1] * (n + 1)  # of the prefix that ends before each place
        fits, compatible = self.fits, self.compatible
        for at, (token, length) in self.automaton.iter(text):
            if last[at + 1] < 0:
                before = at + 1 - length
                prior = last[before]
                if prior < 0:
                    # before it: the beginning, or a character without a token
                    ok = before == 0 or text[before - 1] not in self.ids
                else:
                    ok = fits.get((prior, token))
                    if ok is None:
                        ok = compatible(prior, token)
                if ok:
                    last[at + 1], width[at + 1] = token, length
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
                n -= width[n]
            else:
                n -= 1
                out.extend(self.byte_id[b] for b in reversed(text[n].encode("utf-8", "replace")))
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without begin and end; none for null and empty texts."""
        return self.encode_marked(MARK + text.replace(" ", MARK)) if text else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first word mark goes, bytes that are no UTF-8 become U+FFFD."""
        raw = self.decode_bytes(ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def remembered(self, chunks: list[str], marked: bool) -> list[tuple[bytes, bytes]]:
        """(ids joined by commas, decoded) of each chunk; new ones are encoded.

        Chunks are as in the text (marked), or without the word mark in front, which they have unless
        they begin with a line break; such texts stay strings of one byte a character.
        """
        memo = self.memo[marked]
        found = list(map(memo.get, chunks))
        if None in found:
            old = self.old[marked]
            if len(memo) > self.room:  # two generations: what is used again is kept
                self.old[marked], self.memo[marked] = old, memo = memo, {}
            for k, (c, x) in enumerate(zip(chunks, found, strict=True)):
                if x is None and (x := memo.get(c)) is None:
                    if (x := old.get(c)) is None:
                        ids = self.encode_marked(c if marked or c[:1] == "\n" else MARK + c)
                        x = (b",".join([b"%d" % i for i in ids]), self.decode_bytes(ids))
                    memo[c] = x
                found[k] = x
        return found

    def coded(self, text: str | None) -> Iterator[tuple[bytes, bytes]]:
        """(ids joined by commas, decoded) of each part of a text, a part a megabyte at most."""
        first = True
        for part in _parts(text or ""):
            plain = part.replace("\n", " \n")
            if "  " in plain or MARK in plain or first and plain[0] == " ":
                found = self.remembered(_CHUNK.findall((MARK if first else "") + part.replace(" ", MARK)), True)
            else:
                found = self.remembered((plain if first else plain[1:]).split(" "), False)
            raw = b"".join([x[1] for x in found])
            yield b",".join([x[0] for x in found]), raw.removeprefix(b" ") if first else raw
            first = False

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for joined, raw in self.coded(text):
            ids.update(b"," + joined if n else joined)
            decoded.update(raw)
            n += joined.count(b",") + 1
        return n, ids.hexdigest(), decoded.hexdigest()


#: The last tables of a worker, which keeps what it remembers from task to task.
_LAST: dict[int, Pieces] = {}


def _kept(key: str, state: dict) -> Pieces:
    if key not in _LAST:
        _LAST.clear()
        pieces = Pieces.__new__(Pieces)
        pieces.__setstate__(state)
        _LAST[key] = pieces
    return _LAST[key]


def _parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts that begin with a word mark, so that a long text needs little memory."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in (" ", MARK) and text[cut - 1] not in (" ", MARK)):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, round_trip) for every row; round_trip tells whether the ids decode to the text.

    Null and empty texts have no ids and decode to an empty text.  Characters that the model lacks
    become the tokens of their bytes.  Repeated rows and null ids stay.  An empty table gives no rows;
    other columns are not read.
    """
    pieces = Pieces(model_file, MEMO_OF_STAGE)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            ids, same = [], []
            for t in b.column(1).to_pylist():
                parts = list(pieces.coded(t))
                ids.append(np.fromstring(b",".join(p for p, _ in parts).decode(), np.int32, sep=",") if parts else np.zeros(0, np.int32))
                same.append(b"".join(r for _, r in parts) == (t or "").encode())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), lists, pa.array(same, pa.bool_())], [id_col, "n_tokens", "ids", "round_trip"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(tokens: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ids in ``ids_col``; null ids give an empty text."""
    pieces = Pieces(model_file)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([pieces.decode([] if i is None else list(i)) for i in ids], dtype=object)

    small_batches(tokens.sparkSession)
    return tokens.withColumn(out, text(F.col(ids_col)))


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row, through the memory of chunks.

    Null and empty texts have no ids; the digests are those of empty strings.  Very long texts are coded in
    parts of a megabyte that begin with a word mark, which changes no id.  Repeated rows and null ids stay;
    encodings are independent, so that ties can't arise.  An empty table gives no rows; other columns are
    not read.
    """
    pieces = Pieces(model_file)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            rows = [pieces.digest(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], (pa.int64(), pa.string(), pa.string())[k]) for k in range(3))], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
