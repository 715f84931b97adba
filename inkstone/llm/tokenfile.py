"""Token ids in a file format coded by a static range asymmetric numeral system (rANS).

A file's rows are parts, in ascending document order.  The blocks of a part share one frequency table,
counted over all ids of the part and normalised to 2**PRECISION.  A block holds whole documents; its
ids are dealt over interleaved lanes, each a rANS state of its own, so that a step codes one id of every
lane in one vector operation.  The lanes' words stand in one stream in the order in which decoding reads
them.  Checkpoints (the lanes' states and the stream's place every CHECKPOINT steps) let a block be
decoded from its middle; each block has a CRC-32 of its ids and of its bytes, and decodes alone, given
the part's table.

    table   uint32 n, n x uint16 id, n x uint32 frequency
    payload uint32 ids, uint32 lanes, uint32 checkpoints, uint32 words,
            checkpoints x (uint32 place, lanes x uint64 state), words x uint32
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import sliced, written

END_ID = 2
PRECISION = 18
LANES = 1024
CHECKPOINT = 256
#: Ids after which a block ends with its document, and a part.
BLOCK_IDS, PART_IDS = 1 << 19, 1 << 22
#: Words that a worker remembers in each of two generations, and characters that are split at once.
MEMO, SPLIT = 600_000, 4_000_000
#: Parts whose places (16 bytes each) are broadcast; more are joined.
BROADCAST_PARTS = 500_000
_LOW = 1 << 31  # a state is at least this, and less than 2**63


# ---------------------------------------------------------------- coding
def normalised(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to 2**precision, 1 at least for whatever occurs."""
    total, size = int(counts.sum()), 1 << precision
    if (counts > 0).sum() > size:
        raise ValueError(f"more than {size} different ids in a part")
    if not len(counts):
        return counts
    f = np.where(counts > 0, np.maximum(1, counts * size // max(total, 1)), 0)
    while (over := int(f.sum()) - size) != 0:
        if over < 0:
            f[int(f.argmax())] -= over
        else:  # take from those that have more than one, in proportion
            spare = np.maximum(f - 1, 0)
            cut = np.minimum(spare, (spare * over + spare.sum() - 1) // spare.sum())
            cut[np.cumsum(cut) - cut >= over] = 0
            last = np.flatnonzero(cut)[-1]
            cut[last] -= max(0, int(cut.sum()) - over)
            f -= cut
    return f


class Table:
    """A part's ids in ascending order, their frequencies, and the tables to code and decode by."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        self.ids, self.frequencies = ids.astype(np.int64), frequencies.astype(np.uint64)
        self.starts = np.cumsum(self.frequencies) - self.frequencies
        self.slot: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        return cls(values, normalised(counts[values]))

    def dumps(self) -> bytes:
        return struct.pack("<I", len(self.ids)) + self.ids.astype("<u2").tobytes() + self.frequencies.astype("<u4").tobytes()

    @classmethod
    def loads(cls, data: bytes) -> Table:
        n = struct.unpack_from("<I", data)[0]
        return cls(np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<u4", n, 4 + 2 * n))

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and start of every id up to the largest."""
        f, c = np.zeros((2, int(self.ids[-1]) + 1 if len(self.ids) else 0), np.uint64)
        f[self.ids], c[self.ids] = self.frequencies, self.starts
        return f, c

    def slots(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequencies.astype(np.int64))
        return self.slot


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """Payload of a block.  Ids are coded backwards, so that they are decoded forwards."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    by_id = table.by_id()
    freq, start = by_id[0][ids], by_id[1][ids]
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    so_far = 0
    room, shift, word = np.uint64(63 - PRECISION), np.uint64(PRECISION), np.uint64(32)
    for k in range(-(-n // lanes) - 1, -1, -1):
        f, c = freq[k * lanes : (k + 1) * lanes], start[k * lanes : (k + 1) * lanes]
        own = state[: len(f)]
        full = np.flatnonzero(own >= (f << room))
        if len(full):
            words.append(own[full].astype(np.uint32)[::-1])
            so_far += len(full)
            own[full] >>= word
        q = own // f
        own += c + q * ((np.uint64(1) << shift) - f)
        if k % CHECKPOINT == 0:
            marks.append((so_far, state.astype("<u8").tobytes()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    head = struct.pack("<IIII", n, lanes, len(marks), so_far)
    return head + b"".join(struct.pack("<I", so_far - at) + s for at, s in reversed(marks)) + stream.astype("<u4").tobytes()


def decode_block(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block; of the checkpoints from ``first`` to before ``last`` if given."""
    n, lanes, marks, words = struct.unpack_from("<IIII", payload)
    if not n:
        return np.zeros(0, np.int64)
    size = 4 + 8 * lanes
    stream = np.frombuffer(payload, "<u4", words, 16 + marks * size)
    place = struct.unpack_from("<I", payload, 16 + first * size)[0]
    state = np.frombuffer(payload, "<u8", lanes, 20 + first * size).astype(np.uint64)
    steps = -(-n // lanes)
    slots, out = table.slots(), []
    mask, low, shift, word = np.uint64((1 << PRECISION) - 1), np.uint64(_LOW), np.uint64(PRECISION), np.uint64(32)
    for k in range(first * CHECKPOINT, steps if last is None else min(steps, last * CHECKPOINT)):
        own = state[: min(lanes, n - k * lanes)]
        part = own & mask
        symbol = slots[part.view(np.int64)]
        out.append(symbol)
        own >>= shift
        own *= table.frequencies[symbol]
        own += part - table.starts[symbol]
        short = np.flatnonzero(own < low)
        if len(short):
            own[short] = (own[short] << word) | stream[place : place + len(short)]
            place += len(short)
    return table.ids[np.concatenate(out)] if out else np.zeros(0, np.int64)


# ---------------------------------------------------------------- tokenizing
#: Stands before a text's first word, and behind a chunk that is cut into words; texts with either are left to the library.
START, GAP = "\x1b", "\x1c"
_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
_MARKS = "\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u203e\u20ac"
#: Texts of these characters are split here; what is a letter, a digit or white space in others is left to the library.
_OTHER = re.compile(f"[^\x00-\x1b\x20-\x7f{_LATIN}{_MARKS}]")
#: The splitting of byte-level BPE (fixed pattern of the public tokenizer) for Latin letters.
_SPLIT = re.compile(rf"{GAP}|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|[\t-\r ]+(?!\S)|[\t-\r ]+")


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Memo:
    """A bounded memory of two generations: what is used again is kept."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def of(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.new.get, keys))
        if None in found:
            if len(self.new) > MEMO:
                self.old, self.new = self.new, {}
            new, old = self.new, self.old
            for k, x in enumerate(found):
                if x is None:
                    key = keys[k]
                    if (x := new.get(key)) is None:
                        x = new[key] = old.get(key) or self.make(key)
                    found[k] = x
        return found


class _Library:
    """The tokenizers library's model, and the ids of the words that were asked for."""

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("a tokenizer with at most 65,536 ids is needed")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in json.loads(data)["added_tokens"]) or "(?!)")
        self.letters = dict(enumerate(_byte_letters()))
        self.words = Memo(self._word)

    def _word(self, word: str) -> bytes:
        """Ids of a word by the model, which reads letters that stand for bytes."""
        if word == GAP:
            return b""
        if word.isascii():
            seen = word.replace(" ", self.letters[32]) if word.isprintable() else word.translate(self.letters)
        else:
            seen = word.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()


#: The last library of a worker, which keeps its words from task to task.
_LAST: dict[str, _Library] = {}


class Words:
    """Ids of texts by the tokenizers library, whose model is asked once for each word that a worker remembers."""

    def __init__(self, data: str):
        self.data = data

    def library(self) -> _Library:
        if self.data not in _LAST:
            _LAST.clear()
            _LAST[self.data] = _Library(self.data)
        return _LAST[self.data]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 16-bit integers; none for null and empty texts.

        A word, with the space in front, is encoded alone by this kind of tokenizer.  Texts with runs of
        spaces and with other than Latin letters, and very long ones, are given to the library whole.
        """
        library = self.library()
        out = [b""] * len(texts)
        part: list[tuple[int, str]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > SPLIT or "  " in t or START in t or _OTHER.search(t) or library.special.search(t):
                out[i] = array("H", library.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
                continue
            part.append((i, t))
            size += len(t)
            if size > SPLIT:
                self._encode(part, out)
                part, size = [], 0
        if part:
            self._encode(part, out)
        return out

    def _encode(self, part: list[tuple[int, str]], out: list[bytes]) -> None:
        """Texts are cut at spaces, each different chunk is cut into words once, and the words are looked up."""
        lists = pc.split_pattern(pa.array([START + t for _, t in part], pa.string()), " ")
        chunks = lists.values.dictionary_encode()
        different = pa.ListArray.from_arrays(pa.array([0, len(chunks.dictionary)], pa.int32()), chunks.dictionary)
        words = _SPLIT.findall(f" {pc.binary_join(different, GAP + ' ')[0]}{GAP}".replace(" " + START, ""))
        ends = np.flatnonzero(np.fromiter(map(GAP.__eq__, words), bool, len(words))) + 1
        ids = pa.array(self.library().words.of(words), pa.binary())
        of_chunk = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids), b"")
        for (i, _), x in zip(part, pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of_chunk.take(chunks.indices)), b"").to_pylist(), strict=True):
            out[i] = x


# ---------------------------------------------------------------- files
_BLOCK = pa.struct([("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("bytes_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_PART_SCHEMA = "part long, n_ids long, frequencies binary, blocks array<struct<n_ids: long, ids_crc32: long, bytes_crc32: long, doc_ids: array<long>, lengths: array<long>, payload: binary>>"
#: What numbers of parts a task has: more than it can fill.
_PARTS_A_TASK = 1 << 24


def _part(number: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u2")
    table, at, blocks = Table.of(ids), 0, []
    group: list[tuple[int | None, int]] = []
    size = 0
    for k, (i, d) in enumerate(docs):
        group.append((i, len(d) // 2))
        size += len(d) // 2
        if size >= BLOCK_IDS or k == len(docs) - 1:
            own = ids[at : at + size]
            payload = encode_block(own, table)
            blocks.append({"n_ids": size, "ids_crc32": zlib.crc32(own.astype("<u4").tobytes()), "bytes_crc32": zlib.crc32(payload), "doc_ids": [g[0] for g in group], "lengths": [g[1] for g in group], "payload": payload})
            at, group, size = at + size, [], 0
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)]), pa.array([table.dumps()], pa.binary()), pa.array([blocks], pa.list_(_BLOCK))], ["part", "n_ids", "frequencies", "blocks"])


def _write(words: Words, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * _PARTS_A_TASK
        end = struct.pack("<H", end_id)
        docs: list[tuple[int | None, bytes]] = []
        size = 0
        for b in sliced(it):
            for i, d in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                docs.append((i, d + end))
                size += len(docs[-1][1]) // 2
                if size >= PART_IDS:
                    yield _part(number, docs)
                    number, docs, size = number + 1, [], 0
        if docs:
            yield _part(number, docs)

    return run


def write_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts to files in the shared folder, and return the table of parts there.

    Documents stand in ascending order of their ids, nulls first; of repeated ids null texts first, then the
    shorter, then by a hash of the text, then as they stand in the table, so that not even the rows of one id
    need to fit one task.  Null and empty texts are their end id alone; very long texts are one document of
    one block.  An empty table has no parts.  Other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        words = Words(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.length("text"), F.xxhash64("text"), "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    return written(dealt.mapInArrow(_write(words, end_id), _PART_SCHEMA), "tokens")


def part_starts(parts: DataFrame) -> DataFrame:
    """(part, start): the ids of all parts before each, by sums over the tasks that wrote them and then within each."""
    own = parts.select("part", "n_ids", F.floor(F.col("part") / _PARTS_A_TASK).alias("task"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # two numbers for each writing task
    base = own.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return own.join(base, "task").select("part", (F.col("base") + F.col("inner")).alias("start"))


def _decoded(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list, np.ndarray]]:
    """(start, ids, document ids, lengths) of each block; its checksums are verified."""
    for b in it:
        for k in range(b.num_rows):
            part, frequencies, blocks, start = (b.column(c)[k].as_py() for c in range(4))
            table = Table.loads(frequencies)
            for x in blocks:
                if zlib.crc32(x["payload"]) != x["bytes_crc32"]:
                    raise ValueError(f"part {part}: a block's bytes don't have their checksum")
                ids = decode_block(x["payload"], table).astype("<u4")
                if zlib.crc32(ids.tobytes()) != x["ids_crc32"]:
                    raise ValueError(f"part {part}: a block's ids don't have their checksum")
                yield start, ids, x["doc_ids"], np.array(x["lengths"], np.int64)
                start += len(ids)


def _read_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for start, ids, docs, n in _decoded(it):
        ends = np.cumsum(n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view("<i4")))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), lists], ["id", "start", "n_tokens", "ids"])


def _read_crc(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for start, ids, docs, n in _decoded(it):
        ends = np.cumsum(n)
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def _read(parts: DataFrame, how, schema: str, id_col: str) -> DataFrame:
    starts = part_starts(parts)
    if parts.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    return parts.join(starts, "part").select("part", "frequencies", "blocks", "start").mapInArrow(how, schema).withColumnRenamed("id", id_col)


def read_tokens(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files."""
    return _read(parts, _read_ids, "id long, start long, n_tokens long, ids array<int>", id_col)


def read_checksums(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files; the CRC-32 is of its ids as uint32."""
    return _read(parts, _read_crc, "id long, start long, n_tokens long, ids_crc32 long", id_col)
