"""Terms of whole texts, found in blocks of bounded size by array operations on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once; a longer text is cut where a term ends.
BLOCK = 2 << 20
_POWERS = np.full(256, 0x100000001B3, np.uint64).cumprod()
_SPACE, _END = 32, b" \n "


def table(separators: bytes) -> bytes:
    """A translation of bytes: separators become spaces, A-Z lower case; bytes of characters beyond ASCII stay."""
    return bytes(_SPACE if c in separators else ord(chr(c).lower()) if c < 128 else c for c in range(256))


#: Words: all but ASCII white space belongs to one.
WORDS = table(bytes([32, *range(9, 14)]))
#: Letters and characters beyond ASCII; the same with digits.
LETTERS = table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LETTERS_DIGITS = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Terms:
    """Terms of a block: row[i] and of[i] are the text and the number among ``distinct`` of the i-th; ``end`` marks those that end a text."""

    row: np.ndarray
    of: np.ndarray
    distinct: pa.StringArray
    end: int  # number of the end among ``distinct``, or -1


def _cut(data: bytes, first: int) -> tuple[Terms, int]:
    raw = np.frombuffer(data, np.uint8)
    full = raw != _SPACE
    edge = np.flatnonzero(full[1:] != full[:-1]) + 1  # data begins and ends with a space
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[full])).dictionary_encode()
    of = coded.indices.to_numpy()
    closes = raw[starts] == 10  # all other line feeds have become spaces
    at = np.flatnonzero(closes)
    row = np.cumsum(closes) - closes + first
    return Terms(row, of, coded.dictionary, int(of[at[0]]) if len(at) else -1), first + len(at)


def blocks(texts: pa.Array, how: bytes, size: int = BLOCK) -> Iterator[Terms]:
    """The terms of texts in order, each text followed by one end; null texts have the end alone."""
    held: list[bytes] = []
    n = row = 0

    def out() -> Iterator[Terms]:
        nonlocal held, n, row
        cut, row = _cut(b" " + b"".join(held) + b" ", row)
        held, n = [], 0
        if len(cut.of):
            yield cut

    for t in texts.cast(pa.binary()).to_pylist():
        t = (t or b"").translate(how)
        while n + len(t) > size and len(t):
            room = max(0, size - n)
            at = t.find(b" ", room)
            if at < 0:
                break
            held.append(t[:at])
            t = t[at:]
            yield from out()
        held += [t, _END]
        n += len(t) + len(_END)
        if n >= size:
            yield from out()
    if held:
        yield from out()


def hashes(words: pa.StringArray) -> np.ndarray:
    """A hash of 64 bits of each word; 256 bytes apart, bytes count alike."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words) or offsets[-1] == offsets[0]:
        return np.zeros(len(words), np.uint64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    offsets -= offsets[0]
    at = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros(len(words), np.uint64)
    out[full] = np.add.reduceat(raw * _POWERS[at & 255], offsets[:-1][full])
    return out


def endings(words: pa.StringArray, n: int = 2) -> np.ndarray:
    """The last ``n`` bytes of each word that are letters or beyond ASCII, as a number; bytes behind them don't count."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    at, low = offsets[1:] - 1, offsets[:-1]
    for _ in range(3):  # up to three marks behind the word
        back = (at > low) & ~letter[raw[np.maximum(at, 0)]] if len(raw) else at > low
        at = at - back
    out = np.zeros(len(words), np.int64)
    for k in range(n):
        ok = at - k >= low
        out = out * 256 + np.where(ok, raw[np.maximum(at - k, 0)] if len(raw) else 0, 0)
    return out
