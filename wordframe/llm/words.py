"""Words of whole texts as 64-bit hashes, straight from Arrow buffers."""
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# A word is a run of digits, letters a-z (A-Z lower-cased) and bytes from 0x80 on: every character beyond ASCII.
LETTER = np.zeros(256, np.uint8)
LETTER[0x30:0x3A] = np.arange(0x30, 0x3A) + 1
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B) + 1
LETTER[0x41:0x5B] = LETTER[0x61:0x7B]
LETTER[0x80:0x100] = (np.arange(0x80, 0x100) - 0x80 + 128).astype(np.uint8)

BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 21       # texts are handled in runs of about this size; a longer text is one run
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    if len(_POWERS["up"]) <= n:
        length = max(n + 1, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(length, base)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words(NamedTuple):
    """``hashes[first[i]:first[i + 1]]`` are the words of text ``i``."""
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; a missing text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] \
        if offsets is not None and len(texts) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def runs(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Neighbouring texts in runs of about ``size`` bytes: (first, end)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; equal words have equal hashes."""
    low = int(offsets[0])
    letters = LETTER[data[low:int(offsets[-1])]]
    bounds = offsets - low
    n = len(letters)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = letters != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    borders = bounds[(bounds > 0) & (bounds < n)]
    starts[borders] = inside[borders]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    ends[borders] |= inside[borders - 1]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters * up[:n], out=sums[1:])
    hashes = mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))
    return Words(hashes, np.searchsorted(at, bounds).astype(np.int64))


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, relative to ``offsets[0]``, in the sequence of ``words_of``."""
    low = int(offsets[0])
    inside = LETTER[data[low:int(offsets[-1])]] != 0
    bounds, n = offsets - low, len(inside)
    starts, ends = inside.copy(), np.zeros(n + 1, bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts[1:] &= ~inside[:-1]
    borders = bounds[(bounds > 0) & (bounds < n)]
    starts[borders] = inside[borders]
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    ends[borders] |= inside[borders - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)
