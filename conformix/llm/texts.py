"""Vectorised text kernels over Arrow string columns.

Every operator that reads text works on the UTF-8 buffer of an Arrow batch with
numpy, a few megabytes at a time, so the cost is a handful of array passes per
byte and the memory of a worker doesn't depend on the size of a partition.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters; letters of ASCII and Latin-1 are folded to lower case for hashing.
NULL text counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once by the kernels.
CHUNK_BYTES = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_rng = np.random.RandomState(20240229)
_BYTE_CODE = _rng.randint(1, 1 << 62, 256).astype(U64) * U64(2) + U64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=U64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string array and the n + 1 offsets into them.

    NULL values have length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch holding about `size` bytes of text each (one row at least)."""
    buf, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of UTF-8 (bytes C3 80-9E)."""
    out = _FOLD[buf]
    if len(out) > 1:
        up = np.flatnonzero(buf[:-1] == 0xC3) + 1
        up = up[(buf[up] >= 0x80) & (buf[up] <= 0x9E) & (buf[up] != 0x97)]
        out[up] += 32
    return out


class Words:
    """Words of a chunk: byte ranges, 64-bit hashes and the words of each row.

    start, end: byte range of each word; first: index of the first word of each
    row, with one more entry at the end; hash: None until hashed().
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        inside = _WORD[buf]
        self.start, self.end = runs(inside, off)
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashed(self) -> np.ndarray:
        """Hash of each folded word."""
        return range_hash(_BYTE_CODE[fold(self.buf)], self.start, self.end)

    def row(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses a row's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = off[(off > 0) & (off < n)]
    before[cut] = False
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def range_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each range, in time linear in the codes."""
    n = len(codes)
    total = np.zeros(n + 1, U64)
    np.cumsum(codes * _power("r", _R, n + 1)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _power("inv", _R_INV, n + 1)[start] + (end - start).astype(U64))


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams in text order, and n + 1 offsets by row.

    A row of fewer words, but one at least, has the one gram of all its words.
    """
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    off = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(grams, out=off[1:])
    start = np.arange(off[-1]) - np.repeat(off[:-1], grams) + np.repeat(first[:-1], grams)
    length = np.minimum(n, np.repeat(count, grams))
    return range_hash(words, start, start + length), off


def string_array(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """The string array with these bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))).cast(pa.string())


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all ranges."""
    off = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    return np.arange(off[-1]) + np.repeat(start - off[:-1], length)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))
