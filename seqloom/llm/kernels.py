"""Vectorised text kernels: words of whole Arrow columns as 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's hash is the sum, modulo 2**64, of a mixed number for each
byte and its place in the word, mixed once more: equal words have equal hashes on any machine, and no pattern of letters makes
different words collide (a polynomial in the bytes has such patterns for every base).  Two given words collide with probability
2**-64; where even that would give a wrong row, a second, independent hash is asked for and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SECOND = 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 17

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's start in them (one more for the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together, or of one longer row."""
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of the rows, and the lower-cased bytes."""
    low = LOWER[raw]
    n = len(low)
    inside = ~SPACE[low]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cut = off[1:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = cut - 1
    after[last[(last >= 0) & (last < n)]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows, low


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False):
    """Hashes of the spans of an array of small numbers (bytes or code points); with ``second`` a pair of independent ones."""
    size = ends - starts
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    code = mix((values[np.repeat(starts, size) + place].astype(U) + U(1)) | place.astype(U) << U(24))
    full = np.flatnonzero(size)

    def summed(code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size), U)
        if len(full):
            out[full] = np.add.reduceat(code, at[full])
        return mix(out)

    return (summed(code), summed(mix(code ^ U(SECOND)))) if second else summed(code)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows in order, and the number of words of each row."""
    rows_n = len(off) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(rows_n, np.int64)
    starts, ends, rows, low = word_bounds(raw, off)
    return span_hashes(low, starts, ends), np.bincount(rows, minlength=rows_n).astype(np.int64)


def column_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words of each row) for runs of rows that fit in a small buffer."""
    raw, off = column_bytes(texts)
    for a, b in slices(off):
        h, n = words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, h, n


def join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for a sequence of hashes; order counts."""
    out = np.full(len(parts[0]), U(len(parts)))
    for p in parts:
        out = mix(out * U(BASE) + p)
    return out


def shingles(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, and their numbers; a row of fewer words has one of all its words."""
    if not len(h):
        return np.zeros(0, U), np.zeros(len(n), np.int64)
    start = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    short = np.flatnonzero((n > 0) & (n < k))
    pad = np.concatenate([h, np.zeros(k, U)])
    out = join_hashes([pad[first + i] for i in range(k)])
    at = np.cumsum(count) - count
    for r in short:  # whole short sequences
        out[at[r]] = join_hashes([h[start[r] + i : start[r] + i + 1] for i in range(n[r])])[0]
    return out, count


def crc_text(ids: np.ndarray) -> np.ndarray:
    """crc32 of the decimal text of each id."""
    from zlib import crc32

    return np.array([crc32(b"%d" % i) for i in ids.tolist()], np.int64)
