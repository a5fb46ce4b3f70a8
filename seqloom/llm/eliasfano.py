"""Elias-Fano sequences in flat arrays that can be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U = np.uint64
SAMPLE = 32  # a hint for so many ones, and for so many zeros
_EACH = U(0x0101010101010101)
_TOP = U(0x8080808080808080)
_kth = np.zeros((8, 256), np.uint8)  # the place of a byte's k-th one
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _kth[_k, _byte] = _at
_kth = _kth.ravel()


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) one of each 64-bit word: the byte by sums over bytes, then a table."""
    s = word - ((word >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH  # each byte: the ones up to it
    k = k.astype(U)
    shift = np.bitwise_count(((k * _EACH) | _TOP) - s & _TOP).astype(U) << U(3)
    k -= ((s << U(8)) >> shift) & U(255)
    return _kth[k << U(8) | (word >> shift) & U(255)] + shift.astype(np.int64)


def _after(word: np.ndarray) -> np.ndarray:
    """The place of each word's first one (64 if there is none)."""
    return np.bitwise_count((word & (~word + U(1))) - U(1)).astype(np.int64)


def _read_bits(words: np.ndarray, start: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The ``at``-th numbers of ``width`` bits in runs that begin at the words ``start``."""
    bit = at.astype(U) * width
    w, s = start + (bit >> U(6)).astype(np.int64), bit & U(63)
    # two shifts, as one by 64 bits isn't defined
    return (words[w] >> s | words[w + 1] << (U(63) - s) << U(1)) & ((U(1) << width) - U(1))


def _write_bits(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width:
        bit = np.arange(len(values), dtype=U) * U(width)
        w, s = (bit >> U(6)).astype(np.int64), bit & U(63)
        np.bitwise_or.at(out, w, values << s)
        over = s + U(width) > U(64)
        np.bitwise_or.at(out, w[over] + 1, values[over] >> (U(64) - s[over]))
    return out


class EliasFano:
    """Sequences that don't fall: each value's low bits packed, its high bits in unary in a bitmap.

    To find the k-th one or zero of the bitmap: a hint tells some words, running sums of their ones tell which (by halving).
    Several sequences lie in the same arrays, and look-ups name one for each query (``sec``), so that one call asks all."""

    FIELDS = ("n", "width", "low_at", "high_at", "ones_at", "zeros_at", "low", "high", "rank", "ones", "zeros")

    def __init__(self, n, width, low_at, high_at, ones_at, zeros_at, low, high, rank, ones, zeros):
        self.n, self.width, self.low_at, self.high_at, self.ones_at, self.zeros_at = n, width, low_at, high_at, ones_at, zeros_at
        self.low, self.high, self.rank, self.ones, self.zeros = low, high, rank, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """One sequence."""
        values = values.astype(U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        place = (values >> U(width)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        total = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        hint = lambda x: np.append(x[::SAMPLE] >> 6, len(high) - 1).astype(np.uint32)
        low, ones, zeros = _write_bits(values & U((1 << width) - 1), width), hint(place), hint(np.flatnonzero(bits == 0))
        ends = (np.array([0, len(x)], np.int64) for x in (low, high, ones, zeros))
        return cls(np.array([n], np.int64), np.array([width], U), *ends, low, high, total[:-1].astype(np.uint32), ones, zeros)

    @classmethod
    def join(cls, parts: list[EliasFano]) -> EliasFano:
        """The sequences of several, one behind the other."""
        every = lambda f: np.concatenate([getattr(p, f) for p in parts])

        def edges(f: str) -> np.ndarray:
            last = np.cumsum([0, *(getattr(p, f)[-1] for p in parts)])
            return np.concatenate([*(getattr(p, f)[:-1] + at for p, at in zip(parts, last, strict=False)), last[-1:]]).astype(np.int64)

        return cls(every("n"), every("width"), *map(edges, ("low_at", "high_at", "ones_at", "zeros_at")), *map(every, ("low", "high", "rank", "ones", "zeros")))

    def arrays(self) -> dict[str, np.ndarray]:
        return {f: getattr(self, f) for f in self.FIELDS}

    def _ones_before(self, sec, word: np.ndarray, ones: bool) -> np.ndarray:
        r = self.rank[self.high_at[sec] + word].astype(np.int64)
        return r if ones else (word << 6) - r

    def _select(self, sec, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places in the bitmap of the k-th ones or zeros."""
        hint, j = (self.ones, self.ones_at[sec] + k // SAMPLE) if ones else (self.zeros, self.zeros_at[sec] + k // SAMPLE)
        word, last = hint[j].astype(np.int64), hint[j + 1].astype(np.int64)
        open_ = np.flatnonzero(word < last)
        while len(open_):
            lo, hi = word[open_], last[open_]
            mid = (lo + hi + 1) >> 1
            there = self._ones_before(sec[open_], mid, ones) <= k[open_]
            word[open_] = lo = np.where(there, mid, lo)
            last[open_] = hi = np.where(there, hi, mid - 1)
            open_ = open_[lo < hi]
        bits = self.high[self.high_at[sec] + word]
        return (word << 6) + _select_in_word(bits if ones else ~bits, k - self._ones_before(sec, word, ones))

    def _next(self, sec, place: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """The places of the k-th ones or zeros, which are the first ones at or behind ``place``: mostly in the same word."""
        bits = self.high[self.high_at[sec] + (place >> 6)]
        step = _after((bits if ones else ~bits) >> (place & 63).astype(U))
        out = place + step
        far = np.flatnonzero(step == 64)
        if len(far):
            out[far] = self._select(sec[far], k[far], ones)
        return out

    def _value(self, sec, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (place - i).astype(U) << self.width[sec] | _read_bits(self.low, self.low_at[sec], i, self.width[sec])

    def get(self, i: np.ndarray, sec: np.ndarray | None = None) -> np.ndarray:
        """The values at places ``i`` (of the first sequence, unless ``sec`` tells)."""
        sec = np.zeros(len(i), np.int64) if sec is None else sec
        return self._value(sec, self._select(sec, i, True), i) if len(i) else np.zeros(0, U)

    def get_two(self, i: np.ndarray, sec: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``i`` and ``i + 1``."""
        if not len(i):
            return np.zeros(0, U), np.zeros(0, U)
        sec = np.zeros(len(i), np.int64) if sec is None else sec
        place = self._select(sec, i, True)
        return self._value(sec, place, i), self._value(sec, self._next(sec, place + 1, i + 1, True), i + 1)

    def _bucket(self, sec, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of values with these high parts: between two zeros of the bitmap."""
        n = self.n[sec]
        top = np.minimum(h, (self.high_at[sec + 1] - self.high_at[sec]) * 64 - n - 1)
        start = np.zeros(len(h), np.int64)
        later = np.flatnonzero(top > 0)
        start[later] = self._select(sec[later], top[later] - 1, False) + 1
        return np.minimum(start - top, n), np.minimum(self._next(sec, start, top, False) - top, n)

    def _search(self, sec, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose low bits are at least ``want``, by halving; hi if there is none."""
        lo, hi = lo.copy(), hi.copy()
        start, width = self.low_at[sec], self.width[sec]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = _read_bits(self.low, start[open_], mid, width[open_]) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def successor(self, x: np.ndarray, sec: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose value is at least x (n if none), and that value (or 0)."""
        x, sec = x.astype(U), np.zeros(len(x), np.int64) if sec is None else sec
        width = self.width[sec]
        place = self._search(sec, *self._bucket(sec, (x >> width).astype(np.int64)), x & ((U(1) << width) - U(1)))
        value = np.zeros(len(x), U)
        inside = np.flatnonzero(place < self.n[sec])
        value[inside] = self.get(place[inside], sec[inside])
        return place, value

    def locate(self, x: np.ndarray, most: np.ndarray | None = None, sec: np.ndarray | None = None) -> np.ndarray:
        """The first place of each value (below ``most``), -1 where it isn't: the successor search within the values of the same
        high part, so that low bits alone tell."""
        x, sec = x.astype(U), np.zeros(len(x), np.int64) if sec is None else sec
        out = np.full(len(x), -1, np.int64)
        width = self.width[sec]
        lo, hi = self._bucket(sec, (x >> width).astype(np.int64))
        if most is not None:
            hi = np.minimum(hi, most)
        some = np.flatnonzero(lo < hi)
        sec, hi, want = sec[some], hi[some], (x & ((U(1) << width) - U(1)))[some]
        place = self._search(sec, lo[some], hi, want)
        inside = np.flatnonzero(place < hi)
        sec = sec[inside]
        hit = inside[_read_bits(self.low, self.low_at[sec], place[inside], self.width[sec]) == want[inside]]
        out[some[hit]] = place[hit]
        return out
