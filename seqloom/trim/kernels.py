"""Trimming kernels over batches of reads of any lengths: bytes one behind the other with offsets, never filled up to the longest.

Quality trimming is the usual running-sum rule from the 3' end, as sums along all bytes of a batch.  Adapter trimming is the
published semi-global alignment with free ends: the adapter may begin anywhere in the read and may overhang its 3' end.  A
bit-parallel search (a column of the table in one 64-bit word, all windows of a batch at a time) finds where the whole adapter may
lie; only windows with such a place, and the reads' ends, are aligned cell by cell.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.columns import column_bytes, places

WINDOW = 256  # bases of a read that are searched at a time, besides those that a match may begin in before
CELLS = 1 << 21  # bases of windows that are aligned at a time
WORD = 64


class Flat(NamedTuple):
    """Reads' bytes, and where each begins (and the last one ends)."""

    raw: np.ndarray
    off: np.ndarray


def flat(texts: pa.Array | list[str]) -> tuple[Flat, np.ndarray]:
    """The bytes of the strings and their lengths; a letter beyond ASCII is one byte that matches nothing, null is empty."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    raw, off = column_bytes(texts)
    if len(raw) and raw.max() > 127:
        plain = [(t or "").encode("ascii", "replace") for t in texts.to_pylist()]
        off = np.concatenate([[0], np.cumsum([*map(len, plain)])])
        raw = np.frombuffer(b"".join(plain), np.uint8)
    return Flat(raw, off), np.diff(off)


def fitted(quality: Flat, size: np.ndarray) -> Flat:
    """Qualities cut, or filled up with the worst, to these lengths."""
    have = np.diff(quality.off)
    if (have == size).all():
        return quality
    row, at = places(size)
    there = at < have[row]
    raw = np.full(len(row), ord("!"), np.uint8)
    raw[there] = quality.raw[quality.off[:-1][row[there]] + at[there]]
    return Flat(raw, np.concatenate([[0], np.cumsum(size)]))


def quality_cut(quality: Flat, size: np.ndarray, cutoff: int, base: int = 33, sequence: Flat | None = None) -> np.ndarray:
    """How many bases stay: from the 3' end, sums of (cutoff - quality) run until they fall below 0; the cut is where they are
    greatest.  With ``sequence`` (two-colour chemistry) a G counts as just below the cutoff."""
    if not len(quality.raw):
        return size.copy()
    score = cutoff + base - quality.raw.astype(np.int64)
    if sequence is not None:
        score[sequence.raw == ord("G")] = 1
    sums = np.concatenate([[0], np.cumsum(score)])
    left = sums[quality.off[1:]]  # by read
    kept = size.copy()
    own = np.flatnonzero(size)
    row = np.repeat(np.arange(len(size)), size)
    # the sum from a base to the read's end; one behind the last below 0 is where it starts to count
    rest = left[row] - sums[:-1]
    below = np.flatnonzero(rest < 0)
    last = np.searchsorted(below, quality.off[own + 1]) - 1  # the last such base of each read, if it is the read's
    begin = np.where(last >= 0, below[np.maximum(last, 0)] + 1 if len(below) else 0, 0)
    begin = np.maximum(begin, quality.off[own])
    stop = np.zeros(len(size), np.int64)
    stop[own] = begin
    rest[np.arange(len(rest)) < stop[row]] = -1
    best = np.maximum.reduceat(rest, quality.off[own])
    # of equal sums the one nearest to the 3' end
    top = np.flatnonzero(rest == np.repeat(best, size[own]))
    at = top[np.searchsorted(top, quality.off[own + 1]) - 1]
    kept[own] = np.where(best > 0, at - quality.off[own], size[own])
    return kept


def _windows(reads: Flat, size: np.ndarray, warm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(read, begin, own, end) in the read: ends of matches are sought from ``own`` on; ``warm`` bases before let them begin."""
    many = -(-size // WINDOW)
    row, k = places(many)
    own = k * WINDOW
    return row, np.maximum(own - warm, 0), own, np.minimum(own + WINDOW, size[row])


def _searched(reads: Flat, row: np.ndarray, begin: np.ndarray, own: np.ndarray, end: np.ndarray, adapter: np.ndarray, most: int) -> np.ndarray:
    """Which windows have an end of a whole adapter with at most ``most`` errors: Myers' bit-vectors, a window each."""
    m, one = len(adapter), np.uint64(1)
    accepts = np.zeros(256, np.uint64)
    for i, c in enumerate(adapter.tolist()):
        if c == ord("N"):
            accepts |= one << np.uint64(i)
        else:
            accepts[c] |= one << np.uint64(i)
    order = np.argsort(begin - end, kind="stable")  # longest first, so that those still running are a prefix
    start, size, lead = reads.off[row[order]] + begin[order], (end - begin)[order], (own - begin)[order]
    plus, minus = np.full(len(order), ~np.uint64(0)), np.zeros(len(order), np.uint64)
    score, found = np.full(len(order), m, np.int16), np.zeros(len(order), bool)
    running = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # how many are longer than j
    top = np.uint64(m - 1)
    for j, n in enumerate(running.tolist()):
        p, q = plus[:n], minus[:n]
        eq = accepts[reads.raw[start[:n] + j]]
        xv = eq | q
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = q | ~(xh | p), p & xh
        score[:n] += (ph >> top & one).astype(np.int16) - (mh >> top & one).astype(np.int16)
        found[:n] |= (score[:n] <= most) & (lead[:n] <= j)
        ph, mh = ph << one, mh << one
        plus[:n], minus[:n] = mh | ~(xv | ph), ph & xv
    out = np.zeros(len(order), bool)
    out[order] = found
    return out


class _Best:
    """For each read the alignment with the most matches, then the fewest errors, then the leftmost."""

    def __init__(self, n: int, worst: int):
        self.match, self.cost, self.start = np.full(n, -1, np.int64), np.full(n, worst, np.int64), np.zeros(n, np.int64)

    def take(self, reads: np.ndarray, match: np.ndarray, cost: np.ndarray, start: np.ndarray) -> None:
        """``reads`` may repeat."""
        order = np.lexsort((start, cost, -match, reads))
        first = order[np.concatenate([[True], reads[order][1:] != reads[order][:-1]])]
        r, k, c, s = reads[first], match[first], cost[first], start[first]
        better = (k > self.match[r]) | (k == self.match[r]) & ((c < self.cost[r]) | (c == self.cost[r]) & (s < self.start[r]))
        r = r[better]
        self.match[r], self.cost[r], self.start[r] = k[better], c[better], s[better]


def _aligned(reads: Flat, row: np.ndarray, begin: np.ndarray, own: np.ndarray, end: np.ndarray, ends: np.ndarray, adapter: np.ndarray, rate: float, overlap: int, best: _Best) -> None:
    """Edit distances with unit costs, a window's column at a time for all windows: whole adapters that end from ``own`` on, and
    where the window ends its read (``ends``) first parts of the adapter."""
    m = len(adapter)
    anything = adapter == ord("N")
    order = np.argsort(begin - end, kind="stable")
    row, begin, own, end, ends = (x[order] for x in (row, begin, own, end, ends))
    size, start, n = end - begin, reads.off[row] + begin, len(order)
    cost = np.tile(np.arange(m + 1, dtype=np.int16)[:, None], (1, n))
    match, first = np.zeros((m + 1, n), np.int16), np.zeros((m + 1, n), np.int16)
    least = max(1, min(overlap, m))
    good = np.floor(rate * np.arange(m + 1) + 1e-9).astype(np.int16)

    def take(rows: np.ndarray, i: int) -> None:
        rows = rows[cost[i, rows] <= good[i]]
        if len(rows):
            best.take(row[rows], match[i, rows].astype(np.int64), cost[i, rows].astype(np.int64), begin[rows] + first[i, rows])

    running = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for j, n in enumerate(running.tolist()):
        base = reads.raw[start[:n] + j]
        above_cost, above_match, above_first = np.zeros(n, np.int16), np.zeros(n, np.int16), np.full(n, j + 1, np.int16)
        old_cost, old_match, old_first = cost[0, :n].copy(), match[0, :n].copy(), first[0, :n].copy()
        cost[0, :n], match[0, :n], first[0, :n] = above_cost, above_match, above_first
        for i in range(1, m + 1):
            same = np.ones(n, bool) if anything[i - 1] else base == adapter[i - 1]
            left_cost, left_match, left_first = cost[i, :n].copy(), match[i, :n].copy(), first[i, :n].copy()
            diagonal, left, up = old_cost + ~same, left_cost + 1, above_cost + 1
            use_d = (diagonal <= left) & (diagonal <= up)
            use_l = ~use_d & (left <= up)
            above_cost = np.where(use_d, diagonal, np.where(use_l, left, up)).astype(np.int16)
            above_match = np.where(use_d, old_match + same, np.where(use_l, left_match, above_match))
            above_first = np.where(use_d, old_first, np.where(use_l, left_first, above_first))
            cost[i, :n], match[i, :n], first[i, :n] = above_cost, above_match, above_first
            old_cost, old_match, old_first = left_cost, left_match, left_first
        inside = np.flatnonzero(own[:n] - begin[:n] <= j)
        take(inside, m)
        ended = np.flatnonzero(ends[:n] & (size[:n] == j + 1))
        for i in range(least, m) if len(ended) else ():
            take(ended, i)


def adapter_cut(reads: Flat, size: np.ndarray, adapter: str, error_rate: float = 0.1, overlap: int = 1) -> np.ndarray:
    """How many of a read's first ``size`` bases stay in front of the adapter; all if it isn't found.

    An alignment that covers the whole adapter, or its first part up to the read's end, is good if its errors are at most
    ``error_rate`` of the part's length and the part is at least ``overlap`` long; of several, the one with the most matches, then
    the fewest errors, then the leftmost counts.  A good alignment spans no more bases than the adapter and its errors, so
    windows that overlap by so many see all of it."""
    m = len(adapter)
    out = size.copy()
    if not len(size) or not m or not size.any():
        return out
    code = np.frombuffer(adapter.encode(), np.uint8)
    most = int(np.floor(error_rate * m + 1e-9))
    warm = m + most + 1
    best = _Best(len(size), m + 1)
    windows = _windows(reads, size, warm)
    if m <= WORD and most < m:
        hit = np.zeros(len(windows[0]), bool)
        for a, b in slices(windows[3] - windows[1], 4 * CELLS):
            hit[a:b] = _searched(reads, *(x[a:b] for x in windows), code, most)
        windows = tuple(x[hit] for x in windows)
    some = np.flatnonzero(size)
    tails = some, np.maximum(size[some] - warm, 0), size[some] - 1, size[some]
    row, begin, own, end = (np.concatenate([a, b]) for a, b in zip(windows, tails, strict=True))
    ends = np.arange(len(row)) >= len(windows[0])
    for a, b in slices(end - begin, CELLS // (m + 1)):
        _aligned(reads, row[a:b], begin[a:b], own[a:b], end[a:b], ends[a:b], code, error_rate, overlap, best)
    found = best.match >= 0
    out[found] = np.minimum(best.start[found], size[found])
    return out


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``most`` elements together."""
    block = (np.cumsum(sizes) - sizes) // max(most, 1)
    cuts = np.flatnonzero(np.diff(block)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def first_parts(texts: pa.Array, kept: np.ndarray) -> pa.Array:
    """Each string's first ``kept`` letters; null stays null."""
    raw, off = column_bytes(texts)
    if len(raw) and raw.max() > 127:
        return pa.array([None if t is None else t[:k] for t, k in zip(texts.to_pylist(), kept.tolist(), strict=True)], pa.string())
    have = np.minimum(np.diff(off), kept)
    row, at = places(np.diff(off))
    own = raw[at < have[row]]
    new = np.concatenate([[0], np.cumsum(have)]).astype(np.int32)
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(new), pa.py_buffer(np.ascontiguousarray(own)))
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), out) if texts.null_count else out
