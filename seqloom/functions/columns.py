"""Arrow string columns as bytes, and per-base counts from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NOTHING = 256  # in place of a base or a code that isn't there
_MANY = 1 << 20
_MERGED = 1 << 17
SLICE_BYTES = 1 << 20


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin (and the last one's end); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, edges, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(edges, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def file_runs(names: pa.Array) -> list[tuple[object, int, int]]:
    """(name, first row, end row) for runs of equal names."""
    runs = pc.run_end_encode(names)
    ends = runs.run_ends.to_pylist()
    return list(zip(runs.values.to_pylist(), [0, *ends[:-1]], ends, strict=True))


def slices(*edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs with at most SLICE_BYTES in each of these columns, or of one longer row: what is worked out for
    each byte needs memory by these, not by the batch, which holds as many rows of any length."""
    at, n = 0, len(edges[0]) - 1
    while at < n:
        to = min(int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1 for off in edges)
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these sizes each element's row and place (from 0) in it."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


class Counts:
    """Whole-number keys and what is added up for each; merged whenever there are many."""

    def __init__(self) -> None:
        self.parts: dict[object, list[tuple[np.ndarray, ...]]] = {}
        self.rows: dict[object, int] = {}
        self.least: dict[object, int] = {}  # keys after the last merging

    def add(self, name: object, keys: np.ndarray, *sums: np.ndarray) -> None:
        self.parts.setdefault(name, []).append((keys, *sums))
        self.rows[name] = self.rows.get(name, 0) + len(keys)
        # what doesn't shrink isn't merged again and again
        if self.rows[name] > max(_MERGED, 2 * self.least.get(name, 0)) and len(self.parts[name]) > 1:
            merged = self.merged(name)
            self.parts[name], self.rows[name], self.least[name] = [merged], len(merged[0]), len(merged[0])

    def merged(self, name: object) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.parts[name], strict=True)]
        own, back = np.unique(columns[0], return_inverse=True)
        return own, *(np.bincount(back, c, len(own)).astype(np.int64) for c in columns[1:])


def base_counts(seq: tuple[np.ndarray, np.ndarray], qual: tuple[np.ndarray, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (place << 18 | base << 9 | code; from 1 on) and counts over rows a to b that have a sequence."""
    (s, s_off), (q, q_off) = seq, qual
    own = np.flatnonzero(np.diff(s_off[a : b + 1])) + a
    s_size, q_size = s_off[own + 1] - s_off[own], q_off[own + 1] - q_off[own]
    if (s_size == q_size).all() and len(own) == b - a:
        total = int(s_size.sum())
        whole = np.int32 if total < 1 << 28 else np.int64  # 4 * total + _MANY is the largest number below
        at = np.arange(total, dtype=whole) - np.repeat((np.cumsum(s_size) - s_size).astype(whole), s_size)
        base, code = s[s_off[a] : s_off[b]], q[q_off[a] : q_off[b]]
    else:
        row, at = places(np.maximum(s_size, q_size))
        pick = lambda x, off, size: np.where(at < size[row], np.append(x, np.uint8(0))[np.minimum(off[own][row] + at, len(x))].astype(np.int64), NOTHING)
        base, code = pick(s, s_off, s_size), pick(q, q_off, q_size)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bases, codes = (np.flatnonzero(np.bincount(x, minlength=NOTHING + 1)) for x in (base, code))
    number = lambda x: np.searchsorted(x, np.arange(NOTHING + 1)).astype(at.dtype)
    top = int(at.max()) + 1
    if top * len(bases) * len(codes) <= 4 * len(at) + _MANY:
        n = np.bincount((at * len(bases) + number(bases)[base]) * len(codes) + number(codes)[code], minlength=top * len(bases) * len(codes))
        full = np.flatnonzero(n)
        rest, c = np.divmod(full, len(codes))
        place, k = np.divmod(rest, len(bases))
        return (place + 1) << 18 | bases[k] << 9 | codes[c], n[full]
    return np.unique((at.astype(np.int64) + 1) << 18 | base.astype(np.int64) << 9 | code, return_counts=True)
