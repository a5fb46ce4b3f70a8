"""Token ids of pieces of text by two 64-bit hashes of each piece, in flat arrays (some 40 bytes a piece)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MOST_PIECES = 3_000_000


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one behind the other."""
    total = int(size.sum())
    if not total:
        return pool[:0]
    step = np.ones(total, np.int64)
    keep = size > 0
    s, n = start[keep], size[keep]
    at = np.cumsum(n) - n
    step[at[0]] = s[0]
    step[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return pool[np.cumsum(step)]


class PieceCache:
    """Forgets all when full: what is common comes back at once.

    Pieces are found by their first hash; where the second one differs (another piece with the same first hash), the piece is
    encoded by itself, so that ids are never those of another piece."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1024, self.dtype), 0

    def ids(self, hashes: np.ndarray, checks: np.ndarray, encode: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of each piece's.

        ``encode`` gets places in ``hashes`` of pieces that aren't known, each distinct one once, and returns their ids."""
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == own[inside]
        if not known.all():
            if len(self.hashes) > MOST_PIECES:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            found = encode(first[new])
            size = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.concatenate(found).astype(self.dtype) if size.sum() else np.zeros(0, self.dtype)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(flat)), self.dtype)])
            self.pool[self.used : self.used + len(flat)] = flat
            place = np.searchsorted(self.hashes, own[new])
            self.start = np.insert(self.start, place, self.used + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.hashes = np.insert(self.hashes, place, own[new])
            self.checks = np.insert(self.checks, place, checks[first[new]])
            self.used += len(flat)
            at = np.searchsorted(self.hashes, own)
        which = at[back]
        size = self.size[which]
        other = np.flatnonzero(self.checks[which] != checks)
        if not len(other):
            return gather(self.pool, self.start[which], size), size
        found = [np.asarray(x, self.dtype) for x in encode(other)]
        size[other] = [len(x) for x in found]
        out, to = np.zeros(int(size.sum()), self.dtype), np.cumsum(size)
        mine = np.zeros(len(out), bool)
        for k, x in zip(other.tolist(), found, strict=True):
            out[to[k] - len(x) : to[k]] = x
            mine[to[k] - len(x) : to[k]] = True
        rest = self.checks[which] == checks
        out[~mine] = gather(self.pool, self.start[which[rest]], size[rest])
        return out, size
