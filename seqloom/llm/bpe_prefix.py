"""Byte-level BPE by prefix dynamic programming, encoding and decoding (operator 9).

For each prefix of a byte string the table keeps the last token of that prefix's encoding.  A token may follow another if the
encoding of both their bytes together is just these two; then exactly one token that ends a prefix may follow the last token
of what is before it.  So a byte can be appended without looking at more than the longest token's bytes, dropped by forgetting
table entries, and an edit needs new entries only until they fall in step with the old ones.

Edge cases: null and empty texts have no tokens; very long texts are encoded whole (a lone surrogate can't be: Spark's strings are
UTF-8); a prefix has one valid last token, so that there are no ties; a null doc_id stays null; repeated rows repeat; an empty table
gives no rows; any other columns, also ones called ``ids``, are kept out of the result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import column_bytes, slices, span_hashes
from .piececache import PieceCache, gather

CACHE_PAIRS = 1_000_000
NOTHING = (1 << 31) - 1
SCHEMA = "doc_id long, ids array<int>, decoded binary"
OUT_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Vocabulary:
    """Tokens by bytes and rank, and which tokens may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes[r] = b
        self.longest = max(map(len, ranks), default=0)
        self.ends: dict[bytes, int] = {}  # every token's every ending: the token of just these bytes, or -1
        for b in ranks:
            for i in range(1, len(b)):
                self.ends.setdefault(b[i:], -1)
        self.ends.update(ranks)
        self._spines: tuple[dict, dict] = ({}, {})
        self._pairs: dict[int, bool] = {}
        self._automaton = None
        self._sizes = [len(b) for b in self.bytes]

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: again and again the leftmost adjacent pair of the lowest rank becomes one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """The tokens that stand at the right (0) or left (1) end of a token's bytes while these are merged, each with the
        rank of the merge that takes it in (the last: none).  None if the bytes' encoding isn't the token."""
        known = self._spines[side].get(token, 0)
        if known != 0:
            return known
        parts, ranks, out = [self.bytes[token][i : i + 1] for i in range(len(self.bytes[token]))], self.ranks, []
        edge = -1 if side == 0 else 0
        while len(parts) > 1:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            if at == (len(parts) - 2 if side == 0 else 0):
                out.append((parts[edge], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = [*out, (parts[0], 1 << 60)] if len(parts) == 1 and ranks[parts[0]] == token else None
        self._spines[side][token] = found
        return found

    def alone(self, token: int) -> bool:
        """Is the token its own bytes' encoding?"""
        return self.spine(token, 0) is not None

    def follows(self, first: int, second: int) -> bool:
        """Are both tokens together their bytes' encoding?  Both sides are merged in the order of ranks; the tokens are
        kept apart if no merge over the border ever comes before the next one on either side (the left one on a tie)."""
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.alone(second) if first == NOTHING else self._apart(self.spine(first, 0), self.spine(second, 1))
        return known

    def _apart(self, left: list[tuple[bytes, int]] | None, right: list[tuple[bytes, int]] | None) -> bool:
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (x, took_x), (y, took_y) = left[i], right[j]
            over = self.ranks.get(x + y, 1 << 60)
            if over < took_x and over <= took_y and over < 1 << 60:
                return False
            if took_x <= took_y:
                if took_x == 1 << 60:
                    return True
                i += 1
            else:
                j += 1


    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Complete a table: the last token of each prefix of ``data``, those of the first prefixes being known."""
        endings, pairs, follows = self.ends.get, self._pairs, self.follows
        for end in range(len(last) + 1, len(data) + 1):
            found = []
            for start in range(end - 1, -1, -1):
                t = endings(data[start:end])
                if t is None:
                    break
                if t >= 0:
                    found.append((start, t))
            for start, t in reversed(found):
                if start:
                    ok = pairs.get(last[start - 1] << 32 | t)
                    if ok is None:
                        ok = follows(last[start - 1], t)
                else:
                    ok = self.spine(t, 0) is not None
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last


    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Many short byte strings at once: an automaton names the tokens that end at each byte, the longest first."""
        import ahocorasick

        if self._automaton is None:
            made = ahocorasick.Automaton()
            for b, r in self.ranks.items():
                made.add_word(b.decode("latin-1"), r)
            made.make_automaton()
            self._automaton = made
        joined = "\u0100".join(["", *(p.decode("latin-1") for p in pieces)])
        last, sizes, pairs = [NOTHING] * len(joined), self._sizes, self._pairs
        for end, t in self._automaton.iter(joined):
            if last[end] == NOTHING:
                before = end - sizes[t]
                key = last[before] << 32 | t  # a token at a piece's start follows NOTHING
                ok = pairs.get(key)
                if ok is None:
                    ok = self.follows(key >> 32, t)
                if ok:
                    last[end] = t
        out, end = [], 0
        for p in pieces:
            end += len(p) + 1
            at, own = end, []
            while (t := last[at - 1]) != NOTHING:
                own.append(t)
                at -= sizes[t]
            if sum(map(sizes.__getitem__, own)) != len(p):
                raise ValueError("the vocabulary lacks a byte")
            own.reverse()
            out.append(own)
        return out


class PrefixTable:
    """The last token of each prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data = vocabulary, data
        self.last = vocabulary.extend([], data)

    def append(self, more: bytes) -> None:
        """Looks back no further than the longest token is long."""
        self.data += more
        self.v.extend(self.last, self.data)

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for the bytes from start to end; returns how many entries were computed.

        Behind the edit old entries are right again once as many in a row as the longest token has bytes are as before
        (each entry depends on no more than these)."""
        tail, old = self.data[end:], self.last[end:]
        reach = self.v.longest
        self.truncate(start)
        self.append(new)
        same = 0
        for k in range(len(tail)):
            if same >= reach:
                self.data += tail[k:]
                self.last += old[k:]
                return len(new) + k
            self.append(tail[k : k + 1])
            same = same + 1 if self.last[-1] == old[k] else 0
        return len(new) + len(tail)

    def tokens(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(self.v.bytes[t])
        return out[::-1]


#: The pattern whose matches the vectorised splitter finds; any other pattern goes through the regex library.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE_CHAR = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_CHAR, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def split_points(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Starts of the matches of SPLIT_PATTERN in rows of code points that lie one behind the other.

    Runs of one class are pieces.  A run of white space gives its last character, if something follows in its row, to a piece
    of its own, or to the next one if it is a blank; an apostrophe alone takes the letters of a contraction from the next."""
    n = len(points)
    kind = _classes()[points]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[row_starts[row_starts < n]] = True
    row_end = np.zeros(n + 1, bool)
    row_end[row_starts] = True
    row_end[n] = True
    run = np.flatnonzero(begin)
    run_kind, ends = kind[run], np.append(run[1:], n)
    spaces = (run_kind == SPACE_CHAR) & ~row_end[ends]  # something follows in the row
    last = ends[spaces] - 1
    begin[last] = True
    begin[last[points[last] == 32] + 1] = False
    # a contraction: a run that is one apostrophe and still begins a piece, then letters in the same row
    one = run[(run_kind == OTHER) & (ends - run == 1) & (points[run] == 39)]
    one = one[begin[one] & (one + 1 < n)]
    one = one[(kind[one + 1] == LETTER) & ~row_end[one + 1]]
    if len(one):
        pad = np.concatenate([points, [0, 0, 0]])
        pad_end = np.concatenate([row_end, [True, True]])
        a, b = pad[one + 1], np.where(pad_end[one + 2], 0, pad[one + 2])
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, size in ((short, 1), (long, 2)):
            at = one[which]
            begin[at + 1] = False
            to = at + 1 + size
            to = to[to < n]
            begin[to] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of whole texts: pieces by the pattern, each distinct piece by prefix tables, kept by its hash."""

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(read_ranks(path))
        self.pattern = pattern
        self.known = PieceCache(np.dtype(np.int32))
        self.size = np.array([len(b) for b in self.v.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(self.v.bytes), np.uint8)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of each text's."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.cumsum(size) - size
        if not len(points):
            return np.zeros(0, np.int32), size
        if self.pattern == SPLIT_PATTERN:
            begin = split_points(points, starts)
        else:
            import regex

            begin = np.array([a + m.start() for a, t in zip(starts.tolist(), texts, strict=True) for m in regex.finditer(self.pattern, t)], np.int64)
        end = np.append(begin[1:], len(points))
        ids, count = self.known.ids(
            *span_hashes(points, begin, end, second=True),
            lambda at: self.v.encode_many([joined[begin[i] : end[i]].encode() for i in at.tolist()])
        )
        rows = np.searchsorted(starts, begin, "right") - 1
        return ids, np.bincount(rows, weights=count, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.start[ids], self.size[ids])


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        for a, b in slices(off, OUT_BYTES):
            parts, counts, lengths = [], [], []
            for c, d in slices(off[a : b + 1]):
                own = off[a + c : a + d + 1]
                data = raw[own[0] : own[-1]].tobytes()
                ids, n = encoder.texts([data[x - own[0] : y - own[0]].decode() for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
                parts.append(ids)
                counts.append(n)
                to = np.concatenate([[0], np.cumsum(encoder.size[ids])])
                lengths.append(np.diff(to[np.concatenate([[0], np.cumsum(n)])]))
            ids = np.concatenate(parts)
            edges = lambda x: pa.array(np.concatenate([[0], np.cumsum(np.concatenate(x))]).astype(np.int32))
            decoded = pa.Array.from_buffers(pa.binary(), b - a, [None, edges(lengths).buffers()[1], pa.py_buffer(encoder.decode(ids))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], pa.ListArray.from_arrays(edges(counts), pa.array(ids)), decoded],
                ["doc_id", "ids", "decoded"]
            )


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for batch in batches:
        out = [None if ids is None else encoder.decode(np.array(ids, np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text's token ids, and the bytes that they decode to again (doc_id, ids, decoded)."""
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cols.mapInArrow(partial(_encode, path=ranks_path, pattern=pattern), SCHEMA)


def decode(tokens: DataFrame, ranks_path: str, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(doc_id, ids) to (doc_id, decoded); null ids stay null."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, path=ranks_path, pattern=pattern), "doc_id long, decoded binary")
