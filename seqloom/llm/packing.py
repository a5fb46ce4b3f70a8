"""Order-preserving packing of token sequences by dynamic programming (operator 8).

Documents stay in the order of their partition and form one stream of tokens.  The stream is cut into windows of at most
``capacity`` tokens.  A cut after a document is free, one after a sentence costs ``sentence_penalty``, any other costs
``hard_penalty``; unused room in a window costs one for each token.  With P[j] the position of the j-th possible cut and q[j]
its penalty,

    cost[j] = q[j] + capacity - P[j] + min(cost[i] + P[i])   over i < j with P[j] - P[i] <= capacity,

whose minimum a monotone queue gives in amortised constant time.  What remains at a partition's end is split at powers of two,
which need no padding.  Blocks bound the memory: the last, still open window of a block opens the next one.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as often as they come; an empty table gives
no rows; other columns are ignored; a null doc_id stays null.  A piece never leaves its document, and each token lies in exactly
one piece.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import column_bytes, slices, span_hashes, word_bounds
from .piececache import PieceCache

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
MARKS = b".,!?;:|#$%&*"
BLOCK_TOKENS = 1 << 19
HARD_STEP = 32


class WordTokenizer:
    """Token ids of whole texts by a vocabulary that never joins bytes across white space.

    Chunks between ASCII white space are encoded once and kept by their hash; a text's ids are its chunks' ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends_sentence = np.zeros(size, bool)
        for text, i in vocabulary.items():
            self.ends_sentence[i] = text.endswith((".</w>", "!</w>", "?</w>"))
        self.known = PieceCache(self.dtype)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        # a word and the marks behind it are encoded apart anyway, and fewer words than words with marks are distinct
        parts = [(core, c[len(core) :]) if (core := c.rstrip(MARKS))[-1:].isalnum() else (c, b"") for c in chunks]
        bare = [*{x for p in parts for x in p}]
        ids = dict(zip(bare, self._whole(bare), strict=True))
        return [np.concatenate([ids[a], ids[b]]) if b else ids[a] for a, b in parts]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and the number of each row's."""
        data = raw.tobytes()
        special = [k for k in range(len(off) - 1) if b"<|" in data[off[k] : off[k + 1]]] if b"<|" in data else []
        if special:  # a special token counts in its own letters only, which hashes of lower-cased words don't tell
            out = self._whole([data[off[k] : off[k + 1]] for k in range(len(off) - 1)])
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        starts, ends, rows, low = word_bounds(raw, off) if len(raw) else (np.zeros(0, np.int64),) * 4
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(off) - 1, np.int64)
        small = low.tobytes()
        ids, size = self.known.ids(*span_hashes(low, starts, ends, second=True), lambda at: self._chunks([small[starts[i] : ends[i]] for i in at.tolist()]))
        return ids, np.bincount(rows, weights=size, minlength=len(off) - 1).astype(np.int64)


_loaded: dict[str, WordTokenizer] = {}


def cut_windows(places: np.ndarray, penalty: np.ndarray, capacity: int) -> np.ndarray:
    """Indices into ``places`` (which begins with 0) of the cheapest cuts, the last place among them."""
    p, q = places.tolist(), penalty.tolist()
    cost, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (cost + place, place, index), rising
    for j in range(1, len(p)):
        at = p[j]
        while at - queue[0][1] > capacity:
            queue.popleft()
        least, _, back[j] = queue[0]
        cost[j] = own = q[j] + capacity - at + least
        own += at
        while queue and queue[-1][0] >= own:
            queue.pop()
        queue.append((own, at, j))
    out, j = [], len(p) - 1
    while j:
        out.append(j)
        j = back[j]
    return np.array(out[::-1], np.int64)


def possible_cuts(
    ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, capacity: int, sentence_penalty: float,
    hard_penalty: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, from 0, and their penalties; hard ones, HARD_STEP apart, in longer sentences only."""
    places = np.union1d(np.flatnonzero(ends_sentence[ids]) + 1, doc_ends)
    cost = np.where(np.isin(places, doc_ends), 0.0, sentence_penalty)
    places, cost = np.concatenate([[0], places]), np.concatenate([[0.0], cost])
    gap, step = np.diff(places), min(HARD_STEP, capacity)
    long = np.flatnonzero(gap > step)
    if len(long):
        count = (gap[long] - 1) // step
        extra = np.repeat(places[long], count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        places, cost = np.concatenate([places, extra]), np.concatenate([cost, np.full(len(extra), hard_penalty)])
        order = np.argsort(places, kind="stable")
        places, cost = places[order], cost[order]
    return places, cost


def powers(length: int) -> list[int]:
    """The powers of two that add up to ``length``, the largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _pack_partition(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, sentence_penalty: float,
    hard_penalty: float
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tok = _loaded.get(path) or _loaded.setdefault(path, WordTokenizer(path))
    sequence = TaskContext.get().partitionId() << 40
    end = np.array([end_id], tok.dtype).tobytes()
    # open documents: id, tokens in all, tokens gone into earlier windows, the others' bytes
    docs: list[tuple[int | None, int, int, bytes]] = []
    held = 0

    def flush(last: bool) -> pa.RecordBatch | None:
        nonlocal docs, held, sequence
        ids = np.frombuffer(b"".join(d[3] for d in docs), tok.dtype)
        doc_ends = np.cumsum([len(d[3]) // tok.dtype.itemsize for d in docs])
        places, cost = possible_cuts(ids, doc_ends, tok.ends_sentence, capacity, sentence_penalty, hard_penalty)
        cuts = places[cut_windows(places, cost, capacity)]
        if last:
            begin = int(cuts[-2]) if len(cuts) > 1 else 0
            tail = len(ids) - begin
            parts = powers(tail)
            if (len(parts) - 1) * hard_penalty < capacity - tail:
                cuts = np.concatenate([cuts[:-1], begin + np.array([*accumulate(parts)])])
        else:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        if done:
            starts = np.concatenate([[0], doc_ends[:-1]])
            edges = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends < done], starts[starts < done]]))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(starts, a, "right") - 1
            window = np.searchsorted(cuts, a, "right")
            opened = np.concatenate([[0], cuts])[window]
            wide = ids[:done].astype("<u4")
            before = np.array([d[2] for d in docs])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([d[0] for d in docs], pa.int64()).take(pa.array(doc)),
                    pa.array(before[doc] + a - starts[doc]),
                    pa.array(b - a),
                    pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(wide)]),
                    pa.array(np.array([d[1] for d in docs], np.int64)[doc]),
                    pa.array(sequence + window),
                    pa.array(a - opened),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts)
        first = int(np.searchsorted(doc_ends, done, "right"))
        rest = docs[first:]
        if rest and done:
            i, n, gone, left = rest[0]
            cut = done - (int(doc_ends[first - 1]) if first else 0)
            rest[0] = (i, n, gone + cut, left[cut * tok.dtype.itemsize :])
        docs, held = rest, len(ids) - done
        return out if done else None

    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        doc_ids = batch.column("doc_id").to_pylist()
        for a, b in slices(off):
            ids, size = tok.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            data, ends = ids.tobytes(), np.cumsum(size) * tok.dtype.itemsize
            for k, n, to in zip(range(a, b), size.tolist(), ends.tolist(), strict=True):
                docs.append((doc_ids[k], n + 1, 0, data[to - n * tok.dtype.itemsize : to] + end))
                held += n + 1
                if held >= BLOCK_TOKENS and (out := flush(False)) is not None:
                    yield out
    while docs:
        if (out := flush(True)) is not None:
            yield out


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096,
    sentence_penalty: float = 2.0, hard_penalty: float = 8.0, doc_id: str | Column = "doc_id",
    text: str | Column = "text"
) -> DataFrame:
    """One row for each piece of a document: its place in the document and in its sequence, and its token ids
    (``ids``: little-endian unsigned 32-bit numbers).  No shuffle: partitions are packed on their own, in their order.
    A null doc_id stays null."""
    from functools import partial

    col = lambda c: F.col(c) if isinstance(c, str) else c
    kernel = partial(_pack_partition, path=tokenizer_path, end_id=end_id, capacity=capacity, sentence_penalty=sentence_penalty, hard_penalty=hard_penalty)
    return docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text")).mapInArrow(kernel, SCHEMA)
