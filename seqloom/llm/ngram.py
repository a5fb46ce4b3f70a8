"""Language-model scoring with a trie of word 1-, 2- and 3-grams in Elias-Fano levels (operator 1).

Level 1 has the training words by hash; a word's place in the order of hashes is its id, and running sums give exact counts.
Level 2 has each word's successors by id, level 3 each pair's successors.  A level is three sequences: where each parent's
children begin (monotone pointers), the children's ids, made monotone by adding the last value before the parent's first child,
and one byte each for the quantised logarithms of the smoothed probability and of the backed-off weight.  At level 3 a child's
id is its place among the children of its own context at level 2 (the middle word), which is a much smaller number.  A look-up
asks for the successor of (last value before the range + id) and compares.

Probabilities are discounted and interpolated, so that each context's sum to 1.  Every gram of the training texts is kept.

Words are counted by partial sums in each task and one shuffle.  Triples (pairs are their prefixes) are counted once more over
the texts: each task sorts the grams of about a megabyte of text and hands on a sorted block of them for each shard.  A shard is a
range of pairs that holds some SHARD_TOKENS tokens: whole words, or, for a word that occurs more often, a range of its
successors, so that no task gets a frequent word alone.  Only a pair's own successors always meet in one task, each once for a
megabyte of text.  A shard's levels are written to the shared folder by one task each; scoring tasks map them into memory (or an
unlinked local copy, where the folder isn't mounted).  Nothing of the model passes through the driver but some numbers a shard.

Edge cases: a null or empty text is the end token alone; a word not seen in training has the unigram's reserved share; with no
training rows every token has it; repeated rows repeat; a null doc_id stays null; an empty table gives no rows; other columns are
ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano
from .kernels import U, column_bytes, mix, slices, words
from .shared import local_copy, remove, stage, write_bytes

END = mix(np.array([0x5E], U))[0]
SHARD_WORDS = 1 << 17
SHARD_TOKENS = 1 << 20
GROUP_BYTES = 1 << 20  # of text that is counted at once; scored, twice as much
CHUNK = 1 << 17
NONE = (1 << 32) - 1  # in place of a third word: the text ends
DISCOUNTS = (0.5, 0.75, 0.75)
SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- files -------------------------------------------------------------------------------------------------------------


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that says where each array lies, then the arrays at multiples of 64."""
    at, head = 0, {}
    for k, v in arrays.items():
        head[k] = [at, str(v.dtype), len(v)]
        at += -(-v.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    parts: list = [line]
    for v in arrays.values():
        parts += [np.ascontiguousarray(v).tobytes(), bytes(-v.nbytes % 64)]
    write_bytes(uri, parts)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    place = local_copy(uri)
    with open(place, "rb", closefd=True) as f:
        line = f.readline()
        whole = np.asarray(np.memmap(f, np.uint8, "r"))  # still mapped, without the subclass's cost for each slice
    return {k: whole[len(line) + at : len(line) + at + n * np.dtype(t).itemsize].view(t) for k, (at, t, n) in json.loads(line).items()}


def fields(name: str, sequence: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in sequence.arrays().items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*(arrays[f"{name}.{k}"] for k in EliasFano.FIELDS))


def quantise(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Bytes that stand for 256 values: half of them quantiles, half in equal steps, so that no error is over half a step."""
    book = np.zeros(256)
    if len(values):
        book = np.sort(np.concatenate([np.quantile(values, np.linspace(0, 1, 128)), np.linspace(values.min(), values.max(), 128)]))
    book = book.astype(np.float32)
    return {f"{name}.code": np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8), f"{name}.book": book}


def shift(parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Monotone values for children in order of parents: each parent's begin above the last one before them."""
    if not len(ids):
        return ids.astype(U)
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    last = np.append(first[1:], len(ids)) - 1
    base = np.concatenate([[0], np.cumsum(ids[last].astype(np.int64) + 1)[:-1]])
    return (ids.astype(np.int64) + np.repeat(base, np.diff(np.append(first, len(ids))))).astype(U)


def starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)


def find(level: dict, sec: np.ndarray, parents: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For children ``ids`` (-1: none asked for) of parents, sorted by section and parent: their places in the section, -1 where
    there is none, and where each parent's children begin.  A parent's range and the value before it are read once."""
    run = np.flatnonzero((np.diff(parents, prepend=-1) != 0) | (np.diff(sec, prepend=-1) != 0))
    own, of = parents[run], sec[run]
    lo, hi = (x.astype(np.int64) for x in level["first"].get_two(own, of))
    base = np.zeros(len(own), U)
    later = np.flatnonzero((lo > 0) & (lo < hi))
    base[later] = level["next"].get(lo[later] - 1, of[later]) + U(1)
    which = np.zeros(len(parents), np.int64)
    which[run[1:]] = 1
    which = np.cumsum(which)
    out = np.full(len(parents), -1, np.int64)
    asked = np.flatnonzero((ids >= 0) & (lo < hi)[which])
    out[asked] = level["next"].locate(base[which[asked]] + ids[asked].astype(U), hi[which[asked]], sec[asked])
    return out, lo[which]


# --- the trie ----------------------------------------------------------------------------------------------------------


def span(shards: int) -> int:
    """How many shards lie in one file: enough files for many tasks, but not so many that each look-up has a few queries."""
    return max(1, min(64, -(-shards // 32)))


class Trie:
    """Files of shards as they are needed; ``upto``: the levels that are there."""

    def __init__(self, folder: str, bits: int, tokens: int, upto: int):
        self.folder, self.bits, self.tokens = folder, bits, tokens
        index = load(f"{folder}/index1.bin")
        self.word_base = np.concatenate([[0], np.cumsum(index["words"])]).astype(np.int64)
        self.size = int(self.word_base[-1])
        self.bounds = index["bounds"]  # first word << 32 | second word where each shard of pairs begins
        self.low = (self.bounds >> U(32)).astype(np.int64)
        after = np.append(self.bounds[1:], U(self.size << 32)) if len(self.bounds) else self.bounds
        self.words_in = ((after - U(1)) >> U(32)).astype(np.int64) - self.low + 1
        self.part = np.diff(self.low, prepend=-1) == 0  # of a frequent word's successors, but the first part
        self.spans = {1: span(1 << bits), 2: span(len(self.bounds)), 3: span(len(self.bounds))}
        if upto > 1:
            self.pair_base = np.concatenate([[0], np.cumsum(load(f"{folder}/index2.bin")["pairs"])]).astype(np.int64)
            first = np.maximum.accumulate(np.where(self.part, 0, np.arange(len(self.low))))
            self.begin = self.pair_base[:-1][first]  # the place of the first pair of a shard's first word
        self._open: dict[tuple[int, int], dict] = {}

    def children(self, k: int) -> int:
        """How many successors the first word of a shard has, in all shards."""
        last = k
        while last + 1 < len(self.low) and self.low[last + 1] == self.low[k]:
            last += 1
        return int(self.pair_base[last + 1] - self.begin[k])

    def file(self, level: int, m: int) -> dict:
        if (level, m) not in self._open:
            arrays = load(f"{self.folder}/level{level}-{m}.bin")
            names = {n.split(".")[0] for n in arrays if n.endswith(".zeros")}
            self._open[level, m] = arrays | {n: sequence(arrays, n) for n in names}
        return self._open[level, m]

    def by_file(self, level: int, shards: np.ndarray) -> Iterator[tuple[dict, slice, np.ndarray]]:
        """For sorted shards: a file of the level, the rows in it, and their sections there."""
        wide = self.spans[level]
        files = shards // wide
        at = starts(files)
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(files)], strict=True):
            m = int(files[lo])
            yield self.file(level, m), slice(lo, hi), shards[lo:hi] - m * wide

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not seen) and counts of sorted hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if not self.size:
            return ids, counts
        top = (h >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for s, rows, sec in self.by_file(1, top):
            place = s["hash"].locate(h[rows], sec=sec)
            hit = np.flatnonzero(place >= 0)
            before, upto = s["sum"].get_two(place[hit], sec[hit])
            ids[rows][hit] = place[hit] + self.word_base[top[rows][hit]]
            counts[rows][hit] = (upto - before).astype(np.int64)
        return ids, counts

    def one(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the unigram shares."""
        n = max(self.tokens, 1)
        reserved = DISCOUNTS[0] * self.size / n if self.size else 1.0
        return np.log10(np.maximum(counts - DISCOUNTS[0], 0) / n + reserved / (self.size + 1))

    def shard_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, a.astype(U) << U(32) | b.astype(U), "right") - 1

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sorted pairs of ids (a second one of -1: none): the pair's place (-1: none), its log10 share, log10 of the first
        word's backed-off weight, and the place of the first word's first pair."""
        place, share, back = np.full(len(a), -1, np.int64), np.zeros(len(a)), np.zeros(len(a))
        k = self.shard_of(a, np.maximum(b, 0))
        begin, local = self.begin[k], a - self.low[k]
        for s, rows, sec in self.by_file(2, k):
            own, of = local[rows], k[rows]
            back[rows] = s["back.book"][sec * 256 + s["back.code"][s["parents_at"][sec] + own]]
            at, lo = find(s, sec, own, b[rows])
            begin[rows] = np.where(own == 0, begin[rows], lo + self.pair_base[of])
            hit = np.flatnonzero(at >= 0)
            place[rows][hit] = at[hit] + self.pair_base[of[hit]]
            share[rows][hit] = s["share.book"][sec[hit] * 256 + s["share.code"][s["children_at"][sec[hit]] + at[hit]]]
        return place, share, back, begin

    def triples(self, pair: np.ndarray, relative: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs' places (sorted) and third words' places among the middle word's pairs (-1: none): whether the triple is
        there, its log10 share, and log10 of the pair's backed-off weight."""
        there, share, back = np.zeros(len(pair), bool), np.zeros(len(pair)), np.zeros(len(pair))
        k = np.searchsorted(self.pair_base, pair, "right") - 1
        local = pair - self.pair_base[k]
        for s, rows, sec in self.by_file(3, k):
            own = local[rows]
            at, _ = find(s, sec, own, relative[rows])
            back[rows] = s["back.book"][sec * 256 + s["back.code"][s["parents_at"][sec] + own]]
            hit = np.flatnonzero(at >= 0)
            there[rows][hit] = True
            share[rows][hit] = s["share.book"][sec[hit] * 256 + s["share.code"][s["children_at"][sec[hit]] + at[hit]]]
        return there, share, back


@lru_cache(1)
def _trie(state: str) -> Trie:
    return Trie(**json.loads(state))


# --- tokens ------------------------------------------------------------------------------------------------------------


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and of the end after them, and their numbers."""
    parts = [words(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off)]
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    out = np.full(len(h) + len(n), END, U)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, n + 1


def groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        for a, b in slices(off, most):
            h, n = tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            yield batch.slice(a, b - a), h, n


def distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of one or two number columns (from 0 on) in order, and each row's place among them."""
    if len(keys) == 1:
        own, back = np.unique(keys[0], return_inverse=True)
        return [own], back
    width = int(keys[1].max(initial=0)).bit_length()
    if int(keys[0].max(initial=0)).bit_length() + width > 63:
        table, back = np.unique(np.stack(keys, 1), axis=0, return_inverse=True)
        return [table[:, 0], table[:, 1]], back.ravel()
    own, back = np.unique(keys[0] << width | keys[1], return_inverse=True)
    return [own >> width, own & ((1 << width) - 1)], back


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, h, _ in groups(batches):
        own, many = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(many)], ["h", "n"])


def planes(ids: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte: compression then takes the high bytes, which seldom change."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def pack(columns: list[np.ndarray], many: np.ndarray) -> bytes:
    """Some grams: three columns of ids, and counts in one or four bytes; compressed, behind the number of grams and that width."""
    wide = 4 if int(many.max()) > 255 else 1
    head = np.array([len(many), wide], "<u4").tobytes()
    return head + pa.compress(b"".join([*map(planes, columns), many.astype(f"<u{wide}").tobytes()]), codec="zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(block, "<u4", 2).tolist()
    data = pa.decompress(block[8:], (12 + wide) * n, codec="zstd", asbytes=True)
    return *(unplaned(data, n, 4 * n * k) for k in range(3)), np.frombuffer(data, f"<u{wide}", n, 12 * n).astype(np.int64)


def squeeze(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.compress(data, codec="zstd", asbytes=True), np.uint8)


def _count_triples(batches: Iterator[pa.RecordBatch], state: str) -> Iterator[pa.RecordBatch]:
    """For each token one gram: the token before it, itself, and the next one or NONE; a block for each shard."""
    trie = _trie(state)
    for _, h, n in groups(batches):
        own, back = np.unique(h, return_inverse=True)
        ids = np.append(trie.words(own)[0], NONE)
        first = np.cumsum(n) - n
        before, after = np.roll(back, 1), np.roll(back, -1)
        before[first] = np.searchsorted(own, END)
        after[first - 1] = len(own)
        width = len(own).bit_length()
        if 3 * width <= 64:
            key, many = np.unique((before.astype(U) << U(width) | back.astype(U)) << U(width) | after.astype(U), return_counts=True)
            grams = [(key >> U(2 * width)), key >> U(width) & U((1 << width) - 1), key & U((1 << width) - 1)]
        else:
            table, many = np.unique(np.stack([before, back, after], 1), axis=0, return_counts=True)
            grams = [*table.T]
        a, b, c = (ids[g.astype(np.int64)] for g in grams)
        shards = trie.shard_of(a, b)
        at = starts(shards)
        found = [(int(shards[i]), pack([a[i:j], b[i:j], c[i:j]], many[i:j])) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(shards)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["shard", "grams"])


# --- building shards ---------------------------------------------------------------------------------------------------


def _build_words(table: pa.Table, folder: str, bits: int, shard_tokens: int) -> pa.Table:
    """Level 1 of one shard.  Returns (shard, at, parts): how many words it has (at = -1), and at which of them a shard of
    pairs begins and in how many parts that word's successors are."""
    h, n = table["h"].to_numpy().view(U), table["n"].to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    k = int(h[0] >> U(64 - bits)) if bits else 0
    total = np.concatenate([[0], np.cumsum(n)])
    save(f"{folder}/parts/level1-{k}.bin", fields("hash", EliasFano.build(h)) | fields("sum", EliasFano.build(total)))
    often = n > shard_tokens
    begin = np.diff(total[:-1] // shard_tokens, prepend=-1) != 0
    begin |= often | np.roll(often, 1)
    begin[0] = True
    at = np.flatnonzero(begin)
    parts = np.where(often[at], -(-n[at] // shard_tokens), 1)
    return pa.table({"shard": pa.array(np.full(len(at) + 1, k, np.int64)), "at": pa.array(np.append(-1, at)), "parts": pa.array(np.append(len(h), parts))})


def _build_pairs(table: pa.Table, folder: str, state: str) -> pa.Table:
    """Structure and counts of one shard of level 2, and its triples for the next step.  Returns (shard, pairs)."""
    trie, k = _trie(state), int(table["shard"][0].as_py())
    a, b, c, n = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in table["grams"]), strict=True))
    pair = (a.astype(np.int64) - trie.low[k]) << 32 | b
    order = np.lexsort((c, pair))
    pair, c, n = pair[order], c[order], n[order]
    first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(c.astype(np.int64), prepend=-1) != 0))
    pair, c, n = pair[first], c[first], np.add.reduceat(n, first)
    at = starts(pair)
    pairs, total = pair[at], np.add.reduceat(n, at)
    third = c != NONE
    a, b = pairs >> 32, pairs & ((1 << 32) - 1)
    save(
        f"{folder}/parts/level2-{k}.bin",
        fields(
            "first", EliasFano.build(np.searchsorted(a, np.arange(trie.words_in[k] + 1)))
        ) | fields("next", EliasFano.build(shift(a, b))) | fields("sum", EliasFano.build(np.concatenate([[0], np.cumsum(total)])))
    )
    save(
        f"{folder}/parts/grams-{k}.bin",
        {
            "size": np.array([third.sum()]),
            "of": squeeze(np.add.reduceat(third.astype("<u4"), at, dtype="<u4").tobytes()),
            "third": squeeze(planes(c[third])), "n": squeeze(n[third].astype("<u8").tobytes())
        }
    )
    return pa.table({"shard": pa.array([k], pa.int64()), "pairs": pa.array([len(pairs)], pa.int64())})


def part(trie: Trie, level: int, k: int) -> dict:
    arrays = load(f"{trie.folder}/parts/level{level}-{k}.bin")
    return {n: sequence(arrays, n) for n in {n.split(".")[0] for n in arrays}}


def members(level: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each child's parent and id, in order, of a part."""
    first = level["first"].get(np.arange(level["first"].n[0])).astype(np.int64)
    value = level["next"].get(np.arange(level["next"].n[0]))
    before = np.concatenate([[0], value + U(1)]).astype(U)[first[:-1]]
    size = np.diff(first)
    return np.repeat(np.arange(len(size)), size), (value - np.repeat(before, size)).astype(np.int64)


def counts_of(trie: Trie, ids: np.ndarray) -> np.ndarray:
    """Counts of sorted word ids."""
    out = np.zeros(len(ids), np.int64)
    k = np.searchsorted(trie.word_base, ids, "right") - 1
    for s, rows, sec in trie.by_file(1, k):
        before, upto = s["sum"].get_two(ids[rows] - trie.word_base[k[rows]], sec)
        out[rows] = (upto - before).astype(np.int64)
    return out


def _join_words(trie: Trie, shards: range, m: int) -> None:
    """A file of level 1."""
    nothing = {"hash": EliasFano.build(np.zeros(0, U)), "sum": EliasFano.build(np.zeros(1, U))}
    parts = [part(trie, 1, k) if trie.word_base[k + 1] > trie.word_base[k] else nothing for k in shards]
    save(f"{trie.folder}/level1-{m}.bin", fields("hash", EliasFano.join([p["hash"] for p in parts])) | fields("sum", EliasFano.join([p["sum"] for p in parts])))


def _save_level(trie: Trie, level: int, m: int, sections: list[tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]]) -> None:
    """A file of pointers, children, and the children's shares and the parents' weights, by section."""
    first, following, shares, weights = zip(*sections, strict=True)
    coded = {}
    for name, values in (("share", shares), ("back", weights)):
        each = [quantise(v, name) for v in values]
        coded |= {f: np.concatenate([e[f] for e in each]) for f in each[0]}
    at = lambda values: np.cumsum([0, *map(len, values)])[:-1].astype(np.int64)
    save(
        f"{trie.folder}/level{level}-{m}.bin",
        fields("first", EliasFano.join(first)) | fields("next", EliasFano.join(following)) | coded | {
            "children_at": at(shares), "parents_at": at(weights)
        }
    )


def _join_pairs(trie: Trie, shards: range, m: int) -> None:
    """A file of level 2."""
    sections = []
    for k in shards:
        own = counts_of(trie, trie.low[k] + np.arange(trie.words_in[k]))
        share, children = np.zeros(0), np.array([trie.children(k)])
        if trie.pair_base[k + 1] > trie.pair_base[k]:
            s = part(trie, 2, k)
            a, b = members(s)
            n = np.diff(s["sum"].get(np.arange(s["sum"].n[0])).astype(np.int64))
            if len(own) > 1:  # a word alone may have other parts
                children = np.bincount(a, minlength=len(own))
            (other,), back = distinct(b)
            low = (10 ** trie.one(counts_of(trie, other)))[back]
            share = np.log10((n - DISCOUNTS[1]) / own[a] + DISCOUNTS[1] * children[a] / own[a] * low)
        else:
            s = {"first": EliasFano.build(np.zeros(len(own) + 1, U)), "next": EliasFano.build(np.zeros(0, U))}
        sections.append((s["first"], s["next"], share, np.log10(np.clip(DISCOUNTS[1] * children / own, 1e-7, 1))))
    _save_level(trie, 2, m, sections)


def _triples(trie: Trie, k: int) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
    """A section of level 3."""
    if trie.pair_base[k + 1] == trie.pair_base[k]:
        return EliasFano.build(np.zeros(1, U)), EliasFano.build(np.zeros(0, U)), np.zeros(0), np.zeros(0)
    grams = load(f"{trie.folder}/parts/grams-{k}.bin")
    middle, size = members(part(trie, 2, k))[1], int(grams["size"][0])
    loose = lambda name, width, rows: pa.decompress(grams[name].tobytes(), width * rows, codec="zstd", asbytes=True)
    of, n = np.frombuffer(loose("of", 4, len(middle)), "<u4").astype(np.int64), np.frombuffer(loose("n", 8, size), "<u8").astype(np.int64)
    third = unplaned(loose("third", 4, size), size).astype(np.int64)
    pair = np.repeat(np.arange(len(of)), of)
    (b, c), back = distinct(middle[pair], third)
    relative, low = np.zeros(len(b), np.int64), np.zeros(len(b))
    for at in range(0, len(b), CHUNK):
        r = slice(at, at + CHUNK)
        place, low[r], _, begin = trie.pairs(b[r], c[r])
        relative[r] = place - begin
    own = np.bincount(pair, n, len(of))
    weight = np.where(of > 0, DISCOUNTS[2] * of / np.maximum(own, 1), 1.0)
    share = np.log10((n - DISCOUNTS[2]) / own[pair] + weight[pair] * 10 ** low[back])
    return EliasFano.build(np.concatenate([[0], np.cumsum(of)])), EliasFano.build(shift(pair, relative[back])), share, np.log10(np.maximum(weight, 1e-7))


def _join_triples(trie: Trie, shards: range, m: int) -> None:
    """A file of level 3."""
    _save_level(trie, 3, m, [_triples(trie, k) for k in shards])


def _each(batches: Iterator[pa.RecordBatch], state: str, what, shards: int) -> Iterator[pa.RecordBatch]:
    trie, wide = _trie(state), span(shards)
    for batch in batches:
        for m in batch.column("id").to_pylist():
            what(trie, range(m * wide, min((m + 1) * wide, shards)), m)
        yield batch


def _files(spark, state: str, what, shards: int) -> None:
    """A task for each file of a level."""
    files = -(-shards // span(shards))
    spark.range(0, files, 1, files).mapInArrow(partial(_each, state=state, what=what, shards=shards), "id long").write.format("noop").mode("overwrite").save()


def train(docs: DataFrame, folder: str, shard_tokens: int = SHARD_TOKENS) -> str:
    """Count, build and write the trie of the documents' texts; returns its state, a short string.

    ``shard_tokens`` bounds a building task's memory (some 150 bytes a token); scoring is faster with fewer, larger shards."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = stage(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), f"{folder}/words")
    size, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size >> 31:
        raise ValueError("more than 2**31 words: ids have 32 bits")
    bits = max(0, (size // SHARD_WORDS).bit_length())
    state = lambda upto: json.dumps({"folder": folder, "bits": bits, "tokens": int(total), "upto": upto})

    top = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    built = counted.withColumn("shard", top).groupBy("shard").applyInArrow(
        lambda t: _build_words(t, folder, bits, shard_tokens), "shard long, at long, parts long"
    ).collect()
    words, bounds = np.zeros(1 << bits, np.int64), []
    for r in built:
        if r.at < 0:
            words[r.shard] = r.parts
    base = np.cumsum(words) - words
    for r in sorted(r for r in built if r.at >= 0):
        bounds += [int(base[r.shard] + r.at) << 32 | j * size // r.parts for j in range(r.parts)]
    save(f"{folder}/index1.bin", {"words": words, "bounds": np.array(bounds, U)})
    remove(spark, f"{folder}/words")
    if bounds:
        _files(spark, state(1), _join_words, 1 << bits)

    first = state(1)
    blocks = texts.mapInArrow(partial(_count_triples, state=first), "shard long, grams binary")
    found = blocks.groupBy("shard").applyInArrow(lambda t: _build_pairs(t, folder, state=first), "shard long, pairs long").collect()
    pairs = np.zeros(len(bounds), np.int64)
    for k, n in found:
        pairs[k] = n
    save(f"{folder}/index2.bin", {"pairs": pairs})
    if bounds:
        for what in (_join_pairs, _join_triples):
            _files(spark, state(2), what, len(bounds))
        remove(spark, f"{folder}/parts")
    return state(3)


def _look_up(trie: Trie, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's count and log10 probability."""
    (own,), back = distinct(h)
    ids, counts = trie.words(own)
    ids, counts = ids[back], counts[back]
    first = np.cumsum(n) - n
    end = np.searchsorted(own, END)
    before = np.roll(ids, 1)
    before[first] = ids[np.flatnonzero(h == END)[0]] if end < len(own) and own[end] == END else -1
    out = trie.one(counts)
    asked = np.flatnonzero(before >= 0)
    if not len(asked):
        return counts, out
    (a, b), back = distinct(before[asked], ids[asked] + 1)
    place, share, weight, begin = trie.pairs(a, b - 1)
    there = (place >= 0)[back]
    out[asked] = np.where(there, share[back], weight[back] + out[asked])
    # the pair of the two words before, and the word's place among the successors of the word before
    context, relative = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
    context[asked] = place[back]
    relative[asked] = np.where(there, (place - begin)[back], -1)
    context = np.roll(context, 1)
    context[first] = -1
    deep = np.flatnonzero(context >= 0)
    if len(deep):
        (pair, third), back = distinct(context[deep], relative[deep] + 1)
        there, share, weight = trie.triples(pair, third - 1)
        out[deep] = np.where(there[back], share[back], weight[back] + out[deep])
    return counts, out


def _score(batches: Iterator[pa.RecordBatch], state: str) -> Iterator[pa.RecordBatch]:
    trie = _trie(state)
    for batch, h, n in groups(batches, 2 * GROUP_BYTES):
        counts, own = _look_up(trie, h, n)
        base = np.log10((counts + 1) / (trie.tokens + trie.size + 1))
        at = np.cumsum(n) - n
        total = lambda x: np.add.reduceat(x, at)  # noqa: B023,E731  a text has one token at least
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n), pa.array(total((counts > 0).astype(np.int64))),
                pa.array(np.full(len(n), trie.tokens, np.int64)), pa.array(total(base)), pa.array(total(own))
            ],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, state: str) -> DataFrame:
    """Each whole text's numbers of tokens and known tokens, add-one unigram score and the model's log10 probability."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cols.mapInArrow(partial(_score, state=state), SCORED)
