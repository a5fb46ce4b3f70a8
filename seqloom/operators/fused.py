"""All modules' counts from one pass over the reads.

Each task walks its Arrow batches once and keeps a small tally for every module; at its end, or when a tally has grown, it hands on
tagged rows (file, kind, three numbers and a text as key, two sums).  One shuffle adds equal keys up, and every module's table
follows from its own kind of rows.  So the reads are scanned, moved to Python and parsed once for the whole report.

Sampling needs a read's ordinal among the unfiltered ones of its worker.  It follows from the read's place, less the filtered
reads before it: these are sought first (nothing is read where none can be filtered), and as sorted numbers they travel to the
tasks.  Beyond SKIPS_MOST of them, or where places aren't dense, the modules' own operators are asked instead."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.columns import NOTHING, Counts, base_counts, column_bytes, file_runs, slices
from .common import BATCH, WORKERS
from .positions import TILE_EVERY, TILE_MOST, add_tiles, merged_tiles
from .sequences import EARLY_MOST, KEY_SPAN, KMER_EVERY, KMER_PART, first_keys

SKIPS_MOST = 4_000_000  # sorted numbers of 8 bytes
FEW_ROWS = 300_000
REACH = 1024  # above KMER_PART
REACHES_KEPT = 1 << 17
KEYS_KEPT = 250_000  # distinct keys that a task holds before it hands them on
KEYS_WAITING = 1 << 16  # rows that are merged at least
EVERY = ("basic", "cube", "tile", "mean", "gc", "length", "key", "adapter", "kmer")
SCHEMA = "file_name string, kind string, a long, b long, c long, text string, n long, s long"
_names = [c.split()[0] for c in SCHEMA.split(", ")]
_gc = np.zeros(256, bool)
_gc[[*b"GC"]] = True
_code = np.full(256, 4, np.uint8)
_code[[*b"ACGT"]] = range(4)


def skips(reads: DataFrame) -> dict[str, np.ndarray] | None:
    """For each file the sorted places of its filtered reads; None if these are too many to travel."""
    found = reads.where("is_filtered").select("file_name", "read_idx").limit(SKIPS_MOST + 1).toArrow()
    if len(found) > SKIPS_MOST:
        return None
    found = found.sort_by([("file_name", "ascending"), ("read_idx", "ascending")])
    idx = found["read_idx"].to_numpy()
    return {name: idx[a:b] for name, a, b in file_runs(found["file_name"].combine_chunks())} if len(found) else {}


def ordinals(idx: np.ndarray, gone: np.ndarray | None, compat: bool) -> np.ndarray:
    """The 1-based ordinals of unfiltered reads among those of their worker (or file)."""
    if not compat:
        return idx + 1 - (0 if gone is None else np.searchsorted(gone, idx))
    batch = idx // BATCH
    out = batch // WORKERS * BATCH + idx % BATCH + 1
    if gone is not None:
        for w in range(WORKERS):
            own, theirs = batch % WORKERS == w, gone[gone // BATCH % WORKERS == w]
            out[own] -= np.searchsorted(theirs, idx[own])
    return out


@dataclass
class Rows:
    """Unfiltered reads of one file in a batch."""

    name: str
    idx: np.ndarray
    table: pa.RecordBatch
    seq: tuple[np.ndarray, np.ndarray]
    qual: tuple[np.ndarray, np.ndarray]
    gone: np.ndarray | None
    compat: bool

    def __post_init__(self):
        self.size, self.q_size = np.diff(self.seq[1]), np.diff(self.qual[1])
        self.worker = self.idx // BATCH % WORKERS if self.compat else np.zeros(len(self.idx), np.int64)
        self.gc_upto = np.concatenate([[0], np.cumsum(_gc[self.seq[0]])])


class Tally:
    """Whole-number keys (two numbers, the second below 2^31) by file."""

    def __init__(self, kind: str):
        self.kind, self.found = kind, Counts()

    def put(self, name: str, a: np.ndarray, b: np.ndarray | int) -> None:
        self.found.add(name, *np.unique(a.astype(np.int64) << 31 | b, return_counts=True))

    def rows(self) -> Iterator[tuple]:
        for name in self.found.parts:
            keys, n = self.found.merged(name)
            yield name, self.kind, {"a": keys >> 31, "b": keys & ((1 << 31) - 1), "n": n}


class Basic:
    """Sums, least and greatest values, by worker."""

    def __init__(self):
        self.sums: dict[tuple, int] = {}
        self.ends: dict[tuple, int] = {}

    def count(self, name: str, worker: np.ndarray, filtered: np.ndarray) -> None:
        for what, rows in (("total", ~filtered), ("filtered", filtered)):
            for w, n in enumerate(np.bincount(worker[rows], minlength=1).tolist()):
                self.sums[name, w, what] = self.sums.get((name, w, what), 0) + n

    def end(self, name: str, w: int, what: str, value: int) -> None:
        key = (name, w, what)
        self.ends[key] = (max if what in ("most", "coloured") else min)(self.ends.get(key, value), value)

    def add(self, r: Rows) -> None:
        for w in np.unique(r.worker).tolist():
            own = r.size[r.worker == w]
            self.end(r.name, w, "least", int(own.min()))
            self.end(r.name, w, "most", int(own.max()))
        letters = np.bincount(r.seq[0], minlength=256)
        for what, n in (("bases", len(r.seq[0])), ("gc", int(letters[[*b"GC"]].sum())), ("acgt", int(letters[[*b"ACGT"]].sum()))):
            self.sums[r.name, 0, what] = self.sums.get((r.name, 0, what), 0) + n
        if r.table.column("colorspace").null_count < len(r.idx):
            self.end(r.name, 0, "coloured", 1)
        both = (r.size > 0) & (r.q_size > 0)
        code = r.qual[0] if both.all() else r.qual[0][np.repeat(both, r.q_size)]
        if len(code):
            self.end(r.name, 0, "lowest", int(code.min()))

    def rows(self) -> Iterator[tuple]:
        for (name, w, what), n in [*self.sums.items(), *self.ends.items()]:
            yield name, "basic", {"a": [w], "text": [what], "n": [n]}


class Cube:
    def __init__(self):
        self.found = Counts()

    def add(self, r: Rows) -> None:
        self.found.add(r.name, *base_counts(r.seq, r.qual, 0, len(r.idx)))

    def rows(self) -> Iterator[tuple]:
        for name in self.found.parts:
            keys, n = self.found.merged(name)
            yield name, "cube", {"a": keys >> 18, "b": keys >> 9 & 511, "c": keys & 511, "n": n}


class Lengths(Tally):
    def add(self, r: Rows) -> None:
        self.put(r.name, r.size, 0)


class Gc(Tally):
    """Reads by the length of the part that counts, and G and C in it."""

    def add(self, r: Rows) -> None:
        part = np.where(r.size > 1000, r.size // 1000 * 1000, np.where(r.size > 100, r.size // 100 * 100, r.size))
        start = r.seq[1][:-1]
        self.put(r.name, part, r.gc_upto[start + part] - r.gc_upto[start])


class Means(Tally):
    """Reads by whole mean code."""

    def add(self, r: Rows) -> None:
        some = np.flatnonzero(r.q_size)
        if len(some):
            sums = np.add.reduceat(r.qual[0], r.qual[1][some], dtype=np.int64)
            self.put(r.name, sums // r.q_size[some], 0)
            least = int(r.qual[0].min())
            self.least = {**getattr(self, "least", {}), r.name: min(getattr(self, "least", {}).get(r.name, 255), least)}

    def rows(self) -> Iterator[tuple]:
        for name, kind, columns in super().rows():
            yield name, kind, columns | {"c": np.full(len(columns["n"]), self.least[name])}


class Adapters:
    """Reads by the first place of each adapter (from 0 on), and by length as adapter -1."""

    def __init__(self, adapters: list[tuple[str, str]]):
        self.adapters, self.found = [s for _, s in adapters], Counts()

    def add(self, r: Rows) -> None:
        key = lambda k, at, w: (w << 8 | k + 1) << 31 | at
        self.found.add(r.name, *np.unique(key(-1, r.size, r.worker), return_counts=True))
        for k, s in enumerate(self.adapters):
            at = pc.find_substring(r.table.column("sequence"), s).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = at >= 0
            if hit.any():
                self.found.add(r.name, *np.unique(key(k, at[hit], r.worker[hit]), return_counts=True))

    def rows(self) -> Iterator[tuple]:
        for name in self.found.parts:
            keys, n = self.found.merged(name)
            yield name, "adapter", {"a": keys >> 39, "b": (keys >> 31 & 255) - 1, "c": keys & ((1 << 31) - 1), "n": n}


class Kmers:
    """k-mers by place, of each KMER_EVERY-th read's first bases: as two bits a base and one bincount; those with other letters as
    texts, and with N as places only.  Besides, by worker, how many places the first read that shows a k-mer has: one number of the
    read's place and these, so that the least number tells."""

    def __init__(self, k: int):
        self.k, self.found, self.blank, self.odd = k, Counts(), Counts(), {}
        self.first, self.odd_first = {}, {}  # by file: parts of (worker and code, number)

    def add(self, r: Rows) -> None:
        k = self.k
        pick = np.flatnonzero((ordinals(r.idx, r.gone, r.compat) % KMER_EVERY == 0) & (r.size >= k))
        if not len(pick):
            return
        pick = pick[np.argsort(r.idx[pick], kind="stable")]
        size = np.minimum(r.size[pick], KMER_PART)
        many = size - k + 1
        row = np.repeat(np.arange(len(pick)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin = r.seq[1][pick][row] + place
        code, other, blank = np.zeros(len(row), np.int64), np.zeros(len(row), bool), np.zeros(len(row), bool)
        for i in range(k):
            base = r.seq[0][begin + i]
            two = _code[base]
            code = code << 2 | two & 3
            other |= two > 3
            blank |= base == ord("N")
        own = ~other
        self.found.add(r.name, *np.unique(code[own] << 31 | place[own] + 1, return_counts=True))
        self.blank.add(r.name, *np.unique(place[blank] + 1, return_counts=True))
        shown, worker = (r.idx[pick] * REACH + many)[row], r.worker[pick][row]
        keys, at = np.unique((worker << 2 * k | code)[own], return_index=True)
        parts = self.first.setdefault(r.name, [])
        parts.append((keys, shown[own][at]))
        if sum(len(x) for x, _ in parts) > max(REACHES_KEPT, 2 * len(parts[0][0])):
            self.first[r.name] = [self.least(parts)]
        other &= ~blank
        for at, p, n, w in zip(begin[other].tolist(), place[other].tolist(), shown[other].tolist(), worker[other].tolist(), strict=True):
            text = r.seq[0][at : at + k].tobytes().decode()
            self.odd[r.name, text, p + 1] = self.odd.get((r.name, text, p + 1), 0) + 1
            self.odd_first[r.name, text, w] = min(self.odd_first.get((r.name, text, w), n), n)

    @staticmethod
    def least(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((numbers, keys))
        keys, at = np.unique(keys[order], return_index=True)
        return keys, numbers[order][at]

    def texts(self, codes: np.ndarray) -> pa.Array:
        codes, back = np.unique(codes, return_inverse=True)
        letters = np.frombuffer(b"ACGT", np.uint8)[codes[:, None] >> np.arange(2 * self.k - 2, -1, -2) & 3]
        return pa.array([t.tobytes().decode() for t in letters], pa.string()).take(pa.array(back))

    def rows(self) -> Iterator[tuple]:
        for name in self.found.parts:
            keys, n = self.found.merged(name)
            yield name, "kmer", {"a": keys & ((1 << 31) - 1), "text": self.texts(keys >> 31), "n": n}
            keys, n = self.least(self.first[name])
            yield name, "reach", {"a": keys >> 2 * self.k, "text": self.texts(keys & ((1 << 2 * self.k) - 1)), "n": n}
            keys, n = self.blank.merged(name)
            yield name, "kmer", {"a": keys, "n": n}
        for (name, text, place), n in self.odd.items():
            yield name, "kmer", {"a": [place], "text": [text], "n": [n]}
        for (name, text, w), n in self.odd_first.items():
            yield name, "reach", {"a": [w], "text": [text], "n": [n]}


class Keys:
    """Copies of each key, and the ordinal in the file of the first; handed on early where there are many."""

    def __init__(self, dup_length: int):
        self.dup_length, self.parts = dup_length, []
        self.waiting, self.least, self.turn = 0, 0, 0

    def add(self, r: Rows) -> None:
        text, d = r.table.column("sequence"), self.dup_length
        long = r.size > 50
        if d > 0:
            text = pc.if_else(pa.array(r.size > d), pc.utf8_slice_codeunits(text, 0, d), pc.if_else(pa.array(long), pc.utf8_slice_codeunits(text, 0, 50), text))
        elif long.any():
            text = pc.utf8_slice_codeunits(text, 0, 50)
        first = ordinals(r.idx, r.gone, False)
        self.parts.append(pa.table({"name": pa.array([r.name] * len(first), pa.string()).dictionary_encode().cast(pa.string()), "text": pc.cast(text, pa.string()), "n": np.ones(len(first), np.int64), "s": first}))
        self.waiting += len(first)
        if self.waiting > max(KEYS_WAITING, 2 * self.least):
            self.parts = [self.merged()]
            self.waiting = self.least = len(self.parts[0])

    def merged(self) -> pa.Table:
        found = pa.concat_tables(self.parts).group_by(["name", "text"], use_threads=False).aggregate([("n", "sum"), ("s", "min")])
        return found.rename_columns({"n_sum": "n", "s_min": "s"}).select(["name", "text", "n", "s"])

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            for b in self.merged().combine_chunks().to_batches(100_000):
                empty, turn = pa.nulls(len(b), pa.int64()), pa.array(np.full(len(b), self.turn))
                kind = pa.array(["key"] * len(b))
                yield pa.RecordBatch.from_arrays([b.column("name"), kind, turn, empty, empty, b.column("text"), b.column("n"), b.column("s")], _names)
        self.parts, self.waiting, self.least, self.turn = [], 0, 0, self.turn + 1


def _field(parts: pa.ListArray, n: int) -> pa.Array:
    """The n-th part of each as a whole number of 32 bits; null where there is none."""
    size = pc.list_value_length(parts).to_numpy()
    there = np.where(size >= n, np.asarray(parts.offsets)[:-1] + n - 1, 0)
    text = parts.values.take(pa.array(there, mask=size < n)).dictionary_encode()
    known = [int(t) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", t) and -(1 << 31) <= int(t) < 1 << 31 else None for t in text.dictionary.to_pylist()]
    return pa.array(known, pa.int32()).take(text.indices)


class Tiles:
    """Sums by (field of the id, tile, place) of sampled reads, for both fields that may have the tile.  Where reads lack qualities
    or tiles, have ids of different kinds, or very many tiles, workers may give up: such files are left to the tiles' operator."""

    def __init__(self, tile_all: int):
        self.tile_all, self.state, self.kinds, self.odd = tile_all, {5: ({}, {}, Counts()), 3: ({}, {}, Counts())}, {}, set()  # kinds: field by file

    def add(self, r: Rows) -> None:
        if not (r.q_size > 0).all():
            self.odd.add(r.name)
            return
        ordinal = ordinals(r.idx, r.gone, r.compat)
        pick = np.flatnonzero((ordinal <= self.tile_all) | (ordinal % TILE_EVERY == 0))
        if not len(pick):
            return
        rows = r.table.select(["quality", "id"]).take(pa.array(pick))
        qual = column_bytes(rows.column("quality"))
        parts = pc.split_pattern(rows.column("id").fill_null(""), ":")
        size = pc.list_value_length(parts).to_numpy()
        kinds = {0 if n < 5 else 3 if n < 7 else 5 for n in (int(size.min()), int(size.max()))}
        field = self.kinds.setdefault(r.name, min(kinds))
        if kinds != {field} or not field:
            self.odd.add(r.name)
            return
        tiles, lowest, found = self.state[field]
        add_tiles(r.name, _field(parts, field), *qual, tiles, lowest, found, TILE_MOST)

    def rows(self) -> Iterator[tuple]:
        for tiles, lowest, found in self.state.values():
            for name in tiles:
                if tiles[name] is None:
                    self.odd.add(name)
                    continue
                place, tile, n, s, least = merged_tiles(name, tiles, lowest, found)
                yield name, "tile", {"a": tile, "b": place, "c": np.full(len(n), least), "n": n, "s": s}
        for name, field in self.kinds.items():
            yield name, "field", {"a": [field], "n": [1]}
        for name in self.odd:
            yield name, "field", {"a": [-1], "n": [1]}


def _batch(name: str, kind: str, columns: dict) -> pa.RecordBatch:
    n = len(columns["n"])
    whole = [columns[c] if c in columns else None for c in ("a", "b", "c", "text", "n", "s")]
    arrays = [pa.nulls(n, k) if v is None else v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(whole, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([kind] * n, pa.string()), *arrays], _names)


@dataclass
class Kernel:
    """The walk over one task's batches."""

    config: QcConfig
    kinds: tuple[str, ...]
    gone: object  # broadcast: skips()
    adapters: list = field(default_factory=list)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, gone = self.config, self.gone.value
        makers = {
            "basic": Basic, "cube": Cube, "tile": lambda: Tiles(c.tile_all), "mean": lambda: Means("mean"), "gc": lambda: Gc("gc"),
            "length": lambda: Lengths("length"), "adapter": lambda: Adapters(self.adapters), "kmer": lambda: Kmers(c.kmer_size)
        }
        tallies = {k: makers[k]() for k in self.kinds if k != "key"}
        keys = Keys(c.dup_length) if "key" in self.kinds else None
        for batch in batches:
            filtered = batch.column("is_filtered").to_numpy(zero_copy_only=False).astype(bool)
            if "basic" in tallies:
                idx = batch.column("read_idx").to_numpy()
                for name, a, b in file_runs(batch.column("file_name")):
                    tallies["basic"].count(name, idx[a:b] // BATCH % WORKERS if c.compat else np.zeros(b - a, np.int64), filtered[a:b])
            own = batch.filter(pa.array(~filtered)) if filtered.any() else batch
            for name, a, b in file_runs(own.column("file_name")) if len(own) else ():
                part = own.slice(a, b - a)
                idx, (s, s_off), (q, q_off) = part.column("read_idx").to_numpy(), column_bytes(part.column("sequence")), column_bytes(part.column("quality"))
                for u, v in slices(s_off, q_off):
                    seq, qual = (s[s_off[u] : s_off[v]], s_off[u : v + 1] - s_off[u]), (q[q_off[u] : q_off[v]], q_off[u : v + 1] - q_off[u])
                    r = Rows(name, idx[u:v], part.slice(u, v - u), seq, qual, gone.get(name), c.compat)
                    for t in tallies.values():
                        t.add(r)
                    if keys:
                        keys.add(r)
            if keys and keys.waiting > KEYS_KEPT:
                yield from keys.take()
        for t in tallies.values():
            for row in t.rows():
                yield _batch(*row)
        if keys:
            yield from keys.take()


def partials(reads: DataFrame, config: QcConfig, kinds: tuple[str, ...], gone: dict[str, np.ndarray]) -> DataFrame:
    """The tasks' tagged rows, not added up yet."""
    rows = reads.select("file_name", "read_idx", "is_filtered", "sequence", "quality", "colorspace", *(["id"] if "tile" in kinds else []))
    return rows.mapInArrow(Kernel(config, kinds, reads.sparkSession.sparkContext.broadcast(gone), config.adapters), SCHEMA)


def together(rows: DataFrame) -> DataFrame:
    """Few rows (counted) in one partition: what is derived from them needs no further shuffle."""
    return rows.coalesce(1) if rows.count() <= FEW_ROWS else rows


class Fused:
    """One pass over the reads for ``kinds`` of rows; each method gives what an operator would have counted itself."""

    def __init__(self, reads: DataFrame, config: QcConfig, gone: dict[str, np.ndarray], kinds: tuple[str, ...] = EVERY):
        self.config = config
        self.raw = partials(reads, config, kinds, gone).persist(StorageLevel.MEMORY_AND_DISK)
        by = ["file_name", "kind", "a", "b", "c", "text"]
        ends = F.col("text").isin("least", "lowest")
        tops = F.col("text").isin("most", "coloured")
        value = F.when((F.col("kind") == "basic") & F.max(ends), F.min("n")).when(F.col("kind") == "reach", F.min("n")).when((F.col("kind") == "basic") & F.max(tops), F.max("n")).otherwise(F.sum("n"))
        merged = self.raw.where("kind <> 'key' AND kind <> 'field'").groupBy(*by).agg(value.alias("n"), F.sum("s").alias("s"))
        self.held = [merged.persist(StorageLevel.MEMORY_AND_DISK), self.raw]
        self.merged = together(merged)

    def close(self) -> None:
        for df in self.held:
            df.unpersist()

    def kind(self, name: str) -> DataFrame:
        return self.merged.where(F.col("kind") == name)

    def basic(self) -> DataFrame:
        n = lambda what: F.max(F.when(F.col("text") == what, F.col("n")))
        zero = lambda what: F.coalesce(n(what), F.lit(0)).alias(what)
        return self.kind("basic").groupBy("file_name", F.col("a").alias("w")).agg(
            zero("total"), zero("filtered"), zero("bases"), n("least").cast("int").alias("least"), n("most").cast("int").alias("most"), zero("gc"), zero("acgt"),
            (n("coloured") == 1).alias("coloured"), n("lowest").cast("int").alias("lowest")
        )

    def cube(self) -> DataFrame:
        none = lambda c, x: F.when(F.col(c) != NOTHING, x)
        return self.kind("cube").select("file_name", F.col("a").cast("int").alias("pos"), none("b", F.char("b")).alias("base"), none("c", F.col("c")).cast("int").alias("code"), "n")

    def means(self) -> DataFrame:
        return self.kind("mean").select("file_name", F.col("a").cast("int").alias("code"), "n", F.col("c").cast("int").alias("least"))

    def lengths(self) -> DataFrame:
        return self.kind("length").select("file_name", F.col("a").cast("int").alias("length"), "n")

    def gc(self) -> DataFrame:
        """(file_name, len, gc, n), with a row of no length for each file."""
        files = self.kind("basic").select("file_name").distinct()
        none = files.select("file_name", F.lit(None).cast("int").alias("len"), F.lit(None).cast("int").alias("gc"), F.lit(0).cast("long").alias("n"))
        return self.kind("gc").select("file_name", F.col("a").cast("int").alias("len"), F.col("b").cast("int").alias("gc"), "n").unionByName(none)

    def adapters(self) -> DataFrame:
        return self.kind("adapter").select("file_name", F.col("a").cast("int").alias("worker"), F.col("b").cast("int").alias("adapter"), F.col("c").cast("int").alias("at"), "n")

    def kmers(self) -> DataFrame:
        return placed_kmers(self.merged)

    def tiles(self) -> DataFrame | None:
        return tile_rows(self.raw, self.merged)

    def keys(self) -> DataFrame:
        """As sequences.key_counts().  Where one task alone met ``unique_cap`` different keys, none that comes first behind the last of
        them is among the first: rows of such keys are dropped before they are shuffled, unless the key also came before."""
        part = F.struct(F.spark_partition_id(), F.col("a")).alias("part")
        rows = self.raw.where("kind = 'key'").select("file_name", F.col("text").alias("key"), "n", F.col("s").alias("first"), part)
        return capped_keys(together(rows), self.config.unique_cap)


def placed_kmers(rows: DataFrame) -> DataFrame:
    """(file_name, kmer, pos, n) of tagged rows that were added up: a row of no reads tells how far a k-mer's places reach."""
    reach = F.col("kind") == "reach"
    pos, n = F.when(reach, F.col("n") % REACH).otherwise(F.col("a")), F.when(reach, F.lit(0)).otherwise(F.col("n"))
    return rows.where("kind IN ('kmer', 'reach')").select("file_name", F.col("text").alias("kmer"), pos.cast("int").alias("pos"), n.cast("long").alias("n"))


def tile_rows(raw: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(file_name, tile, pos, n, s, least) of tagged rows; None where workers of a file may give up."""
    kinds = raw.where("kind = 'field'").groupBy("file_name").agg(F.min("a").alias("least"), F.max("a").alias("most"))
    rows = rows.where("kind = 'tile'")
    many = rows.groupBy("file_name").agg(F.count_distinct("a").alias("tiles"))
    found = kinds.join(many, "file_name", "left").where(f"least < 0 OR least <> most OR tiles > {TILE_MOST}")  # a row a file
    if found.limit(1).count():
        return None
    return rows.select("file_name", F.col("a").cast("int").alias("tile"), F.col("b").cast("int").alias("pos"), "n", "s", F.col("c").cast("int").alias("least"))


def quick_tiles(reads: DataFrame, config: QcConfig) -> DataFrame | None:
    """The tiles' sums by the kernel alone, if no worker may give up."""
    gone = skips(reads) if config.dense else None
    if gone is None:
        return None
    rows = partials(reads, config, ("tile",), gone)
    return tile_rows(rows, rows)


def capped_keys(rows: DataFrame, cap: int) -> DataFrame:
    """(file_name, key, n, first, rank, total) of the first ``cap`` keys of each file, from partial rows (file_name, key, n, first,
    part); a part has a key once."""
    total = rows.groupBy("file_name").agg(F.sum("n").alias("total"))
    # any cap rows of a part are as many keys: how far they reach bounds the cap's place in the file
    spans = rows.groupBy("file_name", "part", F.floor(F.col("first") / KEY_SPAN).alias("_span")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("file_name", "part").orderBy("_span").rowsBetween(Window.unboundedPreceding, 0))
    ends = spans.withColumn("_upto", upto).where(F.col("_upto") >= cap).groupBy("file_name").agg(((F.min("_span") + 1) * KEY_SPAN).alias("_end"))
    bound = {r[0]: int(r[1]) for r in ends.collect()}  # a row a file
    if bound:
        of = rows.sparkSession.createDataFrame([*bound.items()], "file_name string, _end long")
        rows = rows.join(F.broadcast(of), "file_name", "left").withColumn("_early", F.coalesce(F.col("first") < F.col("_end"), F.lit(True)))
        early = rows.where("_early AND _end IS NOT NULL").select("file_name", "key").distinct()
        if early.count() <= EARLY_MOST:
            late = rows.where("NOT _early").join(F.broadcast(early), ["file_name", "key"], "left_semi")
            rows = rows.where("_early").unionByName(late.select(*rows.columns))
    keys = rows.groupBy("file_name", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return first_keys(keys, cap).join(total, "file_name").select("file_name", "key", "n", "first", "rank", "total")


__all__ = ["EVERY", "Fused", "capped_keys", "ordinals", "partials", "skips"]
