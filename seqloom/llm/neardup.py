"""Near-duplicate groups by MinHash bands and odd sketches (operator 6).

1.  A text is the set of its k-word shingles (64-bit hashes).  Texts with equal sets form one class; only the member with the
    least id goes on, so exact copies cost nothing further.
2.  BANDS * ROWS MinHash samples; each band of ROWS samples is a bucket key.  A pair of similarity 0.8 shares no bucket with
    probability (1 - 0.8**ROWS)**BANDS = 5e-8.  These and as many further samples are folded into an odd sketch: a bitmap in
    which each sample flips one bit, so that the population count of two sketches' XOR estimates how many samples differ.
3.  In each bucket every member is paired with the least member only, its pivot.  Pairs whose sketches are far below the threshold
    (by more than five standard errors) fall away; the others are confirmed on both full sets, and components are formed.
4.  The members that share a bucket with the same pivot form a group.  Where a group still holds several components, each member
    outside its largest one meets all members of other components, once: the members outside and all members are dealt into
    blocks of a bounded size, and for each pair of blocks one step compares the sketches and confirms what they leave on both full
    sets.  Only links are put out, one for a member and a foreign component, and components are formed anew.  Pairs inside a
    component can't change the result and are never made; no pair of a shared bucket across components is left out.

With m members of a group and o of them outside its largest component, step 4 moves m * ceil(o / BLOCK) + o * ceil(m / BLOCK) rows.
To confirm pairs, the texts of a pivot's partners are streamed past the pivot's set; a pivot with many partners is salted.  Only
pairs of ids, sketches and texts of candidates are shuffled; the candidates' texts are set apart once.

Edge cases: a null text or one without words has the empty set and is linked with nothing; a text of fewer than k words has one
shingle; repeated rows of an id are one document; a null id is in no group and stays; of equal similarity all count (ties need no
rule); an empty table gives no rows; other columns are ignored by groups() and kept, whatever their names, by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U, column_words, join_hashes, mix, shingles
from .piececache import gather
from .shared import own_name, stage

BANDS, ROWS = 32, 4
SAMPLES = 2 * BANDS * ROWS
SKETCH_BITS = 1024
SALTS = 16
BLOCK = 512  # members, or
BLOCK_SHINGLES = 1 << 18  # shingles of a block in the last step
PARTNERS = 64  # of a pivot in one group of the confirming pass
SIGNATURE = "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"

_seeds = np.random.default_rng(20_240_117)
FLIPS = _seeds.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
FACTORS = _seeds.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + U(1)


def distinct_shingles(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, row by row, and their numbers."""
    all_of, count = shingles(h, n, k)
    rows = np.repeat(np.arange(len(n)), count)
    _, first = np.unique(mix(all_of + rows.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return all_of[first], np.bincount(rows[first], minlength=len(n)).astype(np.int64)


def signatures(sets: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with shingles: two hashes of each set, the bucket keys and the odd sketches."""
    full = count > 0
    starts = (np.cumsum(count) - count)[full]
    rows = len(starts)
    if not rows:
        return np.zeros((0, 2), np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, SKETCH_BITS // 64), np.int64)
    keys = np.stack([np.add.reduceat(mix(sets ^ U(c)), starts) for c in (0x1234567, 0x89ABCDEF)], 1)
    least = np.empty((rows, SAMPLES), U)
    for p in range(SAMPLES):
        v = (sets ^ FLIPS[p]) * FACTORS[p]
        v ^= v >> U(32)
        least[:, p] = np.minimum.reduceat(v, starts)
    bands = np.stack([join_hashes([np.full(rows, U(b)), *(least[:, b * ROWS + r] for r in range(ROWS))]) for b in range(BANDS)], 1)  # of the first half of the samples
    place = (mix(least + np.arange(SAMPLES, dtype=U) * U(0x9E3779B97F4A7C15)) % U(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((place + np.arange(rows)[:, None] * SKETCH_BITS).ravel(), minlength=rows * SKETCH_BITS) & 1
    sketch = np.packbits(odd.reshape(rows, SKETCH_BITS).astype(np.uint8), axis=1).view(np.int64)
    return keys.view(np.int64), bands.view(np.int64), sketch


def _fixed(x: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list column: the rows of ``x`` where ``full``, else an empty list."""
    edges = np.concatenate([[0], np.cumsum(np.where(full, x.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(x.ravel()))


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, h, n in column_words(batch.column("text")):
            sets, count = distinct_shingles(h, n, k)
            keys, bands, sketch = signatures(sets, count)
            full = count > 0
            both = np.zeros((b - a, 2), np.int64)
            both[full] = keys
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], pa.array(count), pa.array(both[:, 0]), pa.array(both[:, 1]), _fixed(bands, full), _fixed(sketch, full)],
                ["doc_id", "n", "k1", "k2", "bands", "sketch"]
            )


def sketch_similarity(a: str, b: str) -> Column:
    """The estimate from the population count of two sketches' XOR; 0 where it is beyond what parities can tell."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    share = F.lit(1.0) - apart * 2.0 / SKETCH_BITS
    return F.when(share > 0, F.lit(1.0) + F.log(share) * (SKETCH_BITS / 2) / (2.0 * SAMPLES)).otherwise(F.lit(0.0))


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (pivot, salt), the pivot's own text first; emits linked pairs."""
    group, own = None, np.zeros(0, U)
    for batch in batches:
        pivots, salts, ids = (batch.column(c).to_numpy() for c in ("pivot", "salt", "doc_id"))
        out: list[tuple[int, int]] = []
        for a, _, h, n in column_words(batch.column("text")):
            sets, count = distinct_shingles(h, n, k)
            to = np.cumsum(count)
            for i in range(len(count)):
                row, s = a + i, np.sort(sets[to[i] - count[i] : to[i]])
                if ids[row] == pivots[row]:
                    group, own = (pivots[row], salts[row]), s
                elif group == (pivots[row], salts[row]):
                    place = np.searchsorted(own, s)
                    shared = int((own[np.minimum(place, len(own) - 1)] == s).sum()) if len(own) else 0
                    if len(s) and 100 * shared >= percent * (len(own) + len(s) - shared):
                        out.append((int(pivots[row]), int(ids[row])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([m for _, m in out], pa.int64())], ["u", "v"])


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _every_salt() -> Column:
    return F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")


def _beside(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the columns of ``few`` (unique by ``key``), met in salted form so that no task gets a frequent key alone."""
    return rows.withColumn("salt", _salt(by)).join(few.select("*", _every_salt()), [key, "salt"]).drop("salt")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): the pairs (pivot, member) whose full sets are as similar as ``percent`` in a hundred."""
    many = pairs.groupBy("pivot").agg((F.ceil(F.count("*") / PARTNERS)).cast("long").alias("groups"))
    dealt = _beside(pairs, many, "pivot", "member").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("groups")))
    pivots = many.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.col("pivot").alias("doc_id"))
    asked = dealt.select("pivot", "salt", F.col("member").alias("doc_id")).unionAll(pivots)
    rows = asked.join(texts, "doc_id").select("pivot", "salt", "doc_id", (F.col("doc_id") != F.col("pivot")).alias("late"), "text")
    rows = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "late")
    return rows.select("pivot", "salt", "doc_id", "text").mapInArrow(partial(_confirm, k=k, percent=percent), "u long, v long")


def _close(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches don't rule the similarity out."""
    pivots = sketches.join(pairs.select(F.col("pivot").alias("rep")).distinct(), "rep").select(F.col("rep").alias("pivot"), F.col("sketch").alias("_a"))
    members = sketches.select(F.col("rep").alias("member"), F.col("sketch").alias("_b"))
    both = _beside(pairs.join(members, "member"), pivots, "pivot", "member")
    return both.where(sketch_similarity("_a", "_b") >= least).select("pivot", "member")


class Block:
    """Two sides of rows: every pair across sides and components is compared."""

    def __init__(self) -> None:
        self.ids, self.labels, self.sketches, self.sets = ([], []), ([], []), ([], []), ([], [])

    def add(self, side: int, doc_id: int, label: int, sketch: np.ndarray, shingles_: np.ndarray) -> None:
        for rows, x in zip((self.ids, self.labels, self.sketches, self.sets), (doc_id, label, sketch, shingles_), strict=True):
            rows[side].append(x)

    def links(self, percent: int, least: float) -> list[tuple[int, int]]:
        """(a left row's id, a right row's id): for each left row one link to each foreign component that it has one to."""
        if not self.ids[0] or not self.ids[1]:
            return []
        labels, ids, sketches = np.array(self.labels[1]), np.array(self.ids[1]), np.stack(self.sketches[1]).view(U)
        size = np.array([len(s) for s in self.sets[1]])
        starts = np.cumsum(size) - size
        names, flat = np.unique(np.concatenate([*self.sets[1], *self.sets[0]]), return_inverse=True)
        pool, at, mark, out = flat[: size.sum()], int(size.sum()), np.zeros(len(names), bool), []
        for x, label, sketch, own in zip(self.ids[0], self.labels[0], self.sketches[0], self.sets[0], strict=True):
            mine, at = flat[at : at + len(own)], at + len(own)
            share = 1 - np.bitwise_count(sketches ^ sketch.view(U)).sum(1) * (2.0 / SKETCH_BITS)
            near = np.where(share > 0, 1 + np.log(np.maximum(share, 1e-9)) * (SKETCH_BITS / 2) / (2.0 * SAMPLES), 0.0) >= least
            c = np.flatnonzero((labels != label) & near & (100 * np.minimum(size, len(own)) >= percent * np.maximum(size, len(own))))
            if not len(c):
                continue
            mark[mine] = True
            shared = np.add.reduceat(mark[gather(pool, starts[c], size[c])], np.cumsum(size[c]) - size[c], dtype=np.int64)
            mark[mine] = False
            linked = c[100 * shared >= percent * (len(own) + size[c] - shared)]
            out += [(x, int(y)) for y in ids[linked[np.unique(labels[linked], return_index=True)[1]]]]
        return out


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows come by (pivot, l, r), a pair of blocks; emits links."""
    key, block = None, Block()

    def done() -> Iterator[pa.RecordBatch]:
        if found := block.links(percent, least):
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        pivot, left, right, side, ids, labels = (batch.column(c).to_pylist() for c in ("pivot", "l", "r", "side", "doc_id", "label"))
        sketches = batch.column("sketch").flatten().to_numpy().reshape(len(ids), -1)
        for a, _, h, n in column_words(batch.column("text")):
            sets, count = distinct_shingles(h, n, k)
            to = np.cumsum(count)
            for i in range(len(count)):
                row = a + i
                if (now := (pivot[row], left[row], right[row])) != key:
                    yield from done()
                    key, block = now, Block()
                block.add(side[row], ids[row], labels[row], sketches[row], sets[to[i] - count[i] : to[i]])
    yield from done()


def across(beside: DataFrame, label: DataFrame, texts: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """(u, v): links between members of one pivot that are of different components; see step 4 of the module's text.

    ``beside``: (pivot, rep, n), the pivot among them; ``label``: (u, v), a member and its component, where it has one."""
    named = beside.join(
        label.select(F.col("u").alias("rep"), F.col("v").alias("_label")), "rep", "left"
    ).select("pivot", "rep", "n", F.coalesce("_label", "rep").alias("label"))
    each = named.groupBy("pivot", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    both = each.groupBy("pivot").agg(
        F.max(F.struct("m", "label", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")
    ).where(F.col("m") > F.col("top.m"))
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("long")
    both = both.select(
        "pivot", F.col("top.label").alias("largest"),
        blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("lefts"),
        blocks(F.col("m"), F.col("s")).alias("rights")
    )
    rows = _beside(named, both, "pivot", "rep")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = rows.select("pivot", "rep", "label", F.pmod(F.xxhash64("rep"), F.col("rights")).alias("r"), F.lit(1).alias("side"), up_to("lefts").alias("l"))
    left = rows.where("label <> largest").select(
        "pivot", "rep", "label", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("lefts")).alias("l"),
        F.lit(0).alias("side"), up_to("rights").alias("r")
    )
    asked = right.unionByName(left).withColumnRenamed("rep", "doc_id").join(texts, "doc_id")
    asked = asked.repartition("pivot", "l", "r").sortWithinPartitions("pivot", "l", "r")
    return asked.select("pivot", "l", "r", "side", "doc_id", "label", "sketch", "text").mapInArrow(
        partial(_compare, k=k, percent=percent, least=least), "u long, v long"
    )


def groups(docs: DataFrame, path: str, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module's text."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stage(texts.mapInArrow(partial(_sign, k=k), SIGNATURE), f"{path}/signatures").withColumn("salt", _salt("doc_id"))
    share = percent / 100
    least = share - 5 * (share * (1 - share) / SAMPLES) ** 0.5 - 0.02
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    # copies of one text are met by (set, salt) first, so that no task gets all of them
    one = full.groupBy("k1", "k2", "salt").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("s")).groupBy("k1", "k2").agg(F.min("s").alias("s"))
    classes = stage(one.select("k1", "k2", F.col("s.doc_id").alias("rep"), "s.n", "s.bands", "s.sketch"), f"{path}/classes")

    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    firsts = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1").select("key", "pivot")
    beside = stage(_beside(keyed, firsts, "key", "rep").select("pivot", "rep", "n").distinct(), f"{path}/beside")
    sketches = classes.select("rep", "sketch")
    wanted = sketches.join(beside.select("rep").distinct(), "rep", "left_semi").withColumnRenamed("rep", "doc_id")
    # the same plan at any size: a merge join, however few the candidates are
    texts = stage(texts.hint("merge").join(wanted, "doc_id"), f"{path}/candidates")

    pairs = stage(_close(beside.where("pivot <> rep").select("pivot", F.col("rep").alias("member")), sketches, least), f"{path}/pairs")
    linked = stage(confirm(pairs, texts.drop("sketch"), k, percent), f"{path}/links")
    label = components(linked, f"{path}/components")
    more = stage(across(beside, label, texts, k, percent, least), f"{path}/links-across")
    label = components(label.unionAll(more), f"{path}/components-across")

    reps = full.select("k1", "k2", "salt").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    own = signed.select("doc_id", "n", "k1", "k2", "salt").join(reps, ["k1", "k2", "salt"], "left")
    own = own.withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    out = own.join(label.select(F.col("u").alias("rep"), F.col("v").alias("component_id")), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))


def keep_one(docs: DataFrame, path: str, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a smaller id stands for: one of each group stays, with all its columns."""
    gone = groups(docs, path, k, percent, doc_id, text).where("doc_id <> component_id").select(
        F.col("doc_id").alias(column := own_name(docs, "gone"))
    ).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone[column], "left_anti")
