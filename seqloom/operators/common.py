"""What several modules share: ordinals, the position cube, and groups of positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.columns import NOTHING, Counts, base_counts, column_bytes, file_runs, slices
from ..functions.kernels import EXPONENTIAL, MOST_GROUPS, widths

BATCH, WORKERS = 4096, 4
SPAN = 1 << 16  # batches whose running sums one task adds up
_letters = pa.array([*map(chr, range(NOTHING)), None])


def unfiltered(reads: DataFrame) -> DataFrame:
    return reads.where(~F.col("is_filtered"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (one small or compressed file) is dealt out evenly; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def worker(compat: bool) -> Column:
    """Batches of reads go round the workers in turn; without ``compat`` there is one."""
    return (F.floor(F.col("read_idx") / BATCH) % WORKERS).cast("int") if compat else F.lit(0)


def upto(sizes: DataFrame, by: list[str], at: str, n: str, out: str, total=F.sum) -> DataFrame:
    """Adds the sum (or, with F.max, the greatest, at least 0) of ``n`` over smaller ``at`` of the same ``by``: within spans, and over
    spans, so that no task has all."""
    rows = sizes.withColumn("_span", F.floor(F.col(at) / SPAN))
    before = lambda keys, order: F.coalesce(total(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = rows.groupBy(*by, "_span").agg(total(n).alias(n)).select(*by, "_span", before(by, "_span").alias("_earlier"))
    rows = rows.withColumn("_within", before([*by, "_span"], at))
    both = F.col("_earlier") + F.col("_within") if total is F.sum else F.greatest("_earlier", "_within")
    return rows.join(spans, [*by, "_span"]).withColumn(out, both).drop("_span", "_within", "_earlier")


def _skipped(reads: DataFrame, skip: Column, compat: bool) -> DataFrame:
    """(file_name, _batch, _before, _gone) for each batch of the files with skipped reads: how many are skipped in earlier
    batches of the worker, and which in this one.  Nothing is read where the plan tells that none is skipped."""
    batch = F.floor(F.col("read_idx") / BATCH)
    gone = reads.where(skip).groupBy("file_name", batch.alias("_batch")).agg(F.count("*").alias("_n"), F.collect_list("read_idx").alias("_gone"))
    ends = reads.groupBy("file_name").agg(F.max(batch).alias("_last")).join(gone.select("file_name").distinct(), "file_name")
    spans = ends.select(
        "file_name", "_last",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / SPAN))).alias("_at")
    ).repartition("file_name", "_at")
    every = spans.select("file_name", F.explode(F.sequence(F.col("_at") * SPAN, F.least(F.col("_at") * SPAN + SPAN - 1, F.col("_last")))).alias("_batch"))
    sizes = every.join(gone, ["file_name", "_batch"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn(
        "_worker", F.col("_batch") % WORKERS if compat else F.lit(0)
    )
    return upto(sizes, ["file_name", "_worker"], "_batch", "_n", "_before").select("file_name", "_batch", "_before", "_gone")


def _numbered(rows: DataFrame, reads: DataFrame, name: str, compat: bool, skip: Column) -> DataFrame:
    """Adds the 1-based ordinal that follows from read_idx, less the skipped reads before; ``rows`` may be few of the ``reads``."""
    idx, keys = F.col("read_idx"), ["file_name", "_batch"]
    rows = rows.withColumn("_batch", F.floor(idx / BATCH)).join(_skipped(reads, skip, compat), keys, "left")
    place = (F.floor(F.col("_batch") / WORKERS) * BATCH + idx % BATCH if compat else idx) + 1
    inside = F.coalesce(F.size(F.filter("_gone", lambda x: x < idx)), F.lit(0))
    return rows.withColumn(
        name,
        place - F.coalesce("_before", F.lit(0)) - F.when(F.col("_gone").isNull(), 0).otherwise(inside)
    ).drop("_batch", "_before", "_gone")


def ordinals_of(rows: DataFrame, reads: DataFrame, name: str) -> DataFrame:
    """Some rows (file_name, read_idx, ...) of dense reads that aren't filtered, with their ordinals among those of the file.  Only
    the filtered reads' places are dealt out, in their batches."""
    return _numbered(rows, reads, name, False, F.col("is_filtered"))


def with_ordinal(reads: DataFrame, name: str, compat: bool, skip: Column | None = None, dense: bool = True) -> DataFrame:
    """The reads that aren't skipped (filtered, unless told otherwise), with each one's 1-based ordinal among those of its file
    and worker, in the order of read_idx.

    Where read_idx is ``dense`` (each read of a file has its place, as readers of FASTQ give it) the ordinal follows from it, less
    the skipped reads before; without skipped reads nothing is joined.  Else a batch's reads are numbered, and batches' running
    sums give each batch's first ordinal.  No task has all reads or all batches of a file."""
    skip = F.col("is_filtered") if skip is None else skip
    idx, keys = F.col("read_idx"), ["file_name", "_batch"]
    if dense:
        return _numbered(reads.where(~skip), reads, name, compat, skip)
    rows = reads.where(~skip).withColumn("_batch", F.floor(idx / BATCH))
    sizes = rows.withColumn("_worker", worker(compat)).groupBy("file_name", "_worker", "_batch").agg(F.count("*").alias("_n"))
    firsts = upto(sizes, ["file_name", "_worker"], "_batch", "_n", "_before").select(*keys, "_before")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("read_idx"))
    return rows.join(firsts, keys).withColumn(name, F.col("_before") + own).drop("_batch", "_before")


def _position_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's counts; batches of long reads are walked in slices."""
    found = Counts()
    for batch in batches:
        seq, qual = column_bytes(batch.column("sequence")), column_bytes(batch.column("quality"))
        for name, a, b in file_runs(batch.column("file_name")):
            for c, d in slices(seq[1][a : b + 1], qual[1][a : b + 1]):
                found.add(name, *base_counts(seq, qual, a + c, a + d))
    for name in found.parts:
        keys, n = found.merged(name)
        code = keys & 511
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(keys), pa.string()), pa.array((keys >> 18).astype(np.int32)),
                _letters.take(pa.array(keys >> 9 & 511)),
                pa.array(code.astype(np.int32), mask=code == NOTHING), pa.array(n)
            ],
            ["file_name", "pos", "base", "code", "n"],
        )


def position_partials(reads: DataFrame) -> DataFrame:
    """(file_name, pos, base, code, n): each task's counts of bases and quality codes by position, from 1 on."""
    return unfiltered(reads).select("file_name", "sequence", "quality").mapInArrow(_position_counts, "file_name string, pos int, base string, code int, n long")


def position_cube(reads: DataFrame) -> DataFrame:
    """The partial counts (a key may have several rows), dealt by file and position: what is then grouped by these, or windowed,
    isn't dealt out again.  Quality, base and N content and encodings are derived from it."""
    return position_partials(reads).repartition("file_name", "pos")


def wide_group(length: str) -> str:
    """How many positions a group behind the ninth has, as SQL."""
    whens = " ".join(f"WHEN {length} <= {9 + (MOST_GROUPS - 9) * w} THEN {w}" for w in widths(6))
    return f"CASE {whens} ELSE 1 END"


def in_groups(rows: DataFrame, config: QcConfig, length: Column | None = None) -> DataFrame:
    """Adds to rows by (file_name, pos) their group's grp (its first position), lo, hi and label.

    The length is a file's last position, unless it is given; ``min_length`` adds empty positions behind it."""
    rows = rows.withColumn("_length", F.max("pos").over(Window.partitionBy("file_name")) if length is None else length)
    if config.min_length:
        ends = rows.groupBy("file_name").agg(F.max("_length").alias("_length")).where(F.col("_length") < config.min_length)
        blank = ends.select("file_name", F.explode(F.sequence(F.col("_length") + 1, F.lit(config.min_length))).cast("int").alias("pos"))
        rows = rows.unionByName(blank, allowMissingColumns=True).withColumn(
            "_length",
            F.greatest(F.max("_length").over(Window.partitionBy("file_name")), F.lit(config.min_length))
        )
    # SQL texts: building these trees a call at a time takes longer than running them
    within = lambda start, w: f"({start} + floor((pos - {start}) / ({w})) * ({w}))"
    lo, wide = "pos", "1"
    if config.expgroup and not config.nogroup:
        for start, above, w in EXPONENTIAL:
            on = f"pos >= {start} AND _length > {above}"
            lo, wide = f"CASE WHEN {on} THEN {within(start, w)} ELSE {lo} END", f"CASE WHEN {on} THEN {w} ELSE {wide} END"
    elif not config.nogroup:
        grouped, w = f"_length > {MOST_GROUPS} AND pos > 9", wide_group("_length")
        lo, wide = f"CASE WHEN {grouped} THEN {within(10, w)} ELSE pos END", f"CASE WHEN {grouped} THEN {w} ELSE 1 END"
    rows = rows.selectExpr("*", f"CAST({lo} AS int) AS lo", f"CAST({wide} AS int) AS _wide")
    rows = rows.selectExpr("*", "lo AS grp", "CAST(least(lo + _wide - 1, _length) AS int) AS hi")
    return rows.selectExpr("*", "CASE WHEN lo = hi THEN CAST(lo AS string) ELSE concat_ws('-', lo, hi) END AS label").drop("_length", "_wide")
