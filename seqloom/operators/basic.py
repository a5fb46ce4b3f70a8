"""Whole-file counts, and per-read histograms of quality, length and GC."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions.columns import Counts, column_bytes, file_runs
from ..functions.kernels import gc_fit, widths
from .common import unfiltered, worker


def worker_statistics(reads: DataFrame, compat: bool = True) -> DataFrame:
    """Sums, least and greatest values by file and worker."""
    seq = F.col("sequence")
    own = ~F.col("is_filtered")
    count = lambda letters: F.coalesce(F.sum(F.when(own, R.count_letters(seq, letters))), F.lit(0)).cast("long")
    return reads.groupBy("file_name", worker(compat).alias("w")).agg(
        F.count_if(own).alias("total"),
        F.count_if(F.col("is_filtered")).alias("filtered"),
        F.coalesce(F.sum(F.when(own, F.length(seq))), F.lit(0)).cast("long").alias("bases"),
        F.min(F.when(own, F.length(seq))).alias("least"),
        F.max(F.when(own, F.length(seq))).alias("most"),
        count("GC").alias("gc"),
        count("ACGT").alias("acgt"),
        F.max(F.when(own, F.col("colorspace").isNotNull())).alias("coloured"),
        F.min(F.when(own & (F.length(seq) > 0) & (F.length("quality") > 0), F.ascii(F.array_min(F.split("quality", ""))))).alias("lowest"),
    )


def basic_statistics(reads: DataFrame, compat: bool = True, per: DataFrame | None = None) -> DataFrame:
    """One row a file.  With ``compat`` a length of 0 counts as the least only if no worker's least is more."""
    per = worker_statistics(reads, compat) if per is None else per
    least = F.coalesce(F.min(F.when(F.col("least") > 0, F.col("least"))), F.lit(0)) if compat else F.coalesce(F.min("least"), F.lit(0))
    out = per.groupBy("file_name").agg(
        F.sum("total").alias("total_sequences"), F.sum("filtered").alias("filtered_sequences"),
        F.sum("bases").alias("total_bases"), least.alias("min_length"),
        F.coalesce(F.max("most"), F.lit(0)).alias("max_length"), F.sum("gc").alias("gc"),
        F.sum("acgt").alias("acgt"), F.coalesce(F.max("coloured"), F.lit(False)).alias("coloured"),
        F.coalesce(F.min("lowest"), F.lit(126)).alias("lowest")
    )
    return out.select(
        "file_name",
        F.when(F.col("coloured"), "Colorspace converted to bases").otherwise("Conventional base calls").alias("file_type"),
        R.phred_name(F.col("lowest")).alias("encoding"),
        "total_sequences",
        "filtered_sequences",
        "total_bases",
        "min_length",
        "max_length",
        F.when(F.col("acgt") > 0, F.expr("gc * 100 div acgt")).otherwise(0).cast("long").alias("gc_percent"),
        F.when(F.col("acgt") > 0, F.col("gc") * 100.0 / F.col("acgt")).otherwise(0.0).alias("gc_exact"),
    )


def _mean_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's counts of reads by whole mean code, with the least code of a file that the task saw."""
    found, lowest = Counts(), {}
    for batch in batches:
        raw, off = column_bytes(batch.column("quality"))
        for name, a, b in file_runs(batch.column("file_name")):
            size, code = np.diff(off[a : b + 1]), raw[off[a] : off[b]].astype(np.int64)
            means = np.add.reduceat(code, off[a:b] - off[a]) // size
            found.add(name, *np.unique(means, return_counts=True))
            lowest[name] = min(lowest.get(name, 255), int(code.min()))
    for name, least in lowest.items():
        keys, n = found.merged(name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n), pa.array(np.full(len(keys), least, np.int32))],
            ["file_name", "code", "n", "least"]
        )


def sequence_quality(reads: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """(file_name, quality, n): reads by whole mean quality, from this module's own lowest mean code."""
    rows = unfiltered(reads).where(F.length("quality") > 0).select("file_name", "quality").mapInArrow(
        _mean_codes, "file_name string, code int, n long, least int"
    ) if means is None else means
    counts = rows.groupBy("file_name", "code").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    least = F.min("least").over(Window.partitionBy("file_name"))
    return counts.select("file_name", (F.col("code") - R.phred_offset(least)).alias("quality"), "n")


def quality_mode(histogram: DataFrame) -> DataFrame:
    """(file_name, mode): the most frequent quality; of several the lowest."""
    return histogram.groupBy("file_name").agg(F.min_by("quality", F.struct(-F.col("n"), F.col("quality"))).alias("mode"))


def length_counts(reads: DataFrame) -> DataFrame:
    return unfiltered(reads).groupBy("file_name", F.length("sequence").alias("length")).agg(F.count("*").alias("n"))


def bin_width(span: str) -> Column:
    whens = " ".join(f"WHEN floor(({span}) / {w}) <= 50 THEN {w}" for w in widths(4))
    return F.expr(f"CASE WHEN {span} <= 75 THEN 1 {whens} ELSE 1 END")


def length_distribution(reads: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(file_name, lo, hi, label, n): bins of one width from the least length to the greatest, empty ones too."""
    of = Window.partitionBy("file_name")
    counts = (length_counts(reads) if counts is None else counts).withColumns({"least": F.min("length").over(of), "most": F.max("length").over(of)})
    counts = counts.withColumn("width", bin_width("most - least + 1").cast("int"))
    lo = (F.col("least") + F.floor((F.col("length") - F.col("least")) / F.col("width")) * F.col("width")).cast("int")
    binned = counts.groupBy("file_name", "least", "most", "width", lo.alias("lo")).agg(F.sum("n").alias("n"))
    # some hundred bins a file at most
    bins = binned.groupBy("file_name", "least", "most", "width").agg(F.map_from_entries(F.collect_list(F.struct("lo", "n"))).alias("own"))
    every = bins.select(
        "file_name", "most", "width", "own", F.explode(F.sequence("least", "most", "width")).alias("lo")
    ).withColumn("hi", F.least(F.col("lo") + F.col("width") - 1, F.col("most")))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return every.select("file_name", "lo", "hi", text.alias("label"), F.coalesce(F.try_element_at("own", F.col("lo")), F.lit(0)).alias("n"))


def gc_counts(reads: DataFrame) -> DataFrame:
    """(file_name, len, gc, n) over the parts of reads that count."""
    part = unfiltered(reads).select("file_name", R.gc_part(F.col("sequence")).alias("part")).where(F.length("part") > 0)
    return part.groupBy("file_name", F.length("part").alias("len"), R.gc_count(F.col("part")).alias("gc")).agg(F.count("*").alias("n"))


def gc_claims(counts: DataFrame) -> DataFrame:
    """Beside each (len, gc): pct and weight, the percentages that this GC count stands for.

    A count claims the percentages from half a base below to half a base above; a percentage that several counts of a length claim
    is shared among them: those about pct * len / 100 are asked.  A row without a length stands for nothing, at -1."""
    n, pct = F.col("len"), F.col("pct")
    half = lambda x: F.floor(x * 100.0 / n + 0.5).cast("int")
    low = lambda g: half(F.greatest(g - 0.5, F.lit(0.0)))
    high = lambda g: half(F.least(g + 0.5, n.cast("double")))
    rows = counts.withColumn("pct", F.explode(F.when(n > 0, F.sequence(low(F.col("gc")), high(F.col("gc")))).otherwise(F.array(F.lit(-1)))))
    near = F.sequence(F.greatest(F.floor((pct - 0.5) * n / 100) - 2, F.lit(0).cast("long")), F.least(F.ceil((pct + 0.5) * n / 100) + 2, n.cast("long")))
    shared = F.size(F.filter(near, lambda g: (low(g) <= pct) & (pct <= high(g))))
    return rows.withColumn("weight", F.when(pct >= 0, F.lit(1.0) / shared).otherwise(F.lit(0.0)))


def gc_distribution(reads: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(file_name, pct, count) for 0 to 100, also for a file all of whose reads are filtered."""
    part = F.when(~F.col("is_filtered"), R.gc_part(F.col("sequence")))
    counts = reads.select("file_name", part.alias("part")).groupBy(
        "file_name", F.length("part").alias("len"), R.gc_count(F.col("part")).alias("gc")
    ).agg(F.count("*").alias("n")) if counts is None else counts
    claims = gc_claims(counts)
    # equal weights are added as whole numbers first, so that the sums don't depend on the order of rows
    found = claims.groupBy("file_name", "pct", "weight").agg(F.sum("n").alias("n")).groupBy("file_name", "pct").agg(
        F.sum(F.col("n") * F.col("weight")).alias("count")
    )
    by_file = found.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("pct", "count"))).alias("own"))  # 102 at most
    return by_file.select("file_name", "own", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("pct")).select(
        "file_name", "pct", F.coalesce(F.try_element_at("own", F.col("pct")), F.lit(0.0)).alias("count")
    )


def gc_fitted(distribution: DataFrame) -> DataFrame:
    """(file_name, pct, count, theoretical, deviation): 101 rows a file go through the fit."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pct")
        bell, deviation = gc_fit(pdf["count"].tolist())
        return pdf.assign(theoretical=bell, deviation=deviation)

    return distribution.groupBy("file_name").applyInPandas(fit, "file_name string, pct int, count double, theoretical double, deviation double")

