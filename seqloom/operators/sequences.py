"""Modules about whole sequences and their parts: duplication, overrepresented sequences, adapters and k-mers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions import reads as R
from ..functions.kernels import DUPLICATION_LABELS, Contaminants, duplication_levels
from .common import BATCH, in_groups, ordinals_of, unfiltered, upto, with_ordinal, worker

KMER_EVERY, KMER_PART, KMER_TOP, KMER_DRAWN = 50, 500, 20, 6
KEY_SPAN = 65_536  # ordinals
EARLY_MOST = 2_000_000  # keys of 50 bytes that are broadcast at most


def key_counts(reads: DataFrame, config: QcConfig) -> DataFrame:
    """(file_name, key, n, first, rank, total): copies of each key, of the first ``unique_cap`` distinct keys of a file, the ordinal
    of the read that brought it, and the file's reads.  Which keys are first follows from their least ordinals: no order of
    processing matters."""
    rows = with_ordinal(reads, "ordinal", False, dense=config.dense).select(
        "file_name", R.duplicate_key(F.col("sequence"), config.dup_length).alias("key"), "ordinal"
    )
    keys = rows.groupBy("file_name", "key").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    # the cap's rank is decided among batches of ordinals first, so that no task ranks all keys of a file
    keys = keys.withColumn("_part", F.floor(F.col("first") / 65_536))
    sizes = keys.groupBy("file_name", "_part").agg(F.count("*").alias("_n"), F.sum("n").alias("_m"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file_name", "_part", before.alias("_before"), F.sum("_m").over(Window.partitionBy("file_name")).alias("total"))
    # parts that begin beyond the cap have no key in it
    sizes = sizes.where(F.col("_before") < config.unique_cap)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("file_name", "_part").orderBy("first"))
    return keys.join(sizes, ["file_name", "_part"]).withColumn("rank", rank).where(F.col("rank") <= config.unique_cap).select(
        "file_name", "key", "n", "first", "rank", "total"
    )


def first_keys(keys: DataFrame, cap: int) -> DataFrame:
    """Of different keys (file_name, key, first, ...) the first ``cap`` of each file, with their rank.  The cap's rank is decided
    among spans of ordinals first, so that no task ranks all keys of a file."""
    keys = keys.withColumn("_span", F.floor(F.col("first") / KEY_SPAN))
    sizes = keys.groupBy("file_name", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_name").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file_name", "_span", before.alias("_before")).where(F.col("_before") < cap)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("file_name", "_span").orderBy("first"))
    return keys.join(sizes, ["file_name", "_span"]).withColumn("rank", rank).where(F.col("rank") <= cap).drop("_span", "_before")


def early_key_counts(reads: DataFrame, config: QcConfig) -> DataFrame:
    """As key_counts(), for dense reads with many more different keys than count: these are sought among the reads that come first,
    four times as many until there are ``unique_cap`` or no more reads, and then all reads' copies of them are counted.  Keys behind
    the cap aren't shuffled, and filtered reads' places don't travel to the driver."""
    # exploded, since a sequence that is derived would be worked out again for each use of it
    rows = unfiltered(reads).select("file_name", F.col("read_idx").alias("first"), F.explode(F.array("sequence")).alias("sequence"))
    rows = rows.select("file_name", R.duplicate_key(F.col("sequence"), config.dup_length).alias("key"), "first")
    totals = rows.groupBy("file_name").agg(F.count("*").alias("total"))
    every = {r[0]: r[1] for r in totals.collect()}  # a row a file
    end = 2 * config.unique_cap
    while True:
        early = rows.where(F.col("first") < end).groupBy("file_name", "key").agg(F.min("first").alias("first"), F.count("*").alias("n"))
        found = {r[0]: (r[1], r[2]) for r in early.groupBy("file_name").agg(F.count("*"), F.sum("n")).collect()}
        if all(name in found and (found[name][0] >= config.unique_cap or found[name][1] == n) for name, n in every.items()):
            break
        end *= 4
    kept = first_keys(early.drop("n"), config.unique_cap)
    few = sum(min(n, config.unique_cap) for n, _ in found.values()) <= EARLY_MOST
    copies = rows.drop("first").join(F.broadcast(kept) if few else kept, ["file_name", "key"]).groupBy("file_name", "key", "first", "rank").agg(F.count("*").alias("n"))
    placed = ordinals_of(copies.withColumnRenamed("first", "read_idx"), reads, "first").join(totals, "file_name")
    return placed.select("file_name", "key", "n", "first", "rank", "total")


def duplication_histogram(keys: DataFrame) -> DataFrame:
    """(file_name, level, keys)."""
    return keys.groupBy("file_name", F.col("n").alias("level")).agg(F.count("*").alias("keys"))


def duplication(reads: DataFrame, config: QcConfig, keys: DataFrame | None = None) -> DataFrame:
    """(file_name, slot, label, percent, deduplicated): a row for each level and file goes through the correction."""
    keys = key_counts(reads, config) if keys is None else keys
    at_cap = F.max(F.when(F.col("rank") == config.unique_cap, F.col("first"))).alias("limit")
    rows = keys.groupBy("file_name", F.col("n").alias("level")).agg(F.count("*").alias("keys"), at_cap, F.max("total").alias("total"))

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        total, limit = int(pdf["total"].iloc[0]), pdf["limit"].max()
        kept, slots = duplication_levels(list(zip(pdf["level"].tolist(), pdf["keys"].tolist(), strict=True)), total if pd.isna(limit) else int(limit), total)
        return pd.DataFrame({"file_name": pdf["file_name"].iloc[0], "slot": range(16), "label": DUPLICATION_LABELS, "percent": slots, "deduplicated": kept})

    return rows.groupBy("file_name").applyInPandas(levels, "file_name string, slot int, label string, percent double, deduplicated double")


def possible_source(query: Column, contaminants: list[tuple[str, str]]) -> Column:
    """The first contaminant of the list that matches; 'No Hit' if none does.  It is asked of few sequences, in Arrow batches."""
    table = Contaminants(contaminants)

    @F.pandas_udf("string")
    def source(sequences: pd.Series) -> pd.Series:
        return sequences.map(table.source)

    return source(query)


def overrepresented(reads: DataFrame, config: QcConfig, keys: DataFrame | None = None) -> DataFrame:
    """(file_name, sequence, n, percent, source): keys above the warning limit of all reads, the most frequent first."""
    keys = key_counts(reads, config) if keys is None else keys
    percent = F.col("n") * 100.0 / F.col("total")
    rows = keys.where(percent > config.limit("overrepresented", "warn"))
    out = rows.select("file_name", F.col("key").alias("sequence"), "n", percent.alias("percent"))
    return out.withColumn("source", possible_source(F.col("sequence"), config.contaminants)).orderBy("file_name", F.desc("n"), "sequence")


def adapter_places(reads: DataFrame, config: QcConfig) -> DataFrame:
    """(file_name, worker, adapter, at, n): reads by the first place of each adapter, and by their length as adapter -1."""
    longest = max((len(s) for _, s in config.adapters), default=0)
    rows = unfiltered(reads).select(
        "file_name", "read_idx", worker(config.compat).alias("worker"), F.length("sequence").alias("len"),
        F.array(*(F.instr("sequence", F.lit(s)) - 1 for _, s in config.adapters)).cast("array<int>").alias("ats")
    )
    if config.compat and len({len(s) for _, s in config.adapters}) > 1:
        # with adapters of several lengths a hit beyond what the longest read so far allows is lost
        # (that is known by batches first, so that no task walks all reads of a worker)
        rows = rows.withColumn("_batch", F.floor(F.col("read_idx") / BATCH))
        ends = rows.groupBy("file_name", "worker", "_batch").agg(F.max("len").alias("_n"))
        earlier = upto(ends, ["file_name", "worker"], "_batch", "_n", "_earlier_most", F.max).drop("_n")
        within = F.max("len").over(Window.partitionBy("file_name", "worker", "_batch").orderBy("read_idx").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_most", within).join(earlier, ["file_name", "worker", "_batch"]).withColumn(
            "ats",
            F.transform(
                "ats",
                lambda a: F.when(a <= F.greatest(F.greatest("_most", "_earlier_most") - longest, F.lit(0)), a).otherwise(-1)
            )
        )
    hits = F.filter(F.transform("ats", lambda a, i: F.struct(i.alias("adapter"), a.alias("at"))), lambda h: h["at"] >= 0)
    size = F.array(F.struct(F.lit(-1).alias("adapter"), F.col("len").alias("at")))
    return rows.select("file_name", "worker", F.inline(F.concat(size, hits))).groupBy("file_name", "worker", "adapter", "at").agg(F.count("*").alias("n"))


def adapter_content(reads: DataFrame, config: QcConfig, hits: DataFrame | None = None) -> DataFrame:
    """(file_name, adapter, name, grp, label, percent): reads in which the adapter began up to a position, averaged over the
    group's width.  A worker's reads count up to the last position that its longest read allows."""
    longest = max((len(s) for _, s in config.adapters), default=0)
    hits = adapter_places(reads, config) if hits is None else hits
    sizes = hits.where("adapter < 0").groupBy("file_name", "worker").agg(F.max("at").alias("most"), F.sum("n").alias("n"))
    of = Window.partitionBy("file_name")  # a row a worker
    sizes = sizes.withColumn("last", F.when(F.col("most") > longest, F.col("most") - longest).otherwise(0))
    sizes = sizes.withColumns({"total": F.sum("n").over(of), "top": F.max("last").over(of) + 1})
    places = sizes.select("file_name", "worker", "total", "top", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    each = places.withColumn("adapter", F.explode(F.sequence(F.lit(0), F.lit(len(config.adapters) - 1))))
    filled = each.join(hits, ["file_name", "worker", "adapter", "at"], "left")
    upto = filled.withColumn(
        "upto",
        F.sum(F.coalesce("n", F.lit(0))).over(
            Window.partitionBy("file_name", "worker", "adapter").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        )
    )
    summed = upto.groupBy("file_name", "adapter", "total", "top", (F.col("at") + 1).alias("pos")).agg(F.sum("upto").alias("upto"))
    names = F.array(*(F.lit(n) for n, _ in config.adapters))
    rows = _with_blank(in_groups(summed, config, F.col("top")), len(config.adapters))
    rows = rows.groupBy("file_name", "adapter", "grp", "label", "lo", "hi").agg((F.sum(F.coalesce("upto", F.lit(0)) * 100.0 / F.col("total"))).alias("s"))
    return rows.select(
        "file_name", "adapter", F.get(names, "adapter").alias("name"), "grp", "label",
        (F.coalesce("s", F.lit(0.0)) / (F.col("hi") - F.col("lo") + 1)).alias("percent")
    )


def _with_blank(rows: DataFrame, adapters: int) -> DataFrame:
    """Positions that no read has, behind the last one, stand for every adapter."""
    each = F.when(F.col("adapter").isNull(), F.sequence(F.lit(0), F.lit(adapters - 1))).otherwise(F.array("adapter"))
    return rows.withColumn("adapter", F.explode(each))


def kmer_counts(reads: DataFrame, config: QcConfig) -> DataFrame:
    """(file_name, kmer, pos, n): k-mers without N of each KMER_EVERY-th read's first KMER_PART bases."""
    return kmer_places(reads, config).where("kmer IS NOT NULL AND n > 0")


def kmer_places(reads: DataFrame, config: QcConfig) -> DataFrame:
    """As kmer_counts(), with how many k-mers with N a position has, as a null kmer, and with rows of no reads: how many positions
    the first read of a worker that shows a k-mer has.  Two bits a base in the tasks, where sampled reads can be told there."""
    from . import fused  # which counts by this module's rules

    gone = fused.skips(reads) if config.dense else None
    if gone is None:
        # a worker's first read of a k-mer at a position, then at any
        each = _kmers(reads, config).groupBy("file_name", "worker", "kmer", "pos").agg(F.count("*").alias("n"), F.min("shown").alias("shown"))
        first = F.min("shown").over(Window.partitionBy("file_name", "worker", "kmer"))
        reach = F.struct(F.col("first.places").alias("pos"), F.lit(0).cast("long").alias("n"))
        both = F.array(F.struct("pos", "n"), F.when(F.col("kmer").isNotNull(), reach))
        rows = each.withColumn("first", first).select("file_name", "kmer", F.inline(F.array_compact(both)))
    else:
        rows = fused.partials(reads, config, ("kmer",), gone).groupBy("file_name", "kind", "a", "text").agg(
            F.when(F.col("kind") == "reach", F.min("n")).otherwise(F.sum("n")).alias("n")
        )
        rows = fused.placed_kmers(rows)
    return rows.groupBy("file_name", "kmer", "pos").agg(F.sum("n").alias("n"))


def _kmers(reads: DataFrame, config: QcConfig) -> DataFrame:
    """(file_name, worker, shown, pos, kmer): ``shown`` is the read's ordinal and how many positions it has; k-mers with N are null."""
    k = config.kmer_size
    rows = with_ordinal(reads, "ordinal", config.compat, dense=config.dense).where(F.col("ordinal") % KMER_EVERY == 0)
    rows = rows.select("file_name", worker(config.compat).alias("worker"), "ordinal", F.substring("sequence", 1, KMER_PART).alias("s")).where(F.length("s") >= k)
    places = F.length("s") - k + 1
    rows = rows.select(
        "file_name", "worker", F.struct("ordinal", places.alias("places")).alias("shown"),
        F.posexplode(F.transform(F.sequence(F.lit(1), places), lambda i: F.substring("s", i, F.lit(k)))).alias("pos", "kmer")
    )
    return rows.withColumns({"pos": F.col("pos") + 1, "kmer": F.when(~F.contains("kmer", F.lit("N")), F.col("kmer"))})


def kmer_p_value(n: Column, p: Column, k: Column, size: int) -> Column:
    """The normal approximation of the binomial tail, times the number of k-mers."""
    # Abramowitz and Stegun's 7.1.26.
    mean, spread = n * p, F.sqrt(n * p * (1 - p))
    x = (k - mean) / spread / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = t * (F.lit(c) + poly)
    tail = poly * F.exp(-x * x)
    tail = F.when(x >= 0, tail).otherwise(2 - tail)
    return F.when((n == 0) | (p <= 0) | (p >= 1) | (spread < 2.220446049250313e-16), F.lit(1.0)).otherwise(tail * 0.5) * float(4**size)


def kmer_enrichment(reads: DataFrame, config: QcConfig, placed: DataFrame | None = None) -> DataFrame:
    """(file_name, kmer, count, grp, label, hits, ratio, p): observed to expected in each group of positions.

    A k-mer's positions reach as far as the first read of a worker that shows it has some, and as far as it is seen: of the group
    in which they end, only positions up to there are expected."""
    # k-mers with N tell how many positions there are, and count in nothing else
    every_kmer = kmer_places(reads, config) if placed is None else placed
    placed = in_groups(every_kmer, config).where("kmer IS NOT NULL").select("file_name", "kmer", "grp", "hi", "label", "pos", "n")
    rows = placed.groupBy("file_name", "kmer", "grp", "hi", "label").agg(F.sum("n").alias("hits"), F.max("pos").alias("reach"))
    of = Window.partitionBy("file_name", "kmer")
    rows = rows.withColumns({"count": F.sum("hits").over(of), "reach": F.max("reach").over(of)}).where("hits > 0")
    at = placed.groupBy("file_name", "grp", "pos").agg(F.sum("n").alias("n"))
    totals = at.groupBy("file_name", "grp").agg(F.sum("n").alias("whole"), F.collect_list(F.struct("pos", "n")).alias("at"))  # some dozen groups a file
    totals = totals.withColumn("every", F.sum("whole").over(Window.partitionBy("file_name")))
    rows = rows.join(F.broadcast(totals), ["file_name", "grp"])
    part = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["pos"] <= F.col("reach"), x["n"]).otherwise(0))
    rows = rows.withColumn("group_count", F.when(F.col("reach") >= F.col("hi"), F.col("whole")).otherwise(part))
    share = (F.col("count").cast("float") / F.col("every").cast("float")).cast("float")
    rows = rows.withColumn("share", share).withColumn("predicted", (F.col("share") * F.col("group_count").cast("float")).cast("float"))
    rows = rows.withColumn(
        "ratio",
        F.when(F.col("predicted") > 0, (F.col("hits").cast("float") / F.col("predicted")).cast("float")).otherwise(F.lit(0).cast("float"))
    )
    p = kmer_p_value(F.col("group_count").cast("double"), F.col("share").cast("double"), F.col("hits").cast("double"), config.kmer_size).cast("float")
    tested = (F.col("hits").cast("float") > F.col("predicted")) & (F.col("ratio") > 5)
    return rows.select("file_name", "kmer", "count", "grp", "label", "hits", "ratio", F.when(tested, p).alias("p"))


def kmer_content(reads: DataFrame, config: QcConfig, enriched: DataFrame | None = None) -> DataFrame:
    """(file_name, rank, kmer, count, p_value, ratio, label): the KMER_TOP most uneven k-mers that are significant somewhere."""
    rows = kmer_enrichment(reads, config) if enriched is None else enriched
    best = rows.groupBy("file_name", "kmer", "count").agg(
        F.min(F.when(F.col("p") < 0.01, F.col("p"))).alias("p_value"), F.max("ratio").alias("ratio"),
        F.max_by("label", F.struct("ratio", "grp")).alias("label")
    ).where("p_value IS NOT NULL")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("file_name").orderBy(F.desc("ratio"), "kmer"))).where(F.col("rank") <= KMER_TOP)
    return best.select("file_name", "rank", "kmer", (F.col("count") * KMER_EVERY).alias("count"), "p_value", "ratio", "label").orderBy("file_name", "rank")


def kmer_series(enriched: DataFrame, content: DataFrame) -> DataFrame:
    """(file_name, rank, kmer, grp, ratio): the course of the first KMER_DRAWN k-mers over the groups that they occur in."""
    drawn = content.where(F.col("rank") <= KMER_DRAWN).select("file_name", "rank", "kmer")  # some rows a file
    return enriched.select("file_name", "kmer", "grp", "ratio").join(F.broadcast(drawn), ["file_name", "kmer"]).orderBy("file_name", "rank", "grp")


__all__ = [
    "adapter_content", "adapter_places", "duplication", "duplication_histogram",
    "early_key_counts", "key_counts", "kmer_content", "kmer_counts", "kmer_enrichment", "kmer_series", "overrepresented",
    "possible_source"
]
