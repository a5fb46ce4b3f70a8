"""Per-position modules: quality, base content, N content and tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions import reads as R
from ..functions.columns import Counts, column_bytes, file_runs, places, slices
from .common import in_groups, position_cube, with_ordinal, worker

PERCENTILES = (50, 25, 75, 10, 90)
LEAST_SEEN = 100
LEAST_CODE = 33
TILE_EVERY, TILE_MOST = 10, 2_500


def position_quality(cube: DataFrame) -> DataFrame:
    """(file_name, pos, total, mean, p50, p25, p75, p10, p90): percentiles are null up to LEAST_SEEN observations.

    A percentile is the first code at which the running count reaches the whole part of its share of all.  The file's offset,
    which follows from its least code, is taken off at the end: codes below the lower offset don't count either way."""
    rows = cube.where("code > 0").groupBy("file_name", "pos", "code").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("file_name", "pos")
    rows = rows.withColumns({"total": F.sum("n").over(by), "least": F.min("code").over(by)}).where(F.col("code") >= LEAST_CODE)
    rows = rows.withColumn("upto", F.sum("n").over(by.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)))
    reach = lambda p: F.min(F.when(F.col("upto") >= F.floor(F.col("total") * p / 100), F.col("code")))
    out = rows.groupBy("file_name", "pos").agg(
        F.max("total").alias("total"), F.min("least").alias("least"),
        F.sum(F.col("n") * F.col("code")).alias("codes"), F.sum("n").alias("n"),
        *(reach(p).alias(f"p{p}") for p in PERCENTILES)
    )
    offset = R.phred_offset(F.min("least").over(Window.partitionBy("file_name")))
    out = out.withColumn("offset", offset)
    mean = (F.col("codes") - F.col("n") * F.col("offset")) / F.col("n")
    share = lambda p: F.when(F.col("total") > LEAST_SEEN, F.coalesce(F.col(f"p{p}") - F.col("offset"), F.lit(-1))).cast("double")
    return out.select("file_name", "pos", "total", mean.alias("mean"), *(share(p).alias(f"p{p}") for p in PERCENTILES))


def base_quality(reads: DataFrame, config: QcConfig, cube: DataFrame | None = None) -> DataFrame:
    """(file_name, grp, label, mean, median, lower, upper, p10, p90): unweighted means over a group's positions; NaN where no
    position has enough observations, and 0 for the mean of a group without any."""
    found = in_groups(position_quality(position_cube(reads) if cube is None else cube), config)
    nan = F.lit(float("nan"))
    return found.groupBy("file_name", "grp", "label").agg(
        F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean"),
        *(F.coalesce(F.avg(f"p{p}"), nan).alias(name) for p, name in zip(PERCENTILES, ("median", "lower", "upper", "p10", "p90"), strict=True))
    )


def _by_group(cube: DataFrame, config: QcConfig, aggregates: list[Column]) -> DataFrame:
    counts = cube.groupBy("file_name", "pos", "base").agg(F.sum("n").alias("n"))
    return in_groups(counts, config).groupBy("file_name", "grp", "label").agg(*aggregates)


def _sum(bases: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("base").isin(*bases), F.col("n"))), F.lit(0))


def base_content(reads: DataFrame, config: QcConfig, cube: DataFrame | None = None) -> DataFrame:
    """(file_name, grp, label, g, a, t, c): percentages of the group's A, C, G and T together."""
    rows = _by_group(position_cube(reads) if cube is None else cube, config, [_sum(b).alias(b.lower()) for b in "GATC"])
    total = F.col("g") + F.col("a") + F.col("t") + F.col("c")
    return rows.select("file_name", "grp", "label", *(F.when(total > 0, F.col(b) * 100.0 / total).otherwise(0.0).alias(b) for b in "gatc"))


def n_content(reads: DataFrame, config: QcConfig, cube: DataFrame | None = None) -> DataFrame:
    """(file_name, grp, label, n_percent): of all bases of the group."""
    rows = _by_group(position_cube(reads) if cube is None else cube, config, [_sum("N").alias("ns"), F.coalesce(F.sum("n"), F.lit(0)).alias("every")])
    return rows.select("file_name", "grp", "label", F.when(F.col("every") > 0, F.col("ns") * 100.0 / F.col("every")).otherwise(0.0).alias("n_percent"))


def add_tiles(name: object, own: pa.Array, raw: np.ndarray, off: np.ndarray, tiles: dict, lowest: dict, found: Counts, most: int | None = None) -> None:
    """Add a file's sums by (tile, place).  A read without a tile, or more than ``most`` tiles, marks the file by None."""
    known = tiles.setdefault(name, set())
    if known is None:
        return
    known.update(own.drop_null().unique().to_pylist())
    if own.null_count or most is not None and len(known) > most:
        tiles[name] = None
        return
    ranked = np.sort(np.array([*known], np.int64))
    row, at = places(np.diff(off))
    code = raw.astype(np.int64)
    wide = int(at.max(initial=0)) + 1
    key = np.searchsorted(ranked, own.to_numpy())[row] * wide + at
    counts = code >= LEAST_CODE
    if len(ranked) * wide <= 4 * len(key) + (1 << 20):
        seen = np.bincount(key, minlength=len(ranked) * wide)
        full = np.flatnonzero(seen)
        n, s = (np.bincount(key, w, len(seen)).astype(np.int64)[full] for w in (counts, code * counts))
    else:
        full, back = np.unique(key, return_inverse=True)
        n, s = (np.bincount(back, w, len(full)).astype(np.int64) for w in (counts, code * counts))
    tile, place = np.divmod(full, wide)
    found.add(name, ranked[tile] << 31 | place, n, s)
    lowest[name] = min(lowest.get(name, 255), int(code.min(initial=255)))


def merged_tiles(name: object, tiles: dict, lowest: dict, found: Counts) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, int]:
    """Places (from 1 on), tiles, numbers, sums and the least code of a file; one row with a null tile where it gives nothing."""
    gone = tiles[name] is None
    keys, n, s = (np.zeros(1, np.int64),) * 3 if gone else found.merged(name)
    return (keys & ((1 << 31) - 1)) + 1, pa.array(keys >> 31, mask=np.full(len(keys), gone)), n, s, lowest.get(name, 255)


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sums by (file, tile, place)."""
    found, tiles, lowest = Counts(), {}, {}
    for batch in batches:
        raw, off = column_bytes(batch.column("quality"))
        for name, a, b in file_runs(batch.column("file_name")):
            for c, d in slices(off[a : b + 1]):
                c, d = a + c, a + d
                add_tiles(name, batch.column("tile")[c:d], raw[off[c] : off[d]], off[c : d + 1] - off[c], tiles, lowest, found)
    for name in tiles:
        place, tile, n, s, least = merged_tiles(name, tiles, lowest, found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(n), pa.string()), tile.cast(pa.int32()), pa.array(place.astype(np.int32)), pa.array(n), pa.array(s),
                pa.array(np.full(len(n), least, np.int32))
            ],
            ["file_name", "tile", "pos", "n", "s", "least"],
        )


def tile_ends(rows: DataFrame) -> DataFrame:
    """(file_name, worker, stop, over, gone) from sampled reads (file_name, worker, ordinal, tile).

    A worker gives up at its first read without a tile (``stop``), keeping what it has counted, or when one more tile than may be
    comes up (``over``), keeping nothing.  If it is the first worker, the file has no tiles (``gone``)."""
    firsts = rows.groupBy("file_name", "worker", "tile").agg(F.min("ordinal").alias("first"))
    stops = firsts.groupBy("file_name", "worker").agg(F.min(F.when(F.col("tile").isNull(), F.col("first"))).alias("stop"))  # a row a worker
    before = firsts.join(F.broadcast(stops), ["file_name", "worker"]).where("tile IS NOT NULL AND (stop IS NULL OR first < stop)")
    tiles = before.groupBy("file_name", "worker").agg((F.count("*") > TILE_MOST + 1).alias("over"))
    ends = stops.join(tiles, ["file_name", "worker"], "left").withColumn("over", F.coalesce("over", F.lit(False)))
    gone = F.max((F.col("worker") == 0) & (F.col("over") | F.col("stop").isNotNull())).over(Window.partitionBy("file_name"))
    return ends.withColumn("gone", gone)


def tile_sums(reads: DataFrame, config: QcConfig) -> DataFrame:
    """(file_name, tile, pos, n, s, least) of the sampled reads, a worker's first TILE_ALL, then each TILE_EVERY-th: partial counts
    and sums of the codes, and the least code of the file that the task saw.

    The tile's field is told by each worker's first read with qualities; its row, and where it gives up, are broadcast (a row a
    worker)."""
    none = F.col("is_filtered") | (F.coalesce(F.length("quality"), F.lit(0)) == 0)
    rows = with_ordinal(reads, "ordinal", config.compat, none, config.dense).where((F.col("ordinal") <= config.tile_all) | (F.col("ordinal") % TILE_EVERY == 0))
    rows = rows.select("file_name", worker(config.compat).alias("worker"), "ordinal", "id", "quality")
    by = ["file_name", "worker"]
    first = rows.groupBy(*by).agg(F.min_by(R.tile_field(F.col("id")), "ordinal").alias("field"))
    rows = rows.join(F.broadcast(first), by).select(*by, "ordinal", R.tile(F.col("id"), F.col("field")).alias("tile"), "quality")
    rows = rows.join(F.broadcast(tile_ends(rows)), by).where("NOT gone AND NOT over AND (stop IS NULL OR ordinal < stop)")
    return rows.select("file_name", "tile", "quality").mapInArrow(_tile_sums, "file_name string, tile int, pos int, n long, s long, least int")


def tile_quality(reads: DataFrame, config: QcConfig, sums: DataFrame | None = None) -> DataFrame:
    """(file_name, tile, grp, label, mean_deviation): each tile's mean quality less the mean over tiles; a tile without data
    in a group counts as 0, so the grid of tiles and groups is dense.  What a worker that gives up has counted follows from
    tile_ends()."""
    if sums is None:
        from . import fused  # which counts by this module's rules

        sums = fused.quick_tiles(reads, config)
    counts = (tile_sums(reads, config) if sums is None else sums).groupBy("file_name", "tile", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"))
    of = Window.partitionBy("file_name")
    counts = counts.withColumn("offset", R.phred_offset(F.min("least").over(of)))
    means = counts.select("file_name", "tile", "pos", ((F.col("s") - F.col("n") * F.col("offset")) / F.nullif("n", F.lit(0))).alias("mean"))
    found = in_groups(means, config).groupBy("file_name", "tile", "grp", "label").agg(F.avg("mean").alias("mean"))
    found = found.withColumn("groups", F.collect_set(F.struct("grp", "label")).over(of))
    each = found.groupBy("file_name", "tile").agg(F.map_from_entries(F.collect_list(F.struct("grp", "mean"))).alias("own"), F.first("groups").alias("groups"))
    dense = each.select("file_name", "tile", "own", F.explode("groups").alias("g")).select(
        "file_name", "tile", "g.grp", "g.label",
        F.coalesce(F.try_element_at("own", F.col("g.grp")), F.lit(0.0)).alias("mean")
    )
    return dense.select(
        "file_name", "tile", "grp", "label",
        (F.col("mean") - F.avg("mean").over(Window.partitionBy("file_name", "grp"))).alias("mean_deviation")
    )
