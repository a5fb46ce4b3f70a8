"""Connected components of a table of edges, by alternating large and small stars; nothing comes to the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

ROWS_A_FILE = 250_000  # of 16 bytes: rounds over few edges don't write a small file for each task


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are hung on its least neighbour (or itself)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """(u, v): each node of an edge (two ids, no loops needed) but its component's least, with that least."""
    at = stage(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u <> v").distinct(), f"{path}/0")
    state, step, files = None, 0, -(-at.count() // ROWS_A_FILE)
    while True:
        step += 1
        at = stage(small_star(large_star(at)).coalesce(max(files, 1)), f"{path}/{step}")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return at
        state = now
