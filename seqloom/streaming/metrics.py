"""Quality metrics over reads that keep arriving: every module whose state is a sum of counts can run as a stream.

The first-keys rule of duplication and the sampling by ordinals depend on the whole file's order and stay batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import reads as R
from ..operators.common import position_partials, unfiltered
from ..operators.positions import position_quality
from ..schema import READS


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files in READS' schema, as they come."""
    return spark.readStream.schema(READS).parquet(path)


def cube_stream(reads: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The position cube, kept up to date in the in-memory table ``name``."""
    counts = position_partials(reads).groupBy("file_name", "pos", "base", "code").agg(F.sum("n").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def totals_stream(reads: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Reads, bases and GC by file."""
    seq = F.col("sequence")
    rows = unfiltered(reads).groupBy("file_name").agg(
        F.count("*").alias("reads"), F.sum(F.length(seq)).alias("bases"), F.sum(R.gc_count(seq)).alias("gc"),
        F.min(F.length(seq)).alias("least"), F.max(F.length(seq)).alias("most")
    )
    return rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def cube_files(reads: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The position cube as Parquet files, a folder for each trigger: it never comes to the driver."""
    counts = position_partials(reads).groupBy("file_name", "pos", "base", "code").agg(F.sum("n").alias("n"))
    write = lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/state={k:012d}")
    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def quality_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Position quality from the newest state of cube_files()."""
    states = spark.read.parquet(folder)
    newest = states.agg(F.max("state")).first()[0]
    return position_quality(spark.read.parquet(f"{folder}/state={int(newest):012d}"))


def windowed_totals(reads: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Reads, bases and GC by file and window of arrival; reads that come later than ``late`` don't count, and finished windows
    leave the state."""
    seq = F.col("sequence")
    rows = unfiltered(reads).withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "file_name")
    return rows.agg(F.count("*").alias("reads"), F.sum(F.length(seq)).alias("bases"), F.sum(R.gc_count(seq)).alias("gc"))


def current_quality(spark: SparkSession, name: str) -> DataFrame:
    """Position quality from a cube that is kept up to date; an in-memory table is on the driver already."""
    now = spark.table(name)
    return position_quality(spark.createDataFrame(now.collect(), now.schema))
