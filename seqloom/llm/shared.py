"""The folder that driver and executors share, and files in it.

Spark's tasks write side files (model levels, media shards) only below the folder named by
``spark.checkpoint.dir``.  Where that is unset (tests, a local session) a folder of this machine is made and set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import suppress

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def base_dir(spark: SparkSession) -> str:
    """URI of the shared folder; set here only where the session has none."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder for one run of one operator."""
    return f"{base_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it again: cuts lineage, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, also those whose names have dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder once nothing reads it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A filesystem and the path in it, for executors and driver alike."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts: list) -> None:
    """Write a file whole or not at all: a unique name first, then a rename, so that attempts don't mix."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}.tmp") as out:
        for p in parts:
            out.write(p)
    try:
        fs.move(tmp, path)
    except OSError:  # a store without renaming over a file: another attempt wrote the same bytes
        with suppress(OSError):
            fs.delete_file(tmp)


def local_copy(uri: str) -> str | int:
    """What can be memory-mapped: the path of a mounted file, or a descriptor of an unlinked copy of a remote one."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    handle = tempfile.TemporaryFile()  # noqa: SIM115  gone when closed
    with fs.open_input_stream(path) as src:
        while block := src.read(1 << 22):
            handle.write(block)
    handle.flush()
    return os.dup(handle.fileno())
