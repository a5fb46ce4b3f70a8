"""A folder of part files as one file, in the parts' order.

Gzip members one behind the other are a gzip file, and lines behind lines are a text; so each part's place follows from the sizes of
those before it, and tasks copy their parts there side by side.  A task that runs again writes the same bytes to the same place; the
file gets its name when all are done."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession

PIECE = 8 << 20
COPY_BYTES = 256 << 20  # of a part that one task copies


def shared_path(spark: SparkSession, path: str) -> str | None:
    """The path in the file system that driver and tasks share, if it lies there; None for other stores."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return os.path.abspath(path) if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and default.startswith("file:") else None


def _copy(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            out = os.open(target, os.O_WRONLY)
            try:
                with open(r["part"], "rb") as f:
                    f.seek(r["begin"])
                    left, at = r["size"], r["at"]
                    while left:
                        piece = memoryview(f.read(min(PIECE, left)))
                        if not piece:
                            raise EOFError(f"{r['part']} is shorter than it was")
                        left -= len(piece)
                        while piece:
                            n = os.pwrite(out, piece, at)
                            piece, at = piece[n:], at + n
                os.fsync(out)
            finally:
                os.close(out)
            yield pa.RecordBatch.from_pydict({"copied": pa.array([r["size"]], pa.int64())})


def write_as_one(spark: SparkSession, write: Callable[[str], None], path: str, copy_bytes: int = COPY_BYTES) -> str:
    """Let ``write`` fill a folder beside ``path`` and make one file of its parts.  On a store in which no place of a file can be
    written, ``path`` is that folder.  An earlier file of the name is replaced; a folder of the name is an error."""
    final = shared_path(spark, path)
    if final is None:
        write(path)
        return path
    if os.path.isdir(final):
        raise IsADirectoryError(f"{final} is a folder, not a file to be replaced")
    folder, target = f"{final}.parts", f"{final}.joining"
    write(f"file://{folder}")
    parts = sorted((int(m[1]), name) for name in os.listdir(folder) if (m := re.match(r"part-(\d+)", name)))
    rows, at = [], 0
    for _, name in parts:
        size = os.path.getsize(f"{folder}/{name}")
        rows += [(len(rows) + i, f"{folder}/{name}", b, min(copy_bytes, size - b), at + b) for i, b in enumerate(range(0, size, copy_bytes))]
        at += size
    with open(target, "wb") as f:
        f.truncate(at)
    if rows:
        places = spark.createDataFrame(rows, "n int, part string, begin long, size long, at long")
        done = places.repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism), "n").drop("n")
        copied = sum(r.copied for r in done.mapInArrow(partial(_copy, target=target), "copied long").groupBy().sum("copied").toDF("copied").collect())
        if copied != at:
            raise OSError(f"{copied} of {at} bytes were copied to {target}")
    os.replace(target, final)
    shutil.rmtree(folder)
    return path
