"""FASTQ: four lines a record, plain, gzip or bzip2, from any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions import reads as R
from ..schema import READS
from .bgzf import SPLIT_BYTES
from .lines import FileIndex, index, split_runs, text_lines

RECORD = "path string, read_idx long, id string, sequence string, plus string, quality string"


class FastqError(ValueError):
    """A record that isn't one; the file is not analysed."""


def check(path: str, at: int, lines: list[str]) -> list[str]:
    """A record's four lines without line ends."""
    lines = [x.rstrip("\r\n") for x in lines]
    if len(lines) < 4:
        raise FastqError(f"{path}: record {at + 1} is cut short")
    if not lines[0].startswith("@"):
        raise FastqError(f"{path}: the id line of record {at + 1} doesn't begin with @")
    if not lines[2].startswith("+"):
        raise FastqError(f"{path}: the middle line of record {at + 1} doesn't begin with +")
    if len(lines[1]) != len(lines[3]):
        raise FastqError(f"{path}: record {at + 1} has {len(lines[1])} bases and {len(lines[3])} qualities")
    return lines


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)],
        ["path", "read_idx", "id", "sequence", "plus", "quality"]
    )


def _records(batches: Iterator[pa.RecordBatch], found: dict[str, FileIndex], lenient: bool) -> Iterator[pa.RecordBatch]:
    """Records that lie within one split; those over a border come from the index."""
    seen: dict[tuple[str, int], int] = {}
    left: dict[tuple[str, int], list[str]] = {}
    for batch in batches:
        rows = []
        for key, lines in split_runs(batch):
            path, block = key
            ix = found[path]
            at = ix.first[block] + seen.get(key, 0)
            seen[key] = seen.get(key, 0) + len(lines)
            lines = left.pop(key, []) + lines
            at -= len(lines) - (ix.first[block] + seen[key] - at)
            skip = -at % 4 if at == ix.first[block] else 0
            lines, at = lines[skip:], at + skip
            whole = len(lines) - len(lines) % 4
            for k in range(0, whole, 4):
                if at + k + 4 <= ix.total:
                    four = lines[k : k + 4]
                    rows.append((path, (at + k) // 4, *([x.rstrip("\r\n") for x in four] if lenient else check(path, (at + k) // 4, four))))
            if whole < len(lines):
                left[key] = lines[whole:]
        if rows:
            yield _batch(rows)


def _border_records(found: dict[str, FileIndex], lenient: bool) -> list[tuple]:
    """Records over the borders of splits, and the one that a file may end in the middle of."""
    out = []
    for path, ix in found.items():
        starts = {n for n in ix.first.values() if n % 4 and n < ix.total}
        for record in sorted({n // 4 for n in starts} | ({ix.total // 4} if ix.total % 4 else set())):
            lines = [ix.edges[i] for i in range(record * 4, min(record * 4 + 4, ix.total))]
            if len(lines) < 4:
                if not lenient:
                    check(path, record, lines)
                continue
            out.append((path, record, *([x.rstrip("\r\n") for x in lines] if lenient else check(path, record, lines))))
    return out


def _sequential(batches: Iterator[pa.RecordBatch], lenient: bool) -> Iterator[pa.RecordBatch]:
    """One file's lines in order, some of them blank: these are skipped before an id line only."""
    path, at, held, rows = None, 0, [], []
    for batch in batches:
        for p, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if p != path:
                if held and not lenient:
                    check(path, at, held)
                path, at, held = p, 0, []
            if not held and not line.strip("\r"):
                continue
            held.append(line)
            if len(held) == 4:
                rows.append((path, at, *([x.rstrip("\r\n") for x in held] if lenient else check(path, at, held))))
                at, held = at + 1, []
        if rows:
            yield _batch(rows)
            rows = []
    if held and not lenient:
        check(path, at, held)


def records(spark: SparkSession, paths: str | list[str], lenient: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, read_idx, id, sequence, plus, quality); ids keep their @.

    A file with blank lines between its records is put together in order by one task; any other is read split by split, and
    only the records over the borders of splits are put together by the driver.  BGZF is split into parts of ``split_bytes``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = index(spark, paths, split_bytes)
    plain = {p: ix for p, ix in found.items() if not ix.blank_ids}
    out = spark.createDataFrame(_border_records(plain, lenient), RECORD)
    if plain:
        out = out.unionAll(text_lines(spark, plain).mapInArrow(partial(_records, found=plain, lenient=lenient), RECORD))
    if odd := [p for p in found if p not in plain]:
        from .lines import numbered

        lines = numbered(spark, odd, {p: found[p] for p in odd}).repartition("path").sortWithinPartitions("path", "line_idx")
        out = out.unionAll(lines.mapInArrow(partial(_sequential, lenient=lenient), RECORD))
    return out


def records_of_lines(lines: DataFrame) -> DataFrame:
    """(path, read_idx, id, sequence, plus, quality) from any DataFrame of lines: (path, line_idx, value), counted from 0 without
    blank lines.  Four lines in a row are a record; what isn't one raises an error."""
    at = F.col("line_idx") % 4
    line = lambda k: F.max(F.when(at == k, F.regexp_replace("value", "\\r$", "")))
    rows = lines.groupBy("path", F.floor(F.col("line_idx") / 4).alias("read_idx")).agg(
        *(line(k).alias(name) for k, name in enumerate(("id", "sequence", "plus", "quality")))
    )
    good = F.startswith("id", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("sequence") == F.length("quality"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("id")).otherwise(
        F.raise_error(F.concat(F.lit("no FASTQ record at line "), F.col("read_idx") * 4 + 1))
    )
    return rows.withColumn("id", checked)


def read_fastq(spark: SparkSession, paths: str | list[str], config: QcConfig | None = None) -> DataFrame:
    """Reads in READS' schema; file_name is the path, so that files of equal names stay apart.  A file is in colour space if its first read is; its bases are then decoded."""
    return as_reads(records(spark, paths), config or QcConfig())


def as_reads(rows: DataFrame, config: QcConfig) -> DataFrame:
    """Records in READS' schema."""
    first = rows.where("read_idx = 0").select("path", R.is_colorspace(F.col("sequence")).alias("_colours"))
    rows = rows.join(F.broadcast(first), "path", "left")  # a row for each file
    coloured = F.coalesce(F.col("_colours"), F.lit(False))
    filtered = R.is_casava_filtered(F.col("id")) if config.casava and not config.nofilter else F.lit(False)
    out = rows.select(
        F.col("path").alias("file_name"),
        "read_idx",
        F.substring("id", F.lit(2), F.length("id")).alias("id"),
        F.when(coloured, R.colorspace_to_bases(F.col("sequence"))).otherwise(R.upper_ascii(F.col("sequence"))).alias("sequence"),
        F.when(coloured, F.substring("quality", F.lit(2), F.length("quality"))).otherwise(F.col("quality")).alias("quality"),
        F.when(coloured, F.col("sequence")).alias("colorspace"),
        filtered.alias("is_filtered"),
    )
    return out.select(*READS.fieldNames())


def write_fastq(rows: DataFrame, path: str, gzip: bool = False, order: str = "read_idx") -> None:
    """Part files of records in the order of ``order``; ids are written with one @."""
    at = F.when(F.startswith(F.col("id"), F.lit("@")), F.col("id")).otherwise(F.concat(F.lit("@"), F.col("id")))
    plus = F.col("plus") if "plus" in rows.columns else F.lit("+")
    text = rows.orderBy(order).select(F.concat_ws("\n", at, F.col("sequence"), plus, F.col("quality")).alias("value"))
    text.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)
