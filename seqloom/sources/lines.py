"""Numbered lines of text files, in parallel.

Spark splits large files and keeps no order, but the rows of one split come in order.  A first, cheap pass counts each split's
lines and keeps its first and last few; from these the driver (a row for each split) knows every split's first line number.  The
second pass numbers the lines without a shuffle.

A large BGZF file is split, too: the first pass lets each part seek its first member, and is held against where the part before it
ended.  Where these don't meet (other gzip members, a broken file) the file is read as any other gzip, by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bgzf import SPLIT_BYTES, Part, large

EDGE = 3  # lines kept at either end of a split
COUNTED = "path string, block long, n long, blanks array<long>, trailing long, head array<string>, tail array<string>"
COUNTED_PART = f"{COUNTED}, until long, first long, last long"
LINE = "path string, block long, line string"


def text_lines(spark: SparkSession, found: dict[str, FileIndex]) -> DataFrame:
    """(path, block, line): ``block`` is where the line's split begins."""
    parts = [(p, *part) for p, ix in found.items() for part in ix.parts]
    out = [_parts(spark, parts).mapInArrow(_part_lines, LINE)] if parts else []
    if plain := [p for p, ix in found.items() if not ix.parts]:
        out.append(_spark_lines(spark, [unquote(p) for p in plain]))  # Spark names files by their URLs
    return reduce(DataFrame.unionAll, out)


def _spark_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line")
    )


def _parts(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """A task for each (path, begin, until, first member)."""
    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(parts)], "n int, path string, begin long, until long, member long")
    return rows.repartitionByRange(len(parts), "n").drop("n")


def _part_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield from Part(**r).batches()


def split_runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The lines of a batch by split, in order."""
    paths, blocks, lines = batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("line").to_pylist()
    at = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or (paths[i], blocks[i]) != (paths[at], blocks[at]):
            yield (paths[at], blocks[at]), lines[at:i]
            at = i


def _tally(batches: Iterator[pa.RecordBatch]) -> dict[tuple[str, int], dict]:
    """By split."""
    found: dict[tuple[str, int], dict] = {}
    for batch in batches:
        for key, lines in split_runs(batch):
            s = found.setdefault(key, {"n": 0, "blanks": [0] * 4, "trailing": 0, "head": [], "tail": []})
            for line in lines:
                if line.strip("\r"):
                    s["trailing"] = 0
                else:
                    s["trailing"] += 1
                    s["blanks"][s["n"] % 4] += 1
                s["n"] += 1
            s["head"] = (s["head"] + lines[:EDGE])[:EDGE]
            s["tail"] = (s["tail"] + lines[-EDGE:])[-EDGE:]
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [{"path": p, "block": b} | s for (p, b), s in _tally(batches).items()]
    yield pa.RecordBatch.from_pylist(rows, _counted)


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part; no first member where none begins in it, and no lines (-1) where it can't be read."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            part, own = Part(**r), {"n": 0, "blanks": [0] * 4, "trailing": 0, "head": [], "tail": []}
            try:
                for own in _tally(part.batches()).values():  # one split
                    pass
            except (EOFError, ValueError, zlib.error, struct.error):
                own = own | {"n": -1}
            rows.append(own | {"path": part.path, "block": part.begin, "until": part.until, "first": part.first, "last": part.last})
        yield pa.RecordBatch.from_pylist(rows, _counted_parts)


_counted = pa.schema(
    [
        ("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("blanks", pa.list_(pa.int64())),
        ("trailing", pa.int64()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))
    ]
)
_counted_parts = pa.schema([*_counted, ("until", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


@dataclass
class FileIndex:
    """Where a file's splits begin, in lines."""

    first: dict[int, int] = field(default_factory=dict)  # by block
    sizes: dict[int, int] = field(default_factory=dict)
    edges: dict[int, str] = field(default_factory=dict)  # lines at the splits' ends, by number
    total: int = 0  # without blank lines at the end
    blank_ids: int = 0  # blank lines whose number is a multiple of four
    parts: list[tuple[int, int, int]] = field(default_factory=list)  # of BGZF: begin, until, first member


def _whole_chain(rows: list, size: int) -> bool:
    """Whether each part begins where the one before it ended, and the last one at the file's end."""
    place = 0
    for r in rows:
        if r.n < 0 or (place < r.until if r["first"] is None else r["first"] != place):
            return False
        place = place if r["first"] is None else r.last
    return place == size


def index(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> dict[str, FileIndex]:
    """By path as Spark names it (BGZF that is split: as given); a row for each split comes to the driver."""
    by_path = defaultdict(list)
    blocked = {p: size for p in paths if (size := large(p, split_bytes))}
    parts = [(p, at, min(at + split_bytes, size), None) for p, size in blocked.items() for at in range(0, size, split_bytes)]
    for r in _parts(spark, parts).mapInArrow(_count_parts, COUNTED_PART).collect() if parts else ():
        by_path[r.path].append(r)
    for p, size in blocked.items():
        by_path[p].sort(key=lambda r: r.block)
        if not _whole_chain(by_path[p], size):
            del by_path[p]
    cut = {*by_path}
    if plain := [p for p in paths if p not in cut]:
        for r in _spark_lines(spark, plain).mapInArrow(_count, COUNTED).collect():
            by_path[r.path].append(r)
    out = {}
    for path, rows in by_path.items():
        ix = out[path] = FileIndex()
        if path in cut:
            ix.parts = [(r.block, r.until, r["first"]) for r in rows if r["first"] is not None]
        at, blanks, trailing = 0, 0, 0
        for r in sorted(rows, key=lambda r: r.block):
            ix.first[r.block], ix.sizes[r.block] = at, r.n
            blanks += r.blanks[-at % 4]
            trailing = trailing + r.n if r.trailing == r.n else r.trailing
            for k, line in enumerate(r["head"]):
                ix.edges[at + k] = line
            for k, line in enumerate(r["tail"]):
                ix.edges[at + r.n - len(r["tail"]) + k] = line
            at += r.n
        ix.total = at - trailing
        ix.blank_ids = blanks - sum(i % 4 == 0 for i in range(ix.total, at))
    return out


def _number(batches: Iterator[pa.RecordBatch], firsts: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        numbers = []
        for key, lines in split_runs(batch):
            at = firsts[key] + seen.get(key, 0)
            numbers += range(at, at + len(lines))
            seen[key] = seen.get(key, 0) + len(lines)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(numbers, pa.int64()), batch.column("line")], ["path", "line_idx", "line"])


def numbered(spark: SparkSession, paths: list[str], found: dict[str, FileIndex] | None = None) -> DataFrame:
    """(path, line_idx, line)."""
    found = found if found is not None else index(spark, paths)
    firsts = {(p, b): n for p, ix in found.items() for b, n in ix.first.items()}
    return text_lines(spark, found).mapInArrow(partial(_number, firsts=firsts), "path string, line_idx long, line string")
