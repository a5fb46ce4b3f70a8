"""SAM and BAM as reads: soft clips, strands and missing qualities are dealt with by column functions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..schema import READS
from .bgzf import MAGIC, SPLIT_BYTES, Blocks, opened
from .fastq import read_fastq
from .lines import index, numbered

UNMAPPED, REVERSE = 0x4, 0x10
ALIGNED = "path string, read_idx long, id string, flag int, cigar string, sequence string, quality string"
# Fixed values of the BAM format: base letters by four-bit code, and CIGAR letters by code.
BAM_BASES = "=ACMGRSVTWYHKDBN"
BAM_CIGAR = "MIDNSHP=X"


def to_reads(aligned: DataFrame, only_mapped: bool) -> DataFrame:
    """READS from (path, read_idx, id, flag, cigar, sequence, quality).

    Mapped reads only: unmapped ones go, soft-clipped ends are cut.  A read on the reverse strand is turned round."""
    rows = aligned.withColumn("sequence", R.upper_ascii(F.when(F.col("sequence") == "*", "").otherwise(F.col("sequence"))))
    rows = rows.withColumn(
        "quality",
        F.when((F.col("quality") == "*") | (F.col("quality") == ""), F.repeat(F.lit("!"), F.length("sequence"))).otherwise(F.col("quality"))
    )
    if only_mapped:
        rows = rows.where(F.col("flag").bitwiseAND(UNMAPPED) == 0)
        cigar = F.col("cigar")
        rows = rows.withColumn("quality", R.clip_soft(F.col("quality"), cigar)).withColumn("sequence", R.clip_soft(F.col("sequence"), cigar))
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    out = rows.select(
        F.col("path").alias("file_name"),
        "read_idx",
        "id",
        F.when(back, R.reverse_complement("sequence")).otherwise(F.col("sequence")).alias("sequence"),
        F.when(back, F.reverse("quality")).otherwise(F.col("quality")).alias("quality"),
        F.lit(None).cast("string").alias("colorspace"),
        F.lit(False).alias("is_filtered"),
    )
    return out.select(*READS.fieldNames())


def read_sam(spark: SparkSession, paths: str | list[str], only_mapped: bool = False) -> DataFrame:
    """Header lines and records that lack fields or have a flag that isn't a number are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = numbered(spark, paths, index(spark, paths)).where(~F.startswith(F.col("line"), F.lit("@")))
    f = F.split("line", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.where((F.size(f) >= 11) & at(1).try_cast("int").isNotNull()).select(
        "path", F.col("line_idx").alias("read_idx"), at(0).alias("id"), at(1).try_cast("int").alias("flag"),
        at(5).alias("cigar"), at(9).alias("sequence"), F.regexp_replace(at(10), "\r$", "").alias("quality")
    )
    return to_reads(rows, only_mapped)


MOST_RECORD = MOST_AHEAD = 1 << 24  # bytes; a longer record isn't believed in where a part looks for its first one
BELIEVED = 8  # records in a row that must look like records there
LOOKED = "path string, begin long, until long, block long, at int, last_block long, last_at int, n long"


def skip_header(s: Blocks) -> None:
    try:
        if s.take(4) != b"BAM\x01":
            raise ValueError("not BAM")
    except EOFError:
        raise ValueError("not BAM") from None
    s.take(struct.unpack("<i", s.take(4))[0])
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        s.take(struct.unpack("<i", s.take(4))[0] + 4)


def _looks_like_records(ahead: bytearray, at: int, grow) -> bool:
    """Whether BELIEVED records, or all to the file's end, lie one behind the other from here; ``grow`` adds bytes ahead until there
    are so many, or tells that the file has no more."""
    for _ in range(BELIEVED):
        if not grow(at + 36):
            return at == len(ahead)
        size, ref, pos, name, _, n_cigar, _, n, mate, mate_pos = struct.unpack("<iiiBBxxHHiii", ahead[at : at + 32])
        if not 32 < size < MOST_RECORD or ref < -1 or pos < -1 or mate < -1 or mate_pos < -1 or name < 1 or n < 0:
            return False
        if 32 + name + 4 * n_cigar + (n + 1) // 2 + n > size:
            return False
        if not grow(at + 36 + name + 4 * n_cigar):
            return False
        text = ahead[at + 36 : at + 36 + name]
        if text[-1] or not all(33 <= c <= 126 for c in text[:-1]) or any(c & 15 > 8 for c in ahead[at + 36 + name : at + 36 + name + 4 * n_cigar : 4]):
            return False
        at += 4 + size
        if at > len(ahead) and not grow(at):
            return False
    return True


def _first_record(s: Blocks, until: int) -> tuple[int, int] | None:
    """The first place from the member that ``s`` stands in, before ``until``, where records seem to begin."""
    while s.block < until:
        block, data, after = s.block, s.data, s.next
        ahead = bytearray(data)

        def grow(n: int, ahead: bytearray = ahead) -> bool:
            while len(ahead) < n <= MOST_AHEAD and s.load():
                ahead.extend(s.data)
            return len(ahead) >= n

        for at in range(len(data)):
            if _looks_like_records(ahead, at, grow):
                return block, at
        s.next, s.data, s.at = after, b"", 0
        if not s.load():
            return None
    return None


def _decoded(data: bytes) -> tuple[str, int, str, str, str]:
    """(id, flag, cigar, sequence, quality) of a record."""
    name_size, n_cigar, flag, n = data[8], *struct.unpack("<HHi", data[12:20])
    at = 32 + name_size
    cigar = "".join(f"{x >> 4}{BAM_CIGAR[x & 15]}" for x in struct.unpack(f"<{n_cigar}I", data[at : at + 4 * n_cigar]))
    at += 4 * n_cigar
    seq = data[at : at + (n + 1) // 2].hex().translate(_NIBBLES)[:n]
    at += (n + 1) // 2
    qual = data[at : at + n]
    return data[32 : 31 + name_size].decode(), flag, cigar or "*", seq, "*" if not qual or qual[0] == 255 else qual.translate(_PHRED).decode("latin-1")


_NIBBLES = str.maketrans("0123456789abcdef", BAM_BASES)
_PHRED = bytes((q + 33) % 256 for q in range(256))


def _sizes(s: Blocks, until: int) -> Iterator[int]:
    """Bytes of each record that begins before ``until``; the stream stands behind its size."""
    while s.place()[0] < until:
        yield struct.unpack("<i", s.take(4))[0]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a file where its first record begins, where the one behind its last does, and how many there are; -1 where
    that can't be told."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            file, size = opened(r["path"])
            out = r | {"block": None, "at": None, "last_block": None, "last_at": None, "n": 0}
            with file:
                try:
                    s = Blocks(file, size)
                    if r["begin"] == 0:
                        skip_header(s)
                        first = s.place()
                    elif first := _first_record(s, r["until"]) if s.find(r["begin"]) else None:
                        s = Blocks(file, size, first[0])
                        s.load()
                        s.at = first[1]
                    if first:
                        for n in _sizes(s, r["until"]):
                            s.take(n)
                            out["n"] += 1
                        out |= dict(zip(("block", "at", "last_block", "last_at"), (*first, *s.place()), strict=True))
                except (EOFError, ValueError, zlib.error, struct.error):
                    out["n"] = -1
            rows.append(out)
        yield pa.RecordBatch.from_pylist(rows, _look_schema)


_look_schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[k]) for c, k in (x.split() for x in LOOKED.split(", "))])


def _read_bam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of parts (path, block, at, until, first); a part without ``block`` is a whole file."""
    names = ["path", "read_idx", "id", "flag", "cigar", "sequence", "quality"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for r in batch.to_pylist():
            file, size = opened(r["path"])
            with file:
                s = Blocks(file, size, r["block"] or 0)
                if r["block"] is None:
                    skip_header(s)
                else:
                    s.load()
                    s.at = r["at"]
                rows, held, i = [], 0, r["first"]
                for n in _sizes(s, size if r["until"] is None else r["until"]):
                    rows.append((r["path"], i, *_decoded(s.take(n))))
                    i, held = i + 1, held + n
                    if len(rows) == 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def bam_parts(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> list[tuple[str, int | None, int | None, int | None, int]]:
    """(path, block, at, until, first ordinal) of parts that can be read side by side; a row for each comes to the driver.

    A first pass lets each part of a file look for its first record by what records look like, and count.  A part whose guess isn't
    where the part before it ended is wrong: such a file, and one that can't be counted, is read by one task, which tells what is
    wrong with it."""
    whole = []
    for p in paths:
        file, size = opened(p)
        file.close()
        whole.append((p, size))
    files = spark.createDataFrame(whole, "path string, size long").where("size > 0")
    step = F.lit(split_bytes).cast("long")
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("begin"))
    parts = parts.select("path", "begin", F.least(F.col("begin") + step, "size").alias("until"))
    many = max(1, sum(-(-size // split_bytes) for _, size in whole))
    by_path: dict[str, list] = {p: [] for p in paths}
    for r in parts.repartition(many, "path", "begin").mapInArrow(_look, LOOKED).collect():
        by_path[r.path].append(r)
    out = []
    for (path, size), rows in zip(whole, by_path.values(), strict=True):
        own, place, first, good = [], None, 0, bool(rows)
        for r in sorted(rows, key=lambda r: r.begin):
            if r.n < 0 or r.block is None and (place is None or place[0] < r.until) or r.block is not None and place is not None and place != (r.block, r["at"]):
                good = False
                break
            if r.block is not None:
                own.append((path, r.block, r["at"], r.until, first))
                place, first = (r.last_block, r.last_at), first + r.n
        out += own if good and place == (size, 0) else [(path, None, None, None, 0)]
    return out


def read_bam(spark: SparkSession, paths: str | list[str], only_mapped: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A task for each part of a file; see bam_parts()."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = bam_parts(spark, paths, split_bytes)
    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(parts)], "n int, path string, block long, at int, until long, first long")
    return to_reads(rows.repartitionByRange(len(parts), "n").drop("n").mapInArrow(_read_bam, ALIGNED), only_mapped)


def detect_format(path: str, wanted: str | None = None) -> str:
    """What is asked for, else by the name's ending."""
    if wanted:
        return wanted
    low = path.lower()
    return "bam" if low.endswith((".bam", ".ubam")) else "sam" if low.endswith(".sam") else "fastq"


def read_any(spark: SparkSession, paths: str | list[str], config=None) -> tuple[DataFrame, str]:
    """Reads of files of one format, and the format.  Text or binary is told by the name also where a format is asked for."""
    from ..config import QcConfig

    config = config or QcConfig()
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {detect_format(p, config.format) for p in paths}
    if len(kinds) != 1:
        raise ValueError("files of one format at a time")
    kind = kinds.pop()
    if kind == "fastq":
        return read_fastq(spark, paths, config), kind
    text = [p for p in paths if p.lower().endswith(".sam")]
    binary = [p for p in paths if p not in text]
    found = [reader(spark, own, kind.endswith("_mapped")) for reader, own in ((read_sam, text), (read_bam, binary)) if own]
    return reduce(DataFrame.unionByName, found), kind
