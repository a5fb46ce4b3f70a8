"""Trimming as DataFrame steps over records (path or file_name, read_idx, id, sequence, quality)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from . import kernels

# Adapters by preset.
PRESETS = {
    "illumina": ("AGATCGGAAGAGC", "Illumina TruSeq, Sanger iPCR"),
    "nextera": ("CTGTCTCTTATA", "Nextera Transposase sequence"),
    "small_rna": ("TGGAATTCTCGG", "Illumina small RNA adapter"),
    "stranded_illumina": ("ACTGTCTCTTATA", "Illumina stranded mRNA/Total RNA"),
    "bgiseq": ("AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA", "BGISEQ/DNBSEQ/MGISEQ"),
}
# Second reads' adapters that follow from the first reads'.
SECOND = {"TGGAATTCTCGG": "GATCGTCGGACT", "AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA": "AAGTCGGATCGTAGCCATGTCGTTCTGTGAGCCAAGGAGTTG"}
CANDIDATES = ("illumina", "nextera", "small_rna")
BASES = 1 << 22  # that are trimmed at a time
HEAD_READS, HEAD_TOTAL = 999_999, 1_000_000


@dataclass(frozen=True)
class TrimConfig:
    """Options; what contradicts itself raises an error."""

    quality: int = 20
    phred64: bool = False
    nextseq: int | None = None
    adapter: str | None = None
    adapter2: str | None = None
    preset: str | None = None
    stringency: int = 1
    error_rate: float = 0.1
    length: int = 20
    max_length: int | None = None
    max_n: float | None = None
    trim_n: bool = False
    clip_r1: int | None = None
    clip_r2: int | None = None
    three_prime_clip_r1: int | None = None
    three_prime_clip_r2: int | None = None
    rename: bool = False
    paired: bool = False
    retain_unpaired: bool = False
    length_1: int = 35
    length_2: int = 35
    rrbs: bool = False
    non_directional: bool = False
    consider_already_trimmed: int | None = None
    hardtrim5: int | None = None
    hardtrim3: int | None = None
    basename: str | None = None
    files: tuple[str, ...] = field(default=())

    def __post_init__(self):
        wrong = []
        if not 0 <= self.error_rate <= 1:
            wrong.append("the error rate must be from 0 to 1")
        if self.paired and len(self.files) % 2:
            wrong.append("paired mode needs an even number of files")
        if self.adapter and self.preset:
            wrong.append("an adapter and a preset exclude each other")
        if self.preset and self.preset not in PRESETS:
            wrong.append(f"unknown preset {self.preset}")
        if self.adapter2 and not self.paired:
            wrong.append("a second adapter needs paired mode")
        if self.hardtrim5 is not None and self.hardtrim3 is not None:
            wrong.append("trimming hard to 5' and to 3' exclude each other")
        for n in (self.hardtrim5, self.hardtrim3):
            if n is not None and not 1 <= n <= 999:
                wrong.append("a hard-trimmed length must be from 1 to 999")
        if self.nextseq is not None and self.quality != 20:
            wrong.append("a two-colour cutoff excludes a quality cutoff")
        if self.retain_unpaired and not self.paired:
            wrong.append("unpaired reads are kept in paired mode only")
        if self.stringency < 1:
            wrong.append("the overlap must be 1 at least")
        if self.basename and (self.paired and len(self.files) > 2 or not self.paired and len(self.files) > 1):
            wrong.append("a base name is for one file or pair")
        if self.non_directional and not self.rrbs:
            wrong.append("non-directional libraries are for RRBS")
        if wrong:
            raise ValueError("; ".join(wrong))


def detect_adapter(reads: DataFrame, consider_already_trimmed: int | None = None) -> tuple[str, str]:
    """The candidate that most of the first reads contain; a tie of the two best gives the first candidate, too few give X."""
    head = reads.where(F.col("read_idx") < HEAD_READS)
    votes = adapter_votes(head).first()
    order = sorted(CANDIDATES, key=lambda c: -votes[c])  # stable: ties keep the candidates' order
    top, second = order[:2]
    if consider_already_trimmed is not None and votes[top] <= consider_already_trimmed:
        return "X", "already trimmed"
    if votes[top] == votes[second]:
        top = CANDIDATES[0]
    return PRESETS[top]


def adapter_votes(reads: DataFrame) -> DataFrame:
    """One row: in how many reads each candidate occurs.

    Detection looks for each preset's own sequence."""
    return reads.agg(*(F.count_if(F.contains("sequence", F.lit(PRESETS[c][0]))).alias(c) for c in CANDIDATES))


def adapters_for(reads: DataFrame, config: TrimConfig) -> tuple[str, str]:
    """The adapters of first and second reads."""
    if config.adapter:
        one = config.adapter.upper()
    elif config.preset:
        one = PRESETS[config.preset][0]
    else:
        one = detect_adapter(reads, config.consider_already_trimmed)[0]
    return one, config.adapter2.upper() if config.adapter2 else SECOND.get(one, one) if config.paired else one


def least_length(adapter: str, config: TrimConfig) -> int:
    """Small RNA is short: 18 instead of 20."""
    return 18 if adapter == PRESETS["small_rna"][0] and config.length == 20 else config.length


def clip_second(config: TrimConfig) -> int | None:
    """Directional paired RRBS cuts two bases of second reads, if nothing else is asked for."""
    return 2 if config.rrbs and config.paired and not config.non_directional and config.clip_r2 is None else config.clip_r2


def _trim(
    batches: Iterator[pa.RecordBatch], adapter: str, cutoff: int, base: int, two_colour: bool,
    error_rate: float, overlap: int
) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole):
            seq, size = kernels.flat(batch.column("sequence"))
            qual = kernels.fitted(kernels.flat(batch.column("quality"))[0], size)
            after_quality = kernels.quality_cut(qual, size, cutoff, base, seq if two_colour else None) if cutoff > 0 else size
            kept = kernels.adapter_cut(seq, after_quality, adapter, error_rate, overlap) if adapter and adapter != "X" else after_quality
            cut = {c: kernels.first_parts(batch.column(c), kept) for c in ("sequence", "quality")}
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | cut
            columns |= {"quality_trimmed": pa.array(size - after_quality), "adapter_trimmed": pa.array(after_quality - kept)}
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BASES bases, or one longer read."""
    sizes = pc.binary_length(batch.column("sequence")).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    for a, b in kernels.slices(sizes, BASES):
        yield batch.slice(a, b - a)


def trim_ends(reads: DataFrame, adapter: str, config: TrimConfig) -> DataFrame:
    """Quality, then adapter, then N trimming; adds quality_trimmed and adapter_trimmed (bases taken off)."""
    cutoff = config.nextseq if config.nextseq is not None else config.quality
    kernel = partial(
        _trim, adapter=adapter, cutoff=cutoff, base=64 if config.phred64 else 33,
        two_colour=config.nextseq is not None, error_rate=config.error_rate, overlap=config.stringency
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema.fields) + ", quality_trimmed long, adapter_trimmed long"
    out = reads.mapInArrow(kernel, schema)
    return trim_n(out) if config.trim_n else out


def trim_n(reads: DataFrame) -> DataFrame:
    """Ns off both ends, with their qualities."""
    front = F.length(F.regexp_extract("sequence", "^[Nn]*", 0))
    rest = F.length(F.regexp_replace("sequence", "[Nn]+$", ""))
    size = F.greatest(rest - front, F.lit(0))
    rows = reads.withColumn("_front", front).withColumn("_size", size)
    return rows.withColumn("quality", F.substring("quality", F.col("_front") + 1, F.col("_size"))).withColumn(
        "sequence", F.substring("sequence", F.col("_front") + 1, F.col("_size"))
    ).drop("_front", "_size")


def clip5(reads: DataFrame, n: int | None, rename: bool = False, prefix: str = "") -> DataFrame:
    """The first n bases off, if the read is longer; with ``rename`` they go into the id."""
    return _clip(reads, n, rename, prefix, True)


def clip3(reads: DataFrame, n: int | None, rename: bool = False, prefix: str = "") -> DataFrame:
    """The last n bases off, if the read is longer."""
    return _clip(reads, n, rename, prefix, False)


def _clip(reads: DataFrame, n: int | None, rename: bool, prefix: str, front: bool) -> DataFrame:
    if not n:
        return reads
    seq, qual, name = (F.col(prefix + c) for c in ("sequence", "quality", "id"))
    longer = F.length(seq) > n
    size = F.length(seq) - n
    cut = lambda x: F.when(longer, F.substring(x, F.lit(n + 1 if front else 1), size)).otherwise(x)
    off = F.substring(seq, F.lit(1), F.lit(n)) if front else F.substring(seq, size + 1, F.lit(n))
    mark = F.when(longer, F.concat(name, F.lit(":clip5:" if front else ":clip3:"), off)).otherwise(name) if rename else name
    return reads.withColumns({prefix + "id": mark, prefix + "quality": cut(qual), prefix + "sequence": cut(seq)})


def too_many_n(seq: Column, max_n: float | None) -> Column:
    """Below 1 a share of the read (an empty one passes), else a number."""
    if max_n is None:
        return F.lit(False)
    n = R.n_count(seq)
    return (F.length(seq) > 0) & (n / F.length(seq) > max_n) if 0 < max_n < 1 else n > int(max_n)


def classify_single(reads: DataFrame, config: TrimConfig, least: int) -> DataFrame:
    """Clips, and adds ``class``: too_many_n, too_short, too_long or kept, the first that holds."""
    rows = clip3(clip5(reads, config.clip_r1, config.rename), config.three_prime_clip_r1, config.rename)
    n = F.length("sequence")
    long = n > config.max_length if config.max_length is not None else F.lit(False)
    return rows.withColumn(
        "class",
        F.when(too_many_n(F.col("sequence"), config.max_n), "too_many_n").when(n < least, "too_short").when(long, "too_long").otherwise("kept")
    )


def trim_single(reads: DataFrame, config: TrimConfig, adapter: str | None = None) -> DataFrame:
    """Single-end trimming: every read with its class."""
    adapter = adapter or adapters_for(reads, config)[0]
    return classify_single(trim_ends(reads, adapter, config), config, least_length(adapter, config))


def pair_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of two files by their places; files of different lengths are an error."""
    cols = ("id", "sequence", "quality", "quality_trimmed", "adapter_trimmed")
    a = first.select("read_idx", F.lit(True).alias("_a"), *(F.col(c).alias(f"r1_{c}") for c in cols if c in first.columns))
    b = second.select("read_idx", F.lit(True).alias("_b"), *(F.col(c).alias(f"r2_{c}") for c in cols if c in second.columns))
    rows = a.join(b, "read_idx", "full_outer")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the two files have different numbers of reads"))).otherwise(F.col("r1_id"))
    return rows.withColumn("r1_id", whole).drop("_a", "_b")


def classify_pairs(pairs: DataFrame, config: TrimConfig, least: int) -> DataFrame:
    """Clips both reads and adds ``class`` (too_many_n, too_short, too_long or kept), and whether a read of a pair that is too
    short is kept alone: unpaired_1 and unpaired_2."""
    rows = clip5(pairs, config.clip_r1, config.rename, "r1_")
    rows = clip5(rows, clip_second(config), config.rename, "r2_")
    rows = clip3(rows, config.three_prime_clip_r1, config.rename, "r1_")
    rows = clip3(rows, config.three_prime_clip_r2, config.rename, "r2_")
    n1, n2 = F.length("r1_sequence"), F.length("r2_sequence")
    ns = too_many_n(F.col("r1_sequence"), config.max_n) | too_many_n(F.col("r2_sequence"), config.max_n)
    short = (n1 < least) | (n2 < least)
    long = (n1 > config.max_length) | (n2 > config.max_length) if config.max_length is not None else F.lit(False)
    rows = rows.withColumn("class", F.when(ns, "too_many_n").when(short, "too_short").when(long, "too_long").otherwise("kept"))
    alone = (F.col("class") == "too_short") & F.lit(config.retain_unpaired)
    return rows.withColumn("unpaired_1", alone & (n1 >= config.length_1)).withColumn("unpaired_2", alone & (n2 >= config.length_2))


def trim_pairs(first: DataFrame, second: DataFrame, config: TrimConfig, adapters: tuple[str, str] | None = None) -> DataFrame:
    """Paired-end trimming: both files on their own, then pairs with their class."""
    one, two = adapters or adapters_for(first, config)
    return classify_pairs(pair_up(trim_ends(first, one, config), trim_ends(second, two, config)), config, least_length(one, config))


def hard_trim(reads: DataFrame, n: int, end: int) -> DataFrame:
    """Only the first (end 5) or the last (end 3) n bases stay."""
    cut = (lambda x: F.substring(x, 1, n)) if end == 5 else (lambda x: F.when(F.length(x) > n, F.substring(x, -n, n)).otherwise(F.col(x)))
    return reads.withColumns({c: cut(c) for c in ("sequence", "quality")})


def single_counts(classified: DataFrame) -> dict[str, int]:
    """Reads in all and by class."""
    found = dict(classified.groupBy("class").count().collect())
    return {"total": sum(found.values())} | {k: found.get(k, 0) for k in ("too_many_n", "too_short", "too_long", "kept")}


def pair_counts(classified: DataFrame) -> dict[str, int]:
    """As single_counts(); pairs with too many Ns also count as removed for length, pairs that are too long don't."""
    out = single_counts(classified)
    alone = classified.agg(F.count_if("unpaired_1").alias("a"), F.count_if("unpaired_2").alias("b")).first()
    return out | {"removed_for_length": out["too_many_n"] + out["too_short"], "unpaired_1": alone["a"], "unpaired_2": alone["b"]}


def trimmed_counts(classified: DataFrame, prefix: str = "") -> tuple[int, int]:
    """Bases taken off for quality, and reads with an adapter."""
    found = classified.agg(F.coalesce(F.sum(f"{prefix}quality_trimmed"), F.lit(0)), F.count_if(F.col(f"{prefix}adapter_trimmed") > 0)).first()
    return found[0], found[1]


def percent(part: int, total: int, digits: int = 1) -> str:
    return f"{part / total * 100:.{digits}f}%" if total else "N/A"
