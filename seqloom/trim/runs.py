"""Whole trimming runs: files in, files and a report out."""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QcConfig
from ..operators.common import with_ordinal
from ..plans.qc import analyse
from ..report.writers import write_all
from ..sources.fastq import records, write_fastq
from ..sources.onefile import write_as_one
from . import operators as O


def stem(path: str) -> str:
    """A file's name without the endings of reads and of compression."""
    name = Path(path).name
    for ending in (".gz", ".bz2"):
        name = name.removesuffix(ending)
    for ending in (".fastq", ".fq"):
        name = name.removesuffix(ending)
    return name


def output_names(files: tuple[str, ...], config: O.TrimConfig, gzip: bool) -> dict[str, str]:
    """The names of a run's outputs by role."""
    end = ".fq.gz" if gzip else ".fq"
    if config.hardtrim5 or config.hardtrim3:
        n, side = (config.hardtrim5, "5prime") if config.hardtrim5 else (config.hardtrim3, "3prime")
        return {"hard": f"{stem(files[0])}.{n}bp_{side}{end}"}
    if not config.paired:
        return {"kept": f"{config.basename or stem(files[0])}_trimmed{end}"}
    return {
        f"{role}_{i + 1}": f"{config.basename or stem(f)}_{word}_{i + 1}{end}" for i,
        f in enumerate(files) for role, word in (("kept", "val"), ("unpaired", "unpaired"))
    }


def _reads(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, lenient=True)


def report_text(name: str, config: O.TrimConfig, adapter: str, counts: dict[str, int], quality_bases: int, adapter_reads: int, least: int) -> str:
    """The trimming report of a file or pair."""
    total, digits = counts["total"], 2 if config.paired else 1
    lines = [
        "SUMMARISING RUN PARAMETERS",
        "==========================",
        f"Input filename: {name}",
        f"Trimming mode: {'paired-end' if config.paired else 'single-end'}",
        f"Quality Phred score cutoff: {config.nextseq if config.nextseq is not None else config.quality}",
        f"Quality encoding type selected: ASCII+{64 if config.phred64 else 33}",
        f"Adapter sequence: '{adapter}'",
        f"Maximum trimming error rate: {config.error_rate}",
        f"Minimum required adapter overlap (stringency): {config.stringency} bp",
        f"Minimum required sequence length: {least} bp",
        "",
        f"Total number of sequences analysed: {total}",
        f"Bases trimmed for quality: {quality_bases}",
        f"Sequences with adapters: {adapter_reads} ({O.percent(adapter_reads, total, digits)})",
    ]
    if config.max_n is not None:
        lines.append(f"Sequences removed for too many Ns: {counts['too_many_n']} ({O.percent(counts['too_many_n'], total, digits)})")
    short = counts.get("removed_for_length", counts["too_short"])
    lines.append(f"Sequences removed because they were shorter than {least} bp: {short} ({O.percent(short, total, digits)})")
    if config.max_length is not None:
        lines.append(
            f"Sequences removed because they were longer than {config.max_length} bp: {counts['too_long']} ({O.percent(counts['too_long'], total, digits)})"
        )
    return "\n".join(lines) + "\n"


def qc_reads(kept: DataFrame, name: str) -> DataFrame:
    """Trimmed reads as those of a file: each has its place among them."""
    own = kept.select(
        F.lit(name).alias("file_name"), "read_idx", F.regexp_replace("id", "^@", "").alias("id"), "sequence",
        "quality", F.lit(None).cast("string").alias("colorspace"), F.lit(False).alias("is_filtered")
    )
    return with_ordinal(own, "place", False, dense=False).withColumn("read_idx", F.col("place") - 1).drop("place")


def run(
    spark: SparkSession, files: list[str], out: str, config: O.TrimConfig, gzip: bool | None = None,
    adapters: tuple[str, str] | None = None, report: bool = True, qc: QcConfig | None = None
) -> list[str]:
    """Trim a file or a pair into ``out``; each output is one file in the reads' order (a folder of parts
    where the store has no places in files, see sources/onefile.py).  Returns their paths.

    ``adapters``: those of first and second reads, where they are known (of several files the first one tells them for all).
    A report is written for each file, unless ``report`` is false; with ``qc`` the outputs' quality reports, too."""
    gzip = files[0].endswith(".gz") if gzip is None else gzip
    names = {k: f"{out}/{v}" for k, v in output_names(tuple(files), config, gzip).items()}
    if "hard" in names:
        hard = O.hard_trim(_reads(spark, files[0]), config.hardtrim5 or config.hardtrim3, 5 if config.hardtrim5 else 3)
        return [write_as_one(spark, lambda folder: write_fastq(hard, folder, gzip), names["hard"])]
    first = _reads(spark, files[0])
    adapters = adapters or O.adapters_for(first, config)
    if config.paired:
        rows = O.trim_pairs(first, _reads(spark, files[1]), config, adapters).persist(StorageLevel.MEMORY_AND_DISK)
        counts, trimmed = O.pair_counts(rows), [O.trimmed_counts(rows, f"r{i}_") for i in (1, 2)]
        side = lambda i: ["read_idx", *(F.col(f"r{i}_{c}").alias(c) for c in ("id", "sequence", "quality"))]
        made = {}
        for i in (1, 2):
            made[names[f"kept_{i}"]] = rows.where("class = 'kept'").select(*side(i))
            if config.retain_unpaired:
                made[names[f"unpaired_{i}"]] = rows.where(f"unpaired_{i}").select(*side(i))
    else:
        rows = O.trim_single(first, config, adapters[0]).persist(StorageLevel.MEMORY_AND_DISK)
        counts, trimmed = O.single_counts(rows), [O.trimmed_counts(rows)]
        made = {names["kept"]: rows.where("class = 'kept'")}
    paths = []
    for path, kept in made.items():
        paths.append(write_as_one(spark, lambda folder, kept=kept: write_fastq(kept, folder, gzip), path))
    for file, adapter, (bases, reads) in zip(files, adapters, trimmed, strict=False) if report else ():
        text = report_text(Path(file).name, config, adapter, counts, bases, reads, O.least_length(adapters[0], config))
        row = spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1)
        paths.append(write_as_one(spark, lambda folder, row=row: row.write.mode("overwrite").text(folder), f"{out}/{Path(file).name}_trimming_report.txt"))
    if qc is not None:
        for path, kept in made.items():
            for found in analyse(qc_reads(kept, path), qc):
                paths += write_all(found, out.removeprefix("file://"))
    rows.unpersist()
    return paths
