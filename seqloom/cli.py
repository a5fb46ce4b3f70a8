"""Commands: ``python -m seqloom.cli qc FILE...`` and ``python -m seqloom.cli trim FILE...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from shutil import copyfileobj
from tempfile import mkdtemp

from pyspark.sql import SparkSession

from .config import QcConfig
from .plans.qc import analyse
from .report.writers import write_all
from .sources.alignments import detect_format, read_any
from .sources.fastq import records
from .trim.operators import PRESETS, TrimConfig, adapters_for
from .trim.runs import run as run_trim


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    qc = subs.add_parser("qc")
    qc.add_argument("files", nargs="+")
    qc.add_argument("-o", "--outdir", default=".")
    qc.add_argument("-f", "--format")
    for name in ("contaminants", "adapters", "limits"):
        qc.add_argument(f"-{name[0]}", f"--{name}", dest=f"{name}_file")
    qc.add_argument("-k", "--kmers", dest="kmer_size", type=int, default=7)
    qc.add_argument("--min-length", type=int, default=0)
    qc.add_argument("--dup-length", type=int, default=0)
    for name in ("casava", "nofilter", "nogroup", "expgroup", "extract", "delete", "json"):
        qc.add_argument(f"--{name}", action="store_true")
    qc.add_argument("-t", "--threads", type=int, help="of a local session")
    qc.add_argument("-q", "--quiet", action="store_true", help="print nothing but errors")
    trim = subs.add_parser("trim")
    trim.add_argument("files", nargs="+")
    trim.add_argument("-o", "--outdir", default=".")
    trim.add_argument("-q", "--quality", type=int, default=20)
    trim.add_argument("-a", "--adapter")
    trim.add_argument("--adapter2", "-a2")
    trim.add_argument("--preset", choices=[*PRESETS])
    trim.add_argument("-s", "--stringency", type=int, default=1)
    trim.add_argument("-e", "--error-rate", type=float, default=0.1)
    for name, kind in (
        ("length", int), ("max-length", int), ("max-n", float), ("clip-r1", int), ("clip-r2", int),
        ("three-prime-clip-r1", int), ("three-prime-clip-r2", int), ("length-1", int), ("length-2", int),
        ("nextseq", int), ("consider-already-trimmed", int), ("hardtrim5", int), ("hardtrim3", int),
        ("basename", str)
    ):
        trim.add_argument(f"--{name}", type=kind, default=getattr(TrimConfig, name.replace("-", "_")))
    for name in ("phred64", "trim-n", "rename", "paired", "retain-unpaired", "rrbs", "non-directional", "gzip", "dont-gzip", "no-report-file", "qc"):
        trim.add_argument(f"--{name}", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    a = vars(parser().parse_args(args))
    builder, threads, quiet = SparkSession.builder.appName("seqloom"), a.pop("threads", None), a.pop("quiet", False)
    spark = (builder.master(f"local[{threads}]") if threads else builder).getOrCreate()
    files, out = a.pop("files"), a.pop("outdir")
    if a.pop("command") == "trim":
        gzip = True if a.pop("gzip") else None
        gzip = False if a.pop("dont_gzip") else gzip
        report, qc = not a.pop("no_report_file"), QcConfig() if a.pop("qc") else None
        config = TrimConfig(files=tuple(files), **a)
        step = 2 if config.paired else 1
        hard = config.hardtrim5 or config.hardtrim3
        adapters = None if hard else adapters_for(records(spark, files[0], lenient=True), config)  # the first file tells for all
        for i in range(0, len(files), step):
            print(*run_trim(spark, files[i : i + step], out, config, gzip, adapters, report, qc), sep="\n")
        return 0
    extract, delete, as_json = a.pop("extract"), a.pop("delete"), a.pop("json")
    config = QcConfig(**a)
    failed = 0
    for path in files:  # a file that fails doesn't keep the others from being analysed
        try:
            if path == "stdin":  # what comes in goes to a file first: it is read several times
                path = f"{mkdtemp(prefix='seqloom-')}/stdin"
                with open(path, "wb") as f:
                    copyfileobj(sys.stdin.buffer, f)
            reads, kind = read_any(spark, path, config)
            for report in analyse(reads, config, kind):
                report.source_path = path
                made = write_all(report, out, extract=extract, delete_zip=delete, as_json=as_json)
                if not quiet:
                    print(*made, sep="\n")
        except Exception as e:
            print(f"{Path(path).name} ({detect_format(path, config.format)}): {e}", file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main())
