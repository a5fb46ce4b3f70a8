"""Settings of a quality-control run: limits, adapters, contaminants and options."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# The default limits (module, level, value).
DEFAULT_LIMITS = """
duplication ignore 0
kmer ignore 1
n_content ignore 0
overrepresented ignore 0
quality_base ignore 0
sequence ignore 0
gc_sequence ignore 0
quality_sequence ignore 0
tile ignore 0
sequence_length ignore 0
adapter ignore 0
duplication warn 70
duplication error 50
kmer warn 2
kmer error 5
n_content warn 5
n_content error 20
overrepresented warn 0.1
overrepresented error 1
quality_base_lower warn 10
quality_base_lower error 5
quality_base_median warn 25
quality_base_median error 20
sequence warn 10
sequence error 20
gc_sequence warn 15
gc_sequence error 30
quality_sequence warn 27
quality_sequence error 20
tile warn 5
tile error 10
sequence_length warn 1
sequence_length error 1
adapter warn 5
adapter error 10
"""
# What holds instead where a custom limits file leaves a key out.
WITHOUT_KEY = {("quality_sequence", "warn"): 20.0, ("quality_sequence", "error"): 27.0, ("kmer", "ignore"): 0.0}
# The default adapters, twelve bases each.
DEFAULT_ADAPTERS = [
    ("Illumina Universal Adapter", "AGATCGGAAGAG"),
    ("Illumina Small RNA 3' Adapter", "TGGAATTCTCGG"),
    ("Illumina Small RNA 5' Adapter", "GATCGTCGGACT"),
    ("Nextera Transposase Sequence", "CTGTCTCTTATA"),
    ("PolyA", "AAAAAAAAAAAA"),
    ("PolyG", "GGGGGGGGGGGG"),
]
LEVELS = ("ignore", "warn", "error")


def parse_limits(text: str) -> dict[tuple[str, str], float]:
    """Three fields a line; lines that aren't so are left out."""
    out = {}
    for line in text.splitlines():
        parts = line.split("#")[0].split() if line.lstrip().startswith("#") else line.split()
        if len(parts) == 3 and parts[1] in LEVELS:
            try:
                out[parts[0], parts[1]] = float(parts[2])
            except ValueError:
                continue
    return out


def parse_sequences(text: str) -> list[tuple[str, str]]:
    """Names and sequences: the first tab parts them, or else the last white space; '#' begins a comment line."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, tab, seq = line.partition("\t")
        if not tab:
            name, _, seq = line.rpartition(" ")
        if seq.strip():
            out.append((name.strip(), seq.strip().upper()))
    return out


@dataclass(frozen=True)
class QcConfig:
    """Options; files that can't be read raise an error."""

    format: str | None = None  # fastq, sam, sam_mapped, bam, bam_mapped
    adapters_file: str | None = None
    contaminants_file: str | None = None
    limits_file: str | None = None
    kmer_size: int = 7
    casava: bool = False
    nofilter: bool = False
    nogroup: bool = False
    expgroup: bool = False
    min_length: int = 0
    dup_length: int = 0
    unique_cap: int = 100_000
    compat: bool = True  # the four-worker sampling order of parallel FASTQ runs; False: one order
    dense: bool = True  # each read of a file has its place in read_idx; alignments leave out what isn't mapped
    tile_all: int = 10_000  # reads of a worker that all count for tiles, before each tenth does
    keep_reads: bool = True  # in memory and on disk while a whole report is made; False: scanned for each module
    limits: dict[tuple[str, str], float] = field(init=False, default_factory=dict, compare=False)
    adapters: list[tuple[str, str]] = field(init=False, default_factory=list, compare=False)
    contaminants: list[tuple[str, str]] = field(init=False, default_factory=list, compare=False)

    def __post_init__(self):
        if self.format not in (None, "fastq", "sam", "sam_mapped", "bam", "bam_mapped"):
            raise ValueError(f"unknown format {self.format}")
        if not 2 <= self.kmer_size <= 10:
            raise ValueError("k-mer size must be from 2 to 10")
        if self.nogroup and self.expgroup:
            raise ValueError("nogroup and expgroup exclude each other")
        limits = parse_limits(DEFAULT_LIMITS)
        if self.limits_file:
            limits |= WITHOUT_KEY | parse_limits(Path(self.limits_file).read_text())
        object.__setattr__(self, "limits", limits)
        object.__setattr__(self, "adapters", parse_sequences(Path(self.adapters_file).read_text()) if self.adapters_file else DEFAULT_ADAPTERS)
        listed = Path(self.contaminants_file) if self.contaminants_file else Path(__file__).parent / "data" / "contaminants.txt"
        object.__setattr__(self, "contaminants", parse_sequences(listed.read_text()))

    def limit(self, module: str, level: str) -> float:
        return self.limits.get((module, level), 0.0)
