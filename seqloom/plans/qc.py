"""A quality-control run: all modules over all files in one set of jobs, then verdicts from small results."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.kernels import base_groups, bases_text, histogram_width, label
from ..operators import basic, fused, positions, sequences
from ..operators.common import position_cube

# The modules in the order of reports: id, name, key of their limits, description.
MODULES = [
    ("basic_statistics", "Basic Statistics", None, "Calculates some basic statistics about the file"),
    ("per_base_sequence_quality", "Per base sequence quality", "quality_base", "Shows the Quality scores of all bases at a given position in a sequencing run"),
    (
        "per_tile_sequence_quality", "Per tile sequence quality", "tile",
        "Shows the per tile Quality scores of all bases at a given position in a sequencing run"
    ),
    ("per_sequence_quality_scores", "Per sequence quality scores", "quality_sequence", "Shows the distribution of mean quality scores across all sequences"),
    ("per_base_sequence_content", "Per base sequence content", "sequence", "Shows the proportion of each base at each position in a sequence"),
    ("per_sequence_gc_content", "Per sequence GC content", "gc_sequence", "Shows the distribution of GC contents for whole sequences"),
    ("per_base_n_content", "Per base N content", "n_content", "Shows the percentage of N bases at each position"),
    ("sequence_length_distribution", "Sequence Length Distribution", "sequence_length", "Shows the distribution of sequence lengths"),
    ("sequence_duplication_levels", "Sequence Duplication Levels", "duplication", "Plots the number of sequences which are duplicated to different levels"),
    ("overrepresented_sequences", "Overrepresented sequences", "overrepresented", "Identifies sequences which are overrepresented in the set"),
    ("adapter_content", "Adapter Content", "adapter", "Searches for specific adapter sequences in a library"),
    ("kmer_content", "Kmer Content", "kmer", "Identifies short sequences which have uneven representation"),
]

TOGETHER = 8  # modules whose jobs run at the same time


@dataclass
class Module:
    id: str
    name: str
    description: str
    status: str  # pass, warn, fail or not_applicable
    data: dict
    header: str = ""
    rows: list[tuple] = field(default_factory=list)
    reported: bool = True
    thresholds: dict | None = None


@dataclass
class FileReport:
    file_name: str
    source_path: str
    format: str
    modules: list[Module]

    def overall(self) -> str:
        found = {m.status for m in self.modules}
        return "fail" if "fail" in found else "warn" if "warn" in found else "pass"


def clean(v: float) -> float:
    return 0.0 if v is None or math.isnan(v) or math.isinf(v) else v


def _verdict(fails: bool, warns: bool) -> str:
    return "fail" if fails else "warn" if warns else "pass"


def frames_of(reads: DataFrame, config: QcConfig) -> tuple[dict[str, Callable[[], DataFrame]], list]:
    """What makes every module's rows, and what to let go of afterwards.  One pass over the reads counts for all modules; where that can't be
    (places that aren't dense, very many filtered reads) each module asks the reads itself."""
    kmers = config.limit("kmer", "ignore") <= 0
    gone = fused.skips(reads) if config.dense else None
    if gone is None:
        if config.keep_reads:
            reads = reads.persist(StorageLevel.MEMORY_AND_DISK)
        cube = position_cube(reads).persist(StorageLevel.MEMORY_AND_DISK)
        keys = sequences.key_counts(reads, config).persist(StorageLevel.MEMORY_AND_DISK)
        held = [keys, cube, *([reads] if config.keep_reads else [])]
        per = means = sums = gc = lengths = hits = placed = None
    else:
        one = fused.Fused(reads, config, gone, tuple(k for k in fused.EVERY if kmers or k != "kmer"))
        cube, per, means, gc, lengths = one.cube(), one.basic(), one.means(), one.gc(), one.lengths()
        keys = one.keys().persist(StorageLevel.MEMORY_AND_DISK)
        # a worker's longest read so far counts where adapters have several lengths
        several = config.compat and len({len(s) for _, s in config.adapters}) > 1
        sums, hits, placed = one.tiles(), None if several else one.adapters(), one.kmers() if kmers else None
        held = [keys, *one.held]
    by_file = keys.groupBy("file_name")
    frames = {
        "basic": lambda: basic.basic_statistics(reads, config.compat, per),
        "lowest": lambda: cube.where("code > 0").groupBy("file_name").agg(F.min("code").alias("lowest")),
        "quality_base": lambda: positions.base_quality(reads, config, cube).orderBy("grp"),
        "tile": lambda: positions.tile_quality(reads, config, sums).orderBy("tile", "grp"),
        "quality_sequence": lambda: basic.sequence_quality(reads, means).orderBy("quality"),
        "sequence": lambda: positions.base_content(reads, config, cube).orderBy("grp"),
        "gc_sequence": lambda: basic.gc_fitted(basic.gc_distribution(reads, gc)).orderBy("pct"),
        "n_content": lambda: positions.n_content(reads, config, cube).orderBy("grp"),
        "sequence_length": lambda: basic.length_distribution(reads, lengths).orderBy("lo"),
        "duplication": lambda: sequences.duplication(reads, config, keys).orderBy("slot"),
        "unique": lambda: by_file.agg(F.count("*").alias("unique"), F.max(F.when(F.col("rank") == config.unique_cap, F.col("first"))).alias("limit")),
        "overrepresented": lambda: sequences.overrepresented(reads, config, keys),
        "adapter": lambda: sequences.adapter_content(reads, config, hits).orderBy("adapter", "grp"),
    }
    if kmers:
        rows = sequences.kmer_enrichment(reads, config, placed).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(rows)
        content = sequences.kmer_content(reads, config, rows)
        frames["kmer"] = lambda: content
        frames["kmer_series"] = lambda: sequences.kmer_series(rows, content)
        frames["kmer_groups"] = lambda: rows.select("file_name", "grp", "label").distinct().orderBy("grp")
    return frames, held


def collect(reads: DataFrame, config: QcConfig) -> dict[str, dict[str, list]]:
    """Every module's rows by file: a few thousand for each file.  Modules that a report leaves out aren't computed."""
    frames, held = frames_of(reads, config)
    out: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    with ThreadPoolExecutor(TOGETHER) as pool:  # small jobs fill each other's gaps
        for name, found in zip(frames, pool.map(lambda make: make().collect(), frames.values()), strict=True):
            for r in found:
                out[r["file_name"]][name].append(r)
    for df in held:
        df.unpersist()
    return out


def report_for(file_name: str, found: dict[str, list], config: QcConfig, source_path: str = "", kind: str = "fastq") -> FileReport:
    """Verdicts and tables of one file."""
    lim = config.limit
    modules = {key: (mid, name, text) for mid, name, key, text in MODULES}
    out: list[Module] = []

    def add(key, status, data, header, rows, thresholds=None, reported=True):
        mid, name, text = modules[key]
        if key and lim(key, "ignore") > 0:
            status, reported = "not_applicable", False
        out.append(Module(mid, name, text, status if reported else "not_applicable", data, header, rows, reported, thresholds))

    def both(key: str) -> dict:
        return {"warn": lim(key, "warn"), "error": lim(key, "error")}

    b = found["basic"][0]
    span = str(b.min_length) if b.min_length == b.max_length else f"{b.min_length}-{b.max_length}"
    data = {
        "file_name": file_name,
        "file_type": b.file_type,
        "encoding": b.encoding,
        "total_sequences": b.total_sequences,
        "filtered_sequences": b.filtered_sequences,
        "total_bases": b.total_bases,
        "total_bases_human": bases_text(b.total_bases),
        "sequence_length": {"min": b.min_length, "max": b.max_length, "display": span},
        "gc_percent": b.gc_exact,
    }
    rows = [
        ("Filename", file_name), ("File type", b.file_type), ("Encoding", b.encoding),
        ("Total Sequences", b.total_sequences), ("Total Bases", bases_text(b.total_bases)),
        ("Sequences flagged as poor quality", b.filtered_sequences), ("Sequence length", span),
        ("%GC", b.gc_percent)
    ]
    add(None, "pass", data, "#Measure\tValue", rows)

    q = found["quality_base"]
    low = any(r.lower < lim("quality_base_lower", "error") or r.median < lim("quality_base_median", "error") for r in q)
    near = any(r.lower < lim("quality_base_lower", "warn") or r.median < lim("quality_base_median", "warn") for r in q)
    names = ("mean", "median", "lower", "upper", "p10", "p90")
    long = ("mean", "median", "lower_quartile", "upper_quartile", "percentile_10", "percentile_90")
    marks = {f"{lv}_{part}": lim(f"quality_base_{part}", lv) for lv in ("warn", "error") for part in ("lower", "median")}
    add(
        "quality_base", _verdict(low, near),
        {"encoding": b.encoding, "position_groups": [{"label": r.label} | {k: clean(r[n]) for k, n in zip(long, names, strict=True)} for r in q]},
        "#Base\tMean\tMedian\tLower Quartile\tUpper Quartile\t10th Percentile\t90th Percentile",
        [(r.label, *(float(r[n]) for n in names)) for r in q], marks, bool(q)
    )

    t = found["tile"]
    worst = max((abs(r.mean_deviation) for r in t), default=0.0)
    tiles: dict[int, list] = defaultdict(list)
    for r in t:
        tiles[r.tile].append(r)
    labels = [r.label for r in next(iter(tiles.values()), [])]
    add(
        "tile", _verdict(worst > lim("tile", "error"), worst > lim("tile", "warn")),
        {
            "max_deviation": worst, "position_groups": labels,
            "tiles": [{"tile": k, "mean_deviation": [r.mean_deviation for r in v]} for k, v in tiles.items()]
        },
        "#Tile\tBase\tMean", [(r.tile, r.label, float(r.mean_deviation)) for r in t], both("tile"), bool(t)
    )

    s = found["quality_sequence"]
    mode = min(s, key=lambda r: (-r.n, r.quality)).quality if s else 0
    add(
        "quality_sequence",
        _verdict(bool(s) and mode < int(lim("quality_sequence", "error")), bool(s) and mode < int(lim("quality_sequence", "warn"))),
        {"encoding": b.encoding, "most_frequent_score": mode, "distribution": [{"quality": r.quality, "count": r.n} for r in s]},
        "#Quality\tCount", [(r.quality, float(r.n)) for r in s], both("quality_sequence"), bool(s)
    )

    c = found["sequence"]
    apart = max((max(abs(r.g - r.c), abs(r.a - r.t)) for r in c), default=0.0)
    add(
        "sequence", _verdict(apart > lim("sequence", "error"), apart > lim("sequence", "warn")),
        {"position_groups": [{"label": r.label, "g_pct": r.g, "a_pct": r.a, "t_pct": r.t, "c_pct": r.c} for r in c]},
        "#Base\tG\tA\tT\tC", [(r.label, r.g, r.a, r.t, r.c) for r in c], both("sequence")
    )

    g = found["gc_sequence"]
    off = g[0].deviation if g else 0.0
    add(
        "gc_sequence", _verdict(off > lim("gc_sequence", "error"), off > lim("gc_sequence", "warn")),
        {
            "deviation_percent": clean(off),
            "distribution": [{"gc_percent": r.pct, "observed_count": r["count"], "theoretical_count": clean(r.theoretical)} for r in g]
        },
        "#GC Content\tCount", [(r.pct, float(r["count"])) for r in g], both("gc_sequence")
    )

    n = found["n_content"]
    most = max((r.n_percent for r in n), default=0.0)
    add(
        "n_content", _verdict(most > lim("n_content", "error"), most > lim("n_content", "warn")),
        {"position_groups": [{"label": r.label, "n_pct": r.n_percent} for r in n]}, "#Base\tN-Count",
        [(r.label, float(r.n_percent)) for r in n], both("n_content")
    )

    lens = found["sequence_length"]
    least, top = (lens[0].lo, lens[-1].hi) if lens else (0, 0)
    empty = bool(lens) and lens[0].lo == 0 and lens[0].n > 0
    add(
        "sequence_length", _verdict(empty, least != top),
        {
            "min_observed_length": least, "max_observed_length": top,
            "interval": histogram_width(top - least + 1),
            "distribution": [{"label": r.label, "count": r.n} for r in lens]
        },
        "#Length\tCount", [(r.label, float(r.n)) for r in lens] or [("0", 0.0)]
    )

    d = found["duplication"]
    kept = d[0].deduplicated if d else 100.0
    shown = [(r.label + "+" if r.slot == 15 else r.label, r.percent) for r in d]
    add(
        "duplication", _verdict(kept < lim("duplication", "error"), kept < lim("duplication", "warn")),
        {"deduplicated_percentage": kept, "distribution": [{"label": a, "percentage_of_total": p} for a, p in shown]},
        f"#Total Deduplicated Percentage\t{kept!r}\n#Duplication Level\tPercentage of total", shown,
        both("duplication")
    )

    o = found["overrepresented"]
    u = found["unique"][0] if found["unique"] else None
    frozen = bool(u and u.limit is not None)
    add(
        "overrepresented", _verdict(bool(o) and o[0].percent > lim("overrepresented", "error"), bool(o)),
        {
            "total_sequences_considered": b.total_sequences, "unique_sequence_count": u.unique if u else 0,
            "sampling_frozen": frozen, "count_at_unique_limit": u.limit if frozen else b.total_sequences,
            "records": [{"sequence": r.sequence, "count": r.n, "percentage": r.percent, "possible_source": r.source} for r in o]
        },
        "#Sequence\tCount\tPercentage\tPossible Source" if o else "",
        [(r.sequence, r.n, float(r.percent), r.source) for r in o], both("overrepresented")
    )

    a = found["adapter"]
    longest = max((len(x) for _, x in config.adapters), default=0)
    longest_read = b.max_length if b.max_length > longest else 0
    series = [[r for r in a if r.adapter == i] for i in range(len(config.adapters))]
    groups = [r.label for r in series[0]] if series and series[0] else [label(*x) for x in base_groups(1)]
    top_share = max((r.percent for r in a), default=0.0)
    add(
        "adapter",
        _verdict(top_share > lim("adapter", "error"), longest > longest_read or top_share > lim("adapter", "warn")),
        {
            "total_sequences_considered": b.total_sequences, "max_read_length": longest_read,
            "max_adapter_length": longest, "read_length_too_short": longest > longest_read,
            "position_groups": groups,
            "series": [
                {"adapter_name": nm, "adapter_sequence": sq, "values": [r.percent for r in rs]} for (nm, sq),
                rs in zip(config.adapters, series, strict=True)
            ]
        },
        "\t".join(["#Position", *(nm for nm, _ in config.adapters)]),
        [(lb, *(rs[i].percent if i < len(rs) else 0.0 for rs in series)) for i, lb in enumerate(groups)],
        both("adapter")
    )

    k = found["kmer"]
    course = {(r.kmer, r.grp): r.ratio for r in found["kmer_series"]}
    drawn = list(dict.fromkeys(r.kmer for r in found["kmer_series"]))
    series = [{"sequence": x, "obs_exp": [clean(course.get((x, r.grp), 0.0)) for r in found["kmer_groups"]]} for x in drawn]
    strength = -math.log10(k[0].p_value) if k and k[0].p_value > 0 else 0.0
    add(
        "kmer", _verdict(strength > lim("kmer", "error"), strength > lim("kmer", "warn")),
        {
            "kmer_size": config.kmer_size, "sampled_every_n_reads": sequences.KMER_EVERY,
            "estimated_count_multiplier": sequences.KMER_EVERY,
            "position_groups": [r.label for r in found["kmer_groups"]], "plot_series": series,
            "records": [
                {
                    "sequence": r.kmer, "estimated_count": r["count"], "p_value": clean(r.p_value),
                    "obs_exp_max": clean(r.ratio), "max_obs_exp_position": r.label
                } for r in k
            ]
        },
        "#Sequence\tCount\tPValue\tObs/Exp Max\tMax Obs/Exp Position" if k else "",
        [(r.kmer, r["count"], r.p_value, r.ratio, r.label) for r in k], both("kmer")
    )
    return FileReport(file_name, source_path or file_name, kind, out)


def analyse(reads: DataFrame, config: QcConfig | None = None, kind: str = "fastq") -> list[FileReport]:
    """Reports of all files of ``reads``.  Sampling in batches holds for FASTQ only."""
    config = config or QcConfig()
    if kind != "fastq":
        config = copy(config)
        for name in ("compat", "dense"):
            object.__setattr__(config, name, False)
    # files are told apart by their paths, and shown by their names
    return [
        report_for(path.rsplit("/", 1)[-1], found, config, source_path=path, kind=kind) for path,
        found in sorted(collect(reads, config).items()) if found["basic"]
    ]
