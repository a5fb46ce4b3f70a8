"""Queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no reads, so reads are derived from events (and long ones from documents) by expressions that Spark and DuckDB
compute alike.  Fractions are rounded by floor(x * 1e6 + 0.5) / 1e6 where sums run over rows in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import QcConfig
from .functions import reads as R
from .functions.kernels import widths
from .operators import basic, fused, positions, sequences
from .operators.common import position_cube, spread, with_ordinal
from .plans.qc import analyse
from .sources.alignments import to_reads
from .trim import operators as T

#: Runs unchanged in both engines.
READS_SQL = """
select 'events.fastq' as file_name, read_idx, id, sequence, quality, cast(null as varchar(1)) as colorspace, contains(id, ':Y:') as is_filtered from (
select event_id as read_idx,
  concat('SIM:1:FC1:1:', cast(1101 + user_id % 4 as varchar(20)), ':', cast(event_id as varchar(20)), ':', cast(user_id as varchar(20)),
         case when event_id % 17 = 0 then ' 1:Y:18:ATCACG' else ' 1:N:18:ATCACG' end) as id,
  substring(translate(concat(md5(cast(event_id % 4000 as varchar(20))), md5(concat('b', cast(event_id % 4000 as varchar(20))))),
            '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, cast(36 + event_id % 4000 % 15 as int)) as sequence,
  substring(translate(concat(md5(concat('q', cast(event_id as varchar(20)))), md5(concat('r', cast(event_id as varchar(20))))),
            '0123456789abcdef', 'IIIIHHGGFFEDB=5#'), 1, cast(36 + event_id % 4000 % 15 as int)) as quality
from events) derived
"""
#: The same, but most sequences are their reads' own: the number of different ones grows with the table.
VARIED_SQL = READS_SQL.replace("event_id % 4000", "(case when event_id % 5 = 0 then event_id % 400 else event_id end)")
#: The same with an adapter in each tenth read.
SPLICED_SQL = f"""
select file_name, read_idx, id,
  case when read_idx % 10 = 0 then substring(concat(substring(sequence, 1, cast(4 + read_idx % 30 as int)), 'AGATCGGAAGAGC', substring(sequence, 1, 30)), 1, cast(length(sequence) as int)) else sequence end as sequence,
  quality, colorspace, is_filtered from ({READS_SQL}) r
"""
#: Twenty reads of each event, so that there are more different ones than are counted from the first on at sf0.01, too.
MANY_SQL = """
select 'events.fastq' as file_name, read_idx, 'r' as id,
  substring(translate(concat(md5(cast(v as varchar(20))), md5(concat('b', cast(v as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, cast(36 + v % 15 as int)) as sequence,
  repeat('I', cast(36 + v % 15 as int)) as quality, cast(null as varchar(1)) as colorspace, read_idx % 17 = 0 as is_filtered
from (select read_idx, case when read_idx % 5 = 0 then read_idx % 4000 when read_idx % 7 = 0 then read_idx % 30000 else read_idx end as v
  from (select event_id * 20 + c as read_idx from (select event_id, %s as c from events) e) i) d
"""
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 6 + "AN") * 2
LONG_SQL = f"""
select 'documents.fastq' as file_name, doc_id as read_idx, cast(doc_id as varchar(20)) as id,
  regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGTN]', 'N'%s) as sequence from documents where length(text) > 0
"""
SIX = "floor(({}) * 1e6 + 0.5) / 1e6"


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    columns = ["event_id", "user_id"] if table == "events" else ["doc_id", "text"]
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, READS_SQL, "events")


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, VARIED_SQL, "events")


def spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SPLICED_SQL, "events")


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MANY_SQL.replace("%s", "explode(sequence(0, 19))"), "events")


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, LONG_SQL % "", "documents")
    return rows.withColumn(
        "quality", F.repeat(F.lit("I"), F.length("sequence"))
    ).withColumn("colorspace", F.lit(None).cast("string")).withColumn("is_filtered", F.lit(False))


def six(c: Column | str) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c), c).otherwise(F.floor(c * 1e6 + 0.5) / 1e6)  # floor() makes a NaN 0


CFG = QcConfig()
LOOSE = QcConfig()
LOOSE.limits["overrepresented", "warn"] = 0.02
#: A part of the sequence of read 5, and others.
CONTAMINANTS = [("Adapter A", "AGATCGGAAGAGC"), ("Read five", "GACGTTTNTTAGGTACCTTTGTAGTAGT"), ("Long one", "ACGTACGTTGCAACGTACGTTTGACA")]
LOOSE.contaminants[:] = CONTAMINANTS


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- queries -----------------------------------------------------------------------------------------------------------


def basic_stats(s, d):
    return basic.basic_statistics(reads(s, d)).select(
        "file_name", "file_type", "encoding",
        *long("total_sequences", "filtered_sequences", "total_bases", "min_length", "max_length", "gc_percent"),
        six("gc_exact").alias("gc_exact")
    )


def per_base_quality(s, d):
    return positions.base_quality(reads(s, d), CFG).select("label", *(six(c).alias(c) for c in ("mean", "median", "lower", "upper", "p10", "p90")))


def per_base_percentiles(s, d):
    return positions.position_quality(position_cube(reads(s, d))).select(*long("pos", "total"), *(F.col(c) for c in ("p50", "p25", "p75", "p10", "p90")))


def per_tile_quality(s, d):
    return positions.tile_quality(reads(s, d), CFG).select(*long("tile"), "label", six("mean_deviation").alias("mean_deviation"))


def per_sequence_quality(s, d):
    return basic.sequence_quality(reads(s, d)).select(*long("quality", "n"))


def quality_mode(s, d):
    return basic.quality_mode(basic.sequence_quality(reads(s, d))).select(*long("mode"))


def per_base_content(s, d):
    return positions.base_content(reads(s, d), CFG).select("label", *(six(c).alias(f"{c}_percent") for c in "gatc"))


def per_base_content_grouped(s, d):
    return positions.base_content(long_reads(s, d), CFG).select("label", *(six(c).alias(f"{c}_percent") for c in "gatc"))


def n_content(s, d):
    return positions.n_content(reads(s, d), CFG).select("label", six("n_percent").alias("n_percent"))


def gc_counts(s, d):
    return basic.gc_counts(long_reads(s, d)).select(*long("len", "gc", "n"))


def gc_distribution(s, d):
    return basic.gc_distribution(reads(s, d)).select(*long("pct"), six("count").alias("observed"))


def gc_deviation(s, d):
    return basic.gc_fitted(basic.gc_distribution(reads(s, d))).select(six("deviation").alias("deviation")).distinct()


def length_distribution(s, d):
    return basic.length_distribution(reads(s, d)).select("label", *long("n"))


def length_distribution_wide(s, d):
    return basic.length_distribution(long_reads(s, d)).select("label", *long("n"))


def duplication_levels(s, d):
    return sequences.duplication(varied(s, d), CFG).select("label", six("percent").alias("percent"), six("deduplicated").alias("deduplicated"))


def duplication_beyond_cap(s, d):
    """More keys than are counted: those behind the cap don't count, and rare levels are corrected for it."""
    reads_ = many(s, d)
    return sequences.duplication(reads_, CFG, sequences.early_key_counts(reads_, CFG)).select(
        "label", six("percent").alias("percent"), six("deduplicated").alias("deduplicated")
    )


def first_distinct_keys(s, d):
    return sequences.key_counts(varied(s, d), CFG).select("key", *long("n", "first", "rank"))


def overrepresented(s, d):
    return sequences.overrepresented(varied(s, d), LOOSE).select("sequence", *long("n"), six("percent").alias("percent"), "source")


TWO = [CONTAMINANTS[0], CONTAMINANTS[2]]


def contaminants(s, d):
    return spliced(s, d).where("NOT is_filtered").select("read_idx", sequences.possible_source(F.col("sequence"), TWO).alias("source"))


def adapter_content(s, d):
    return sequences.adapter_content(spliced(s, d), CFG).select("name", "label", six("percent").alias("percent"))


def kmer_counts(s, d):
    return sequences.kmer_counts(reads(s, d), CFG).select("kmer", *long("pos", "n"))


def kmer_enrichment(s, d):
    rows = sequences.kmer_enrichment(spliced(s, d), CFG)
    return rows.select("kmer", "label", *long("count", "hits"), six(F.col("ratio").cast("double")).alias("ratio"))


def kmer_content(s, d):
    rows = sequences.kmer_content(spliced(s, d), CFG)
    return rows.select(
        *long("rank"), "kmer", *long("count"), six(F.col("p_value").cast("double")).alias("p_value"),
        six(F.col("ratio").cast("double")).alias("ratio"), "label"
    )


def kmer_pvalue(s, d):
    """Of as many hits as reads have letters beyond 35, at a share of 0.002."""
    rows = reads(s, d).select((F.length("sequence") - 35).cast("double").alias("k")).distinct()
    return rows.select("k", six(sequences.kmer_p_value(F.lit(5000.0), F.lit(0.002), F.col("k"), 2)).alias("p"))


def sampled_reads(s, d):
    rows = with_ordinal(reads(s, d), "ordinal", True)
    return rows.where("ordinal % 50 = 0").select(*long("read_idx", "ordinal"))


def casava_filter(s, d):
    return reads(s, d).select(R.is_casava_filtered(F.col("id")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def read_functions(s, d):
    seq = F.col("sequence")
    return reads(s, d).select(
        "read_idx", R.reverse_complement("sequence").alias("turned"), R.duplicate_key(seq, 30).alias("key"),
        *(
            c.cast("long").alias(n) for n,
            c in (
                ("gc", R.gc_count(seq)), ("ns", R.n_count(seq)), ("mean_code", R.mean_code(F.col("quality"))),
                ("tile", R.tile(F.col("id"), R.tile_field(F.col("id"))))
            )
        )
    )


def _aligned(s, d):
    rows = reads(s, d).withColumn("flag", F.when(F.col("read_idx") % 3 == 0, 16).when(F.col("read_idx") % 7 == 0, 4).otherwise(0))
    n = F.length("sequence")
    return rows.withColumn(
        "cigar",
        F.when(
            F.col("read_idx") % 5 == 0, F.concat(F.lit("5S"), n - 5, F.lit("M"))
        ).when(F.col("read_idx") % 5 == 1, F.concat(n - 3, F.lit("M3S"))).otherwise(F.concat(n, F.lit("M")))
    ).withColumn("path", F.col("file_name"))


def revcomp_softclip(s, d):
    return to_reads(_aligned(s, d), True).select("read_idx", "sequence", "quality")


def colorspace_decode(s, d):
    rows = reads(s, d).select("read_idx", F.concat(F.lit("T"), F.translate("sequence", "ACGTN", "0123.")).alias("colours"))
    return rows.where(R.is_colorspace(F.col("colours"))).select("read_idx", R.colorspace_to_bases(F.col("colours")).alias("bases"))


def trim_hard5(s, d):
    return T.hard_trim(reads(s, d), 20, 5).select("read_idx", "sequence", "quality")


def trim_hard3(s, d):
    return T.hard_trim(reads(s, d), 20, 3).select("read_idx", "sequence", "quality")


CLIP = T.TrimConfig(clip_r1=3, three_prime_clip_r1=5, rename=True, max_n=3, max_length=41, length=30)


def trim_clip(s, d):
    return T.clip3(T.clip5(reads(s, d), 3, True), 5, True).select("read_idx", "id", "sequence", "quality")


def trim_filter_classes(s, d):
    return T.classify_single(reads(s, d), CLIP, 30).groupBy("class").agg(F.count("*").alias("n"))


def trim_ns(s, d):
    return T.trim_n(reads(s, d)).select("read_idx", "sequence", "quality")


PAIRED = T.TrimConfig(paired=True, retain_unpaired=True, max_n=0.12, length=38, length_1=40, length_2=42, clip_r2=2, files=("a", "b"))


def _pairs(s, d):
    one = reads(s, d)
    two = one.withColumn("sequence", F.substring(R.reverse_complement("sequence"), F.lit(1), F.length("sequence") - (F.col("read_idx") % 9).cast("int")))
    return T.classify_pairs(T.pair_up(one, two), PAIRED, 38)


def trim_pairs(s, d):
    return _pairs(s, d).select("read_idx", "r2_sequence", "class")


def trim_unpaired(s, d):
    return _pairs(s, d).groupBy("class").agg(
        F.count("*").alias("n"), F.count_if("unpaired_1").alias("unpaired_1"),
        F.count_if("unpaired_2").alias("unpaired_2")
    )


def adapter_autodetect(s, d):
    return T.adapter_votes(spliced(s, d))


def adapter_choice(s, d):
    """The adapter that the first reads tell, and its name."""
    return s.createDataFrame([T.detect_adapter(spliced(s, d))], "adapter string, name string")


def trim_quality(s, d):
    return T.trim_ends(spliced(s, d), "X", T.TrimConfig()).select("read_idx", F.length("sequence").cast("long").alias("kept"), "quality_trimmed")


def trim_adapter(s, d):
    return T.trim_ends(
        spliced(s, d), "AGATCGGAAGAGC", T.TrimConfig(quality=0, stringency=3)
    ).select("read_idx", F.length("sequence").alias("kept"), "adapter_trimmed")


def module_verdicts(s, d):
    rows = [(m.id, m.status) for report in analyse(spliced(s, d), CFG) for m in report.modules]
    return s.createDataFrame(rows, "module string, status string")


def dedup_documents(s, d):
    """How many texts occur how often; copies are told by the whole text."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.sha2("text", 256).alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("level")).groupBy("level").agg(F.count("*").alias("keys"))


QUERIES = [
    basic_stats, per_base_quality, per_base_percentiles, per_tile_quality, per_sequence_quality, quality_mode,
    per_base_content, per_base_content_grouped, n_content, gc_counts, gc_distribution, gc_deviation,
    length_distribution, length_distribution_wide, duplication_levels, duplication_beyond_cap, first_distinct_keys, overrepresented,
    contaminants, adapter_content, kmer_counts, kmer_enrichment, kmer_content, kmer_pvalue, sampled_reads,
    casava_filter, read_functions, revcomp_softclip, colorspace_decode, trim_hard5, trim_hard3, trim_clip,
    trim_filter_classes, trim_ns, trim_pairs, trim_unpaired, adapter_autodetect, adapter_choice, trim_quality, trim_adapter,
    module_verdicts, dedup_documents
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_R = f"WITH all_reads AS ({READS_SQL}), reads AS (SELECT * FROM all_reads WHERE NOT is_filtered)"
_V = f"WITH all_reads AS ({VARIED_SQL}), reads AS (SELECT * FROM all_reads WHERE NOT is_filtered)"
_S = f"WITH all_reads AS ({SPLICED_SQL}), reads AS (SELECT * FROM all_reads WHERE NOT is_filtered)"
_L = "WITH reads AS (" + LONG_SQL % ", 'g'" + ")"
_POS = """, bases AS (SELECT read_idx, unnest(range(1, length(sequence) + 1)) AS pos, sequence, quality FROM reads),
cube AS (SELECT pos, substring(sequence, pos, 1) AS base, ascii(substring(quality, pos, 1)) AS code, count(*) AS n FROM bases GROUP BY ALL),
hist AS (SELECT pos, code, CAST(sum(n) AS BIGINT) AS n FROM cube GROUP BY ALL),
off AS (SELECT CASE WHEN min(code) < 64 THEN 33 ELSE 64 END AS o FROM hist),
run AS (SELECT pos, code - o AS q, n, sum(n) OVER (PARTITION BY pos) AS total, sum(n) OVER (PARTITION BY pos ORDER BY code ROWS UNBOUNDED PRECEDING) AS upto FROM hist, off WHERE code >= o)"""
_P = ", ".join(f"CASE WHEN max(total) > 100 THEN CAST(min(q) FILTER (upto >= floor(total * {p} / 100)) AS DOUBLE) END AS p{p}" for p in (50, 25, 75, 10, 90))
_ORD = ", ord AS (SELECT *, row_number() OVER (PARTITION BY (read_idx // 4096) % 4 ORDER BY read_idx) AS ordinal FROM reads)"
_SIX = lambda x: SIX.format(x)
_WIDTHS, _BINS = (", ".join(f"({w})" for w in widths(times)) for times in (6, 4))
_KMER = """, picked AS (SELECT substring(sequence, 1, 500) AS s FROM ord WHERE ordinal % 50 = 0),
kmers AS (SELECT substring(s, pos, 7) AS kmer, pos FROM (SELECT s, unnest(range(1, length(s) - 5)) AS pos FROM picked)),
counts AS (SELECT kmer, pos, count(*) AS n FROM kmers WHERE NOT contains(kmer, 'N') GROUP BY ALL)"""
_TAIL = "(CASE WHEN x >= 0 THEN {0} ELSE 2 - {0} END * 0.5)".format(
    "t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x)"
)
_ENRICHED = """, k AS (SELECT kmer, CAST(sum(n) AS BIGINT) AS count FROM counts GROUP BY ALL), g AS (SELECT pos, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL),
shares AS (SELECT kmer, pos, n AS hits, count, total, CAST(CAST(count AS FLOAT) / CAST((SELECT sum(n) FROM counts) AS FLOAT) AS FLOAT) AS share FROM counts JOIN k USING (kmer) JOIN g USING (pos)),
rated AS (SELECT *, CAST(share * CAST(total AS FLOAT) AS FLOAT) AS predicted, CAST(CAST(hits AS FLOAT) / CAST(share * CAST(total AS FLOAT) AS FLOAT) AS FLOAT) AS ratio FROM shares)"""
_PAIRS = """, two AS (SELECT read_idx, sequence AS s1, substring(translate(reverse(sequence), 'ACGT', 'TGCA'), 1, CAST(length(sequence) - read_idx % 9 AS INT)) AS s2 FROM all_reads),
cut AS (SELECT read_idx, s1, CASE WHEN length(s2) > 2 THEN substring(s2, 3) ELSE s2 END AS s2 FROM two),
cls AS (SELECT *, CASE WHEN (length(s1) > 0 AND (length(s1) - length(replace(s1, 'N', ''))) / length(s1) > 0.12) OR (length(s2) > 0 AND (length(s2) - length(replace(s2, 'N', ''))) / length(s2) > 0.12) THEN 'too_many_n'
  WHEN length(s1) < 38 OR length(s2) < 38 THEN 'too_short' ELSE 'kept' END AS class FROM cut)"""


def _mismatch_hit(seq: str) -> str:
    same = " + ".join(f"CAST(substring(sequence, k + {i + 1}, 1) <> '{c}' AS INT)" for i, c in enumerate(seq[:20]))
    return f"list_filter(list_transform(range(0, length(sequence) - 19), lambda k: {same}), lambda m: m <= 1)[1]"


def _turned(seq: str) -> str:
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def _source_sql(contaminants: list[tuple[str, str]]) -> str:
    parts = []
    for name, seq in contaminants:
        for s in (seq, _turned(seq)):
            parts.append(f"WHEN contains(sequence, '{s}') OR contains('{s}', sequence) THEN '{name} (100%)'")
            if len(s) >= 20:
                parts.append(
                    f"WHEN length(sequence) >= 20 AND {_mismatch_hit(s)} IS NOT NULL THEN concat('{name} (', CAST(100 - {_mismatch_hit(s)} * 5 AS VARCHAR), '%)')"
                )
    return "CASE " + " ".join(parts) + " ELSE 'No Hit' END"


ORACLES = {
    "basic_stats": _R + f"""{_POS}, b AS (SELECT CAST(sum(n) FILTER (base IN ('G', 'C')) AS BIGINT) AS gc, CAST(sum(n) FILTER (base IN ('A', 'C', 'G', 'T')) AS BIGINT) AS acgt, CAST(sum(n) AS BIGINT) AS every, min(code) AS lowest FROM cube)
      SELECT 'events.fastq' AS file_name, 'Conventional base calls' AS file_type, CASE WHEN lowest < 64 THEN 'Sanger / Illumina 1.9' WHEN lowest < 66 THEN 'Illumina 1.3' ELSE 'Illumina 1.5' END AS encoding,
      (SELECT count(*) FROM reads) AS total_sequences, (SELECT count(*) FROM all_reads WHERE is_filtered) AS filtered_sequences, every AS total_bases,
      (SELECT CAST(min(length(sequence)) AS BIGINT) FROM reads) AS min_length, (SELECT CAST(max(length(sequence)) AS BIGINT) FROM reads) AS max_length, gc * 100 // acgt AS gc_percent, {_SIX('gc * 100.0 / acgt')} AS gc_exact FROM b""",
    "per_base_quality": _R + _POS + f", p AS (SELECT pos, sum(n * q) / sum(n) AS mean, {_P} FROM run GROUP BY pos) SELECT CAST(pos AS VARCHAR) AS label, {_SIX('mean')} AS mean, {', '.join(f"coalesce(p{p}, 'NaN'::DOUBLE) AS {n}" for p, n in ((50, 'median'), (25, 'lower'), (75, 'upper'), (10, 'p10'), (90, 'p90')))} FROM p",
    "per_base_percentiles": _R + _POS + f" SELECT pos, CAST(max(total) AS BIGINT) AS total, {_P} FROM run GROUP BY pos",
    "per_tile_quality": _R + _ORD + f""", t AS (SELECT CAST(split_part(id, ':', 5) AS BIGINT) AS tile, quality FROM ord WHERE ordinal <= 10000 OR ordinal % 10 = 0),
      c AS (SELECT tile, pos, ascii(substring(quality, pos, 1)) AS code FROM (SELECT tile, quality, unnest(range(1, length(quality) + 1)) AS pos FROM t)),
      m AS (SELECT tile, pos, avg(code - (SELECT CASE WHEN min(code) < 64 THEN 33 ELSE 64 END FROM c)) AS mean FROM c GROUP BY ALL),
      g AS (SELECT tile, pos, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT tile FROM c) CROSS JOIN (SELECT DISTINCT pos FROM c) LEFT JOIN m USING (tile, pos))
      SELECT tile, CAST(pos AS VARCHAR) AS label, {_SIX('mean - avg(mean) OVER (PARTITION BY pos)')} AS mean_deviation FROM g""",
    "per_sequence_quality": _R + """, c AS (SELECT read_idx, list_transform(range(1, length(quality) + 1), lambda i: ascii(substring(quality, i, 1))) AS codes FROM reads),
      m AS (SELECT CAST(list_sum(codes) // len(codes) AS BIGINT) AS code, list_min(codes) AS least FROM c)
      SELECT code - (SELECT CASE WHEN min(least) < 64 THEN 33 ELSE 64 END FROM m) AS quality, count(*) AS n FROM m GROUP BY ALL""",
    "quality_mode": _R + """, c AS (SELECT list_transform(range(1, length(quality) + 1), lambda i: ascii(substring(quality, i, 1))) AS codes FROM reads),
      m AS (SELECT CAST(list_sum(codes) // len(codes) AS BIGINT) AS code, list_min(codes) AS least FROM c)
      SELECT code - (SELECT CASE WHEN min(least) < 64 THEN 33 ELSE 64 END FROM m) AS mode FROM m GROUP BY code ORDER BY count(*) DESC, code LIMIT 1""",
    "per_base_content": _R + _POS + ", s AS (SELECT pos, " + ", ".join(f"coalesce(sum(n) FILTER (base = '{b}'), 0) AS {b.lower()}" for b in "GATC") + " FROM cube GROUP BY pos) SELECT CAST(pos AS VARCHAR) AS label, " + ", ".join(
        f"CASE WHEN g + a + t + c > 0 THEN {_SIX(f'{b} * 100.0 / (g + a + t + c)')} ELSE 0 END AS {b}_percent" for b in "gatc"
    ) + " FROM s",
    "per_base_content_grouped": _L + f""", top AS (SELECT max(length(sequence)) AS l FROM reads),
      w AS (SELECT l, (SELECT min(v) FROM (VALUES {_WIDTHS}) x(v) WHERE 9 + (l - 9 + v - 1) // v <= 75) AS w FROM top),
      b AS (SELECT substring(sequence, pos, 1) AS base, pos FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS pos FROM reads)),
      g AS (SELECT CASE WHEN pos <= 9 OR l <= 75 THEN pos ELSE 10 + (pos - 10) // w * w END AS lo, CASE WHEN pos <= 9 OR l <= 75 THEN pos ELSE least(l, 10 + (pos - 10) // w * w + w - 1) END AS hi, base FROM b, w),
      s AS (SELECT CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE concat(CAST(lo AS VARCHAR), '-', CAST(hi AS VARCHAR)) END AS label, """ + ", ".join(f"count(*) FILTER (base = '{b}') AS {b.lower()}" for b in "GATC") + " FROM g GROUP BY ALL) SELECT label, " + ", ".join(f"CASE WHEN g + a + t + c > 0 THEN {_SIX(f'{b} * 100.0 / (g + a + t + c)')} ELSE 0 END AS {b}_percent" for b in "gatc") + " FROM s",
    "n_content": _R + _POS + f" SELECT CAST(pos AS VARCHAR) AS label, {_SIX("coalesce(sum(n) FILTER (base = 'N'), 0) * 100.0 / sum(n)")} AS n_percent FROM cube GROUP BY pos",
    "gc_counts": _L + """, p AS (SELECT CASE WHEN length(sequence) > 1000 THEN substring(sequence, 1, length(sequence) // 1000 * 1000) WHEN length(sequence) > 100 THEN substring(sequence, 1, length(sequence) // 100 * 100) ELSE sequence END AS s FROM reads)
      SELECT CAST(length(s) AS BIGINT) AS len, CAST(length(s) - length(translate(s, 'GC', '')) AS BIGINT) AS gc, count(*) AS n FROM p WHERE length(s) > 0 GROUP BY ALL""",
    "length_distribution": _R + """, l AS (SELECT length(sequence) AS len FROM reads), e AS (SELECT unnest(range(min(len), max(len) + 1)) AS lo FROM l)
      SELECT CAST(lo AS VARCHAR) AS label, (SELECT count(*) FROM l WHERE len = lo) AS n FROM e""",
    "length_distribution_wide": _L + f""", l AS (SELECT length(sequence) AS len FROM reads), x AS (SELECT min(len) AS a, max(len) AS b FROM l),
      w AS (SELECT a, b, CASE WHEN b - a + 1 <= 75 THEN 1 ELSE (SELECT min(v) FROM (VALUES {_BINS}) y(v) WHERE (b - a + 1) // v <= 50) END AS w FROM x),
      e AS (SELECT unnest(range(a, b + 1, w)) AS lo, w, b FROM w), h AS (SELECT lo, least(b, lo + w - 1) AS hi FROM e)
      SELECT CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE concat(CAST(lo AS VARCHAR), '-', CAST(hi AS VARCHAR)) END AS label, (SELECT count(*) FROM l WHERE len BETWEEN lo AND hi) AS n FROM h""",
    "duplication_levels": _V + f""", k AS (SELECT count(*) AS level FROM reads GROUP BY CASE WHEN length(sequence) > 50 THEN substring(sequence, 1, 50) ELSE sequence END),
      s AS (SELECT CASE WHEN level <= 10 THEN level - 1 WHEN level <= 50 THEN 9 WHEN level <= 100 THEN 10 WHEN level <= 500 THEN 11 WHEN level <= 1000 THEN 12 WHEN level <= 5000 THEN 13 WHEN level <= 10000 THEN 14 ELSE 15 END AS slot, level FROM k),
      n AS (SELECT unnest(range(0, 16)) AS slot, unnest(['1','2','3','4','5','6','7','8','9','>10','>50','>100','>500','>1k','>5k','>10k']) AS label)
      SELECT label, {_SIX('coalesce((SELECT sum(level) FROM s WHERE s.slot = n.slot), 0) * 100.0 / (SELECT sum(level) FROM s)')} AS percent, {_SIX('(SELECT count(*) FROM s) * 100.0 / (SELECT sum(level) FROM s)')} AS deduplicated FROM n""",
    "duplication_beyond_cap": f"""WITH reads AS (SELECT read_idx, substring(sequence, 1, 50) AS key, row_number() OVER (ORDER BY read_idx) AS ordinal FROM ({MANY_SQL.replace("%s", "unnest(range(20))")}) m WHERE NOT is_filtered),
      k AS (SELECT key, count(*) AS level, min(ordinal) AS first FROM reads GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY first) AS rank FROM k),
      lim AS (SELECT (SELECT count(*) FROM reads) AS total, coalesce((SELECT first FROM r WHERE rank = 100000), (SELECT count(*) FROM reads)) AS seen_reads),
      l AS (SELECT level, CAST(count(*) AS DOUBLE) AS seen FROM r WHERE rank <= 100000 GROUP BY level),
      u AS (SELECT level, seen, total, seen_reads, (SELECT exp(sum(ln(1 - level::DOUBLE / (total - i)))) FROM range(seen_reads) t(i) WHERE level <= total - seen_reads) AS unseen FROM l, lim),
      c AS (SELECT level, CASE WHEN seen_reads = total OR total - seen < seen_reads OR level > total - seen_reads OR unseen < 0.01 / (seen + 0.01) THEN seen ELSE seen / (1 - unseen) END AS n FROM u),
      s AS (SELECT CASE WHEN level <= 10 THEN level - 1 WHEN level <= 50 THEN 9 WHEN level <= 100 THEN 10 WHEN level <= 500 THEN 11 WHEN level <= 1000 THEN 12 WHEN level <= 5000 THEN 13 WHEN level <= 10000 THEN 14 ELSE 15 END AS slot, level, n FROM c),
      n AS (SELECT unnest(range(0, 16)) AS slot, unnest(['1','2','3','4','5','6','7','8','9','>10','>50','>100','>500','>1k','>5k','>10k']) AS label)
      SELECT label, {_SIX('coalesce((SELECT sum(n * level) FROM s WHERE s.slot = n.slot), 0) / (SELECT sum(n * level) FROM s) * 100')} AS percent, {_SIX('(SELECT sum(n) FROM s) / (SELECT sum(n * level) FROM s) * 100')} AS deduplicated FROM n""",
    "first_distinct_keys": _V + """, o AS (SELECT *, row_number() OVER (ORDER BY read_idx) AS ordinal FROM reads),
      k AS (SELECT substring(sequence, 1, 50) AS key, count(*) AS n, min(ordinal) AS first FROM o GROUP BY ALL)
      SELECT * FROM (SELECT key, n, first, row_number() OVER (ORDER BY first) AS rank FROM k) WHERE rank <= 100000""",
    "overrepresented": _V + f""", found AS (SELECT substring(sequence, 1, 50) AS sequence, count(*) AS n, {_SIX('count(*) * 100.0 / (SELECT count(*) FROM reads)')} AS percent
      FROM reads GROUP BY substring(sequence, 1, 50) HAVING count(*) * 100.0 / (SELECT count(*) FROM reads) > 0.02) SELECT *, {_source_sql(CONTAMINANTS)} AS source FROM found""",
    "contaminants": _S + f" SELECT read_idx, {_source_sql(TWO)} AS source FROM reads",
    "adapter_content": _S + f""", ad(name, s) AS (VALUES {', '.join("('" + n.replace("'", "''") + "', '" + q + "')" for n, q in CFG.adapters)}),
      w AS (SELECT (read_idx // 4096) % 4 AS w, greatest(max(length(sequence)) - 12, 0) AS last FROM reads GROUP BY ALL),
      h AS (SELECT (read_idx // 4096) % 4 AS w, name, instr(sequence, s) AS pos FROM reads CROSS JOIN ad WHERE contains(sequence, s)),
      p AS (SELECT name, unnest(range(1, (SELECT max(last) FROM w) + 2)) AS pos FROM ad)
      SELECT name, CAST(pos AS VARCHAR) AS label, {_SIX('(SELECT count(*) FROM h JOIN w USING (w) WHERE h.name = p.name AND h.pos <= p.pos AND p.pos - 1 <= w.last) * 100.0 / (SELECT count(*) FROM reads)')} AS percent FROM p""",
    "kmer_counts": _R + _ORD + _KMER + " SELECT * FROM counts",
    "kmer_enrichment": _S + _ORD + _KMER + _ENRICHED + f" SELECT kmer, CAST(pos AS VARCHAR) AS label, count, hits, {_SIX('CAST(ratio AS DOUBLE)')} AS ratio FROM rated",
    "kmer_content": _S + _ORD + _KMER + _ENRICHED + f""", x AS (SELECT *, (CAST(hits AS DOUBLE) - total * CAST(share AS DOUBLE)) / sqrt(total * CAST(share AS DOUBLE) * (1 - CAST(share AS DOUBLE))) / sqrt(2.0::DOUBLE) AS x FROM rated),
      tested AS (SELECT *, CASE WHEN CAST(hits AS FLOAT) > predicted AND ratio > 5 THEN CAST(CASE WHEN share >= 1 OR total = 0 THEN 1 ELSE {_TAIL} END * {4.0**7!r}::DOUBLE AS FLOAT) END AS p FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t FROM x)),
      best AS (SELECT kmer, count, min(p) FILTER (p < 0.01) AS p_value, max(ratio) AS ratio, max_by(CAST(pos AS VARCHAR), (ratio, pos)) AS label FROM tested GROUP BY kmer, count HAVING min(p) FILTER (p < 0.01) IS NOT NULL)
      SELECT rank, kmer, count * 50 AS count, {_SIX('CAST(p_value AS DOUBLE)')} AS p_value, {_SIX('CAST(ratio AS DOUBLE)')} AS ratio, label FROM (SELECT *, row_number() OVER (ORDER BY ratio DESC, kmer) AS rank FROM best) WHERE rank <= 20""",
    "kmer_pvalue": _R + f""", k AS (SELECT DISTINCT CAST(length(sequence) - 35 AS DOUBLE) AS k FROM all_reads), x AS (SELECT k, (k - 5000.0::DOUBLE * 0.002::DOUBLE) / sqrt(5000.0::DOUBLE * 0.002::DOUBLE * (1 - 0.002::DOUBLE)) / sqrt(2.0::DOUBLE) AS x FROM k),
      t AS (SELECT k, x, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t FROM x) SELECT k, {_SIX(f"{_TAIL} * 16")} AS p FROM t""",
    "colorspace_decode": _R + f""" SELECT read_idx, substring(list_reduce(list_prepend('T', string_split(translate(sequence, 'ACGTN', '0123.'), '')), lambda s, c: concat(s, CASE WHEN right(s, 1) = 'N' THEN 'N' {' '.join(f"WHEN c = '{digit}' THEN translate(right(s, 1), 'ACGT', '{to}')" for digit, to in R.COLOURS.items())} ELSE 'N' END)), 2) AS bases FROM all_reads""",
    "trim_quality": _S + """, b AS (SELECT read_idx, quality, length(quality) AS n, unnest(range(1, length(quality) + 1)) AS pos FROM all_reads),
      s AS (SELECT read_idx, n, pos, sum(53 - ascii(substring(quality, pos, 1))) OVER (PARTITION BY read_idx ORDER BY pos DESC) AS s FROM b),
      a AS (SELECT *, coalesce(max(pos) FILTER (s < 0) OVER (PARTITION BY read_idx), 0) AS stop FROM s),
      c AS (SELECT read_idx, n, arg_max(pos, (s, pos)) FILTER (pos > stop AND s > 0) AS cut FROM a GROUP BY ALL)
      SELECT read_idx, CAST(coalesce(cut - 1, n) AS BIGINT) AS kept, CAST(n - coalesce(cut - 1, n) AS BIGINT) AS quality_trimmed FROM c""",
    "sampled_reads": _R + _ORD + " SELECT read_idx, ordinal FROM ord WHERE ordinal % 50 = 0",
    "casava_filter": _R + " SELECT is_filtered AS flag, count(*) AS n FROM all_reads GROUP BY ALL",
    "read_functions": _R + """ SELECT read_idx, translate(reverse(sequence), 'ACGT', 'TGCA') AS turned, substring(sequence, 1, 30) AS key, CAST(length(sequence) - length(translate(sequence, 'GC', '')) AS BIGINT) AS gc, CAST(length(sequence) - length(translate(sequence, 'Nn', '')) AS BIGINT) AS ns,
      CAST(list_sum(list_transform(range(1, length(quality) + 1), lambda i: ascii(substring(quality, i, 1)))) // length(quality) AS BIGINT) AS mean_code, CAST(split_part(id, ':', 5) AS BIGINT) AS tile FROM all_reads""",
    "revcomp_softclip": _R + """, c AS (SELECT read_idx, CASE WHEN read_idx % 5 = 0 THEN substring(sequence, 6) WHEN read_idx % 5 = 1 THEN substring(sequence, 1, length(sequence) - 3) ELSE sequence END AS s, CASE WHEN read_idx % 5 = 0 THEN substring(quality, 6) WHEN read_idx % 5 = 1 THEN substring(quality, 1, length(quality) - 3) ELSE quality END AS q FROM all_reads WHERE NOT (read_idx % 3 <> 0 AND read_idx % 7 = 0))
      SELECT read_idx, CASE WHEN read_idx % 3 = 0 THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS sequence, CASE WHEN read_idx % 3 = 0 THEN reverse(q) ELSE q END AS quality FROM c""",
    "trim_hard5": _R + " SELECT read_idx, substring(sequence, 1, 20) AS sequence, substring(quality, 1, 20) AS quality FROM all_reads",
    "trim_hard3": _R + " SELECT read_idx, right(sequence, 20) AS sequence, right(quality, 20) AS quality FROM all_reads",
    "trim_clip": _R + """, a AS (SELECT read_idx, CASE WHEN length(sequence) > 3 THEN concat(id, ':clip5:', substring(sequence, 1, 3)) ELSE id END AS id, CASE WHEN length(sequence) > 3 THEN substring(sequence, 4) ELSE sequence END AS s, CASE WHEN length(sequence) > 3 THEN substring(quality, 4) ELSE quality END AS q FROM all_reads)
      SELECT read_idx, CASE WHEN length(s) > 5 THEN concat(id, ':clip3:', right(s, 5)) ELSE id END AS id, CASE WHEN length(s) > 5 THEN substring(s, 1, length(s) - 5) ELSE s END AS sequence, CASE WHEN length(s) > 5 THEN substring(q, 1, length(q) - 5) ELSE q END AS quality FROM a""",
    "trim_filter_classes": _R + """, a AS (SELECT substring(sequence, 4, length(sequence) - 8) AS s FROM all_reads)
      SELECT CASE WHEN length(s) - length(replace(s, 'N', '')) > 3 THEN 'too_many_n' WHEN length(s) < 30 THEN 'too_short' WHEN length(s) > 41 THEN 'too_long' ELSE 'kept' END AS class, count(*) AS n FROM a GROUP BY ALL""",
    "trim_ns": _R + " SELECT read_idx, trim(sequence, 'Nn') AS sequence, substring(quality, length(sequence) - length(ltrim(sequence, 'Nn')) + 1, length(trim(sequence, 'Nn'))) AS quality FROM all_reads",
    "trim_pairs": _R + _PAIRS + " SELECT read_idx, s2 AS r2_sequence, class FROM cls",
    "trim_unpaired": _R + _PAIRS + " SELECT class, count(*) AS n, count(*) FILTER (class = 'too_short' AND length(s1) >= 40) AS unpaired_1, count(*) FILTER (class = 'too_short' AND length(s2) >= 42) AS unpaired_2 FROM cls GROUP BY ALL",
    "adapter_autodetect": _S + " SELECT count(*) FILTER (contains(sequence, 'AGATCGGAAGAGC')) AS illumina, count(*) FILTER (contains(sequence, 'CTGTCTCTTATA')) AS nextera, count(*) FILTER (contains(sequence, 'TGGAATTCTCGG')) AS small_rna FROM all_reads",
    "adapter_choice": _S + """, v AS (SELECT unnest(['AGATCGGAAGAGC', 'CTGTCTCTTATA', 'TGGAATTCTCGG']) AS adapter, unnest(['Illumina TruSeq, Sanger iPCR', 'Nextera Transposase sequence', 'Illumina small RNA adapter']) AS name, unnest([0, 1, 2]) AS k),
      n AS (SELECT *, (SELECT count(*) FROM all_reads WHERE read_idx < 999999 AND contains(sequence, adapter)) AS n FROM v), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS place, lead(n) OVER (ORDER BY n DESC, k) AS next FROM n)
      SELECT adapter, name FROM v WHERE k = (SELECT CASE WHEN n = next THEN 0 ELSE k END FROM o WHERE place = 1)""",
    "dedup_documents": "SELECT level, count(*) AS keys FROM (SELECT count(*) AS level FROM documents GROUP BY text) GROUP BY ALL",
}
_GC = _R + """, g AS (SELECT length(sequence) AS len, length(sequence) - length(translate(sequence, 'GC', '')) AS gc, count(*) AS n FROM reads WHERE length(sequence) > 0 GROUP BY ALL),
  lens AS (SELECT DISTINCT len FROM g), claims AS (SELECT len, gc, unnest(range(CAST(floor(greatest(gc - 0.5::DOUBLE, 0) * 100.0::DOUBLE / len + 0.5) AS BIGINT), CAST(floor(least(gc + 0.5::DOUBLE, len) * 100.0::DOUBLE / len + 0.5) AS BIGINT) + 1)) AS pct FROM (SELECT len, unnest(range(0, len + 1)) AS gc FROM lens)),
  model AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY len, pct) AS weight FROM claims),
  dist AS (SELECT pct, coalesce(s, 0) AS c FROM (SELECT unnest(range(0, 101)) AS pct) LEFT JOIN (SELECT pct, sum(n * weight) AS s FROM g JOIN model USING (len, gc) GROUP BY ALL) USING (pct))"""
ORACLES["gc_distribution"] = _GC + f" SELECT pct, {_SIX('c')} AS observed FROM dist"
ORACLES["gc_deviation"] = _GC + f""", top AS (SELECT pct AS t, c AS m FROM dist ORDER BY c DESC, pct LIMIT 1),
  ends AS (SELECT t, (SELECT min(pct) FROM dist WHERE pct >= t AND NOT c > m - m / 10) AS above, (SELECT max(pct) FROM dist WHERE pct < t AND NOT c > m - m / 10) AS below FROM top),
  mode AS (SELECT CASE WHEN above IS NULL OR below IS NULL THEN t ELSE (above + below) / 2.0::DOUBLE END AS mu FROM ends),
  sd AS (SELECT mu, sqrt(sum((pct - mu) * (pct - mu) * c) / (sum(c) - 1)) AS sd, sum(c) AS total FROM dist, mode GROUP BY mu)
  SELECT {_SIX('sum(abs(exp(-(pct - mu) * (pct - mu) / (2 * sd * sd)) / sqrt(2 * pi() * sd * sd) * total - c)) / any_value(total) * 100')} AS deviation FROM dist, sd"""


def _verdict_sql(module: str, query: str, fails: str, warns: str) -> str:
    """A module's verdict over the spliced reads; the conditions are on aggregates of another query's rows."""
    rows = ORACLES[query].replace(_R, _S, 1).replace(_V, _S, 1)
    return f"SELECT '{module}' AS module, CASE WHEN {fails} THEN 'fail' WHEN {warns} THEN 'warn' ELSE 'pass' END AS status FROM ({rows}) x"


_LOW = "coalesce(bool_or(NOT isnan(lower) AND lower < {} OR NOT isnan(median) AND median < {}), false)"
_APART = "max(greatest(abs(g_percent - c_percent), abs(a_percent - t_percent))) > {}"
ORACLES["module_verdicts"] = " UNION ALL ".join(
    [
        "SELECT 'basic_statistics' AS module, 'pass' AS status",
        _verdict_sql("per_base_sequence_quality", "per_base_quality", _LOW.format(5, 20), _LOW.format(10, 25)),
        _verdict_sql("per_tile_sequence_quality", "per_tile_quality", "max(abs(mean_deviation)) > 10", "max(abs(mean_deviation)) > 5"),
        _verdict_sql("per_sequence_quality_scores", "quality_mode", "max(mode) < 20", "max(mode) < 27"),
        _verdict_sql("per_base_sequence_content", "per_base_content", _APART.format(20), _APART.format(10)),
        _verdict_sql("per_sequence_gc_content", "gc_deviation", "max(deviation) > 30", "max(deviation) > 15"),
        _verdict_sql("per_base_n_content", "n_content", "max(n_percent) > 20", "max(n_percent) > 5"),
        _verdict_sql("sequence_length_distribution", "length_distribution", "bool_or(label = '0' AND n > 0)", "count(*) > 1"),
        _verdict_sql("sequence_duplication_levels", "duplication_levels", "max(deduplicated) < 50", "max(deduplicated) < 70"),
        _verdict_sql("overrepresented_sequences", "overrepresented", "coalesce(max(percent), 0) > 1", "coalesce(max(percent), 0) > 0.1"),
        _verdict_sql("adapter_content", "adapter_content", "max(percent) > 10", "max(percent) > 5"),
        "SELECT 'kmer_content' AS module, 'not_applicable' AS status",
    ]
)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
