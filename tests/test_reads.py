import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from seqloom.config import DEFAULT_ADAPTERS, QcConfig
from seqloom.functions import reads as R
from seqloom.operators import basic, positions, sequences
from seqloom.plans.qc import analyse
from seqloom.report.writers import json_report, summary, text_report, write_all
from seqloom.sources.alignments import detect_format, read_any, read_bam, read_sam
from seqloom.sources.fastq import FastqError, read_fastq, records, write_fastq
from seqloom.trim import operators as T
from seqloom.trim.runs import run as run_trim


def fastq(n, size=16):
    return "".join(f"@r{i}\n{'ACGT'[i % 4] * size}\n+\n{'@' + 'I' * (size - 1)}\n" for i in range(n))


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("read_idx").select(*cols).collect()]


@pytest.mark.parametrize("bytes_a_split", [64, 1 << 20])
def test_fastq_split_or_whole(spark, tmp_path, bytes_a_split):
    (tmp_path / "a.fastq").write_text(fastq(40) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = rows(read_fastq(spark, str(tmp_path / "a.fastq")), "read_idx", "id", "sequence", "quality", "is_filtered")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, f"r{i}", "ACGT"[i % 4] * 16, "@" + "I" * 15, False) for i in range(40)]


def test_fastq_blank_lines_gzip_and_errors(spark, tmp_path):
    blank = tmp_path / "b.fastq"
    blank.write_text("\n" + fastq(3).replace("@r1", "\n\n@r1"))
    assert [r[0] for r in rows(read_fastq(spark, str(blank)), "id")] == ["r0", "r1", "r2"]
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write(fastq(5))
    assert read_fastq(spark, str(tmp_path / "c.fastq.gz")).count() == 5
    for name, text in (("short", fastq(2)[:-30]), ("id", "r\nA\n+\nI\n"), ("plus", "@r\nA\nx\nI\n"), ("length", "@r\nAC\n+\nI\n")):
        bad = tmp_path / f"{name}.fastq"
        bad.write_text(text)
        with pytest.raises(Exception, match="record") as error:
            read_fastq(spark, str(bad)).collect()
        assert "FastqError" in str(error.value) or isinstance(error.value, FastqError)
    assert records(spark, str(tmp_path / "short.fastq"), lenient=True).count() == 1


def test_casava_and_colorspace(spark, tmp_path):
    (tmp_path / "c.fastq").write_text("@a 1:Y:0\nT0123\n+\n!IIII\n@b 1:N:0\nT10.2\n+\n!IIII\n")
    got = rows(read_fastq(spark, str(tmp_path / "c.fastq"), QcConfig(casava=True)), "sequence", "quality", "colorspace", "is_filtered")
    assert got == [("TGAT", "IIII", "T0123", True), ("GGNN", "IIII", "T10.2", False)]


SAM = "@HD\tVN:1.6\nread1\t0\tc\t1\t60\t16M\t*\t0\t0\t" + "A" * 16 + "\t" + "I" * 16 + "\nread2\t16\tc\t1\t60\t16M\t*\t0\t0\t" + "T" * 16 + "\t" + "I" * 16 + "\nread3\t0\tc\t1\t60\t5S11M\t*\t0\t0\tGGGGGATCGATCGATC\t*\nread4\t4\t*\t0\t0\t*\t*\t0\t0\t" + "C" * 16 + "\t" + "I" * 16 + "\nbroken\n"


def bam_bytes():
    def record(name, flag, cigar, seq, qual):
        code = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 15}
        packed = bytes(code[seq[i]] << 4 | (code[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        body = struct.pack(
            "<iiBBHHHiiii", 0, 0, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0
        ) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + packed + qual
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99)
    data = head + record("read1", 0, [(16, 0)], "A" * 16, b"\x28" * 16) + record("read3", 16, [(5, 4), (10, 0)], "GGGGGATCGATCGAT", b"\xff" * 15)
    out = b""
    for part in (data[:50], data[50:], b""):
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_sam_and_bam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "x.bam").write_bytes(bam_bytes())
    assert rows(read_sam(spark, str(tmp_path / "x.sam")), "sequence") == [("A" * 16,), ("A" * 16,), ("GGGGGATCGATCGATC",), ("C" * 16,)]
    mapped = rows(read_sam(spark, str(tmp_path / "x.sam"), True), "id", "sequence", "quality")
    assert mapped == [("read1", "A" * 16, "I" * 16), ("read2", "A" * 16, "I" * 16), ("read3", "ATCGATCGATC", "!" * 11)]
    assert rows(read_bam(spark, str(tmp_path / "x.bam"), True), "sequence", "quality") == [("A" * 16, "I" * 16), ("ATCGATCGAT", "!" * 10)]
    assert [detect_format(x) for x in ("a.BAM", "a.sam", "a.fq.gz")] == ["bam", "sam", "fastq"]
    assert read_any(spark, str(tmp_path / "x.sam"), QcConfig(format="sam_mapped"))[0].count() == 3


def expected(name, reads, gc, statuses, gc_counts, bases, slot, kept, record, poly_a):
    """The whole text report, but for its first line, of equal 16-base reads of quality I."""
    out = []

    def section(title, lines):
        out.extend([f">>{title}\t{statuses[title]}", *lines, ">>END_MODULE"])

    section(
        "Basic Statistics",
        [
            "#Measure\tValue", f"Filename\t{name}", "File type\tConventional base calls",
            "Encoding\tIllumina 1.5", f"Total Sequences\t{reads}", f"Total Bases\t{16 * reads} bp",
            "Sequences flagged as poor quality\t0", "Sequence length\t16", f"%GC\t{gc}"
        ]
    )
    section(
        "Per base sequence quality",
        ["#Base\tMean\tMedian\tLower Quartile\tUpper Quartile\t10th Percentile\t90th Percentile", *(f"{i}\t9.0" + "\tNaN" * 5 for i in range(1, 17))]
    )
    section("Per sequence quality scores", ["#Quality\tCount", f"9\t{reads}.0"])
    section(
        "Per base sequence content",
        ["#Base\tG\tA\tT\tC", *(f"{i + 1}\t" + "\t".join("100.0" if b == bases[i] else "0.0" for b in "GATC") for i in range(16))]
    )
    section("Per sequence GC content", ["#GC Content\tCount", *(f"{i}\t{gc_counts.get(i, 0.0)}" for i in range(101))])
    section("Per base N content", ["#Base\tN-Count", *(f"{i}\t0.0" for i in range(1, 17))])
    section("Sequence Length Distribution", ["#Length\tCount", f"16\t{reads}.0"])
    labels = ["1", "2", "3", "4", "5", "6", "7", "8", "9", ">10", ">50", ">100", ">500", ">1k", ">5k", ">10k+"]
    section(
        "Sequence Duplication Levels",
        [
            f"#Total Deduplicated Percentage\t{kept}", "#Duplication Level\tPercentage of total",
            *(f"{x}\t{100.0 if i == slot else 0.0}" for i, x in enumerate(labels))
        ]
    )
    section("Overrepresented sequences", ["#Sequence\tCount\tPercentage\tPossible Source", record])
    section("Adapter Content", ["#Position\t" + "\t".join(n for n, _ in DEFAULT_ADAPTERS), *(f"{i}\t0.0\t0.0\t0.0\t0.0\t{poly_a}\t0.0" for i in range(1, 6))])
    return out


SAME = {
    t: "pass" for t in ("Basic Statistics", "Per base sequence quality", "Per base N content", "Sequence Length Distribution")
} | {t: "fail" for t in ("Per sequence quality scores", "Per base sequence content", "Overrepresented sequences")}
KNOWN = {
    "minimal": (
        "A" * 16, 1,
        dict(
            gc=0,
            statuses=SAME | {"Per sequence GC content": "fail", "Sequence Duplication Levels": "pass", "Adapter Content": "fail"},
            gc_counts={0: 1.0, 1: 1.0, 2: 1.0, 3: 0.5}, slot=0, kept=100.0, poly_a=100.0
        )
    ),
    "complex": (
        "ACGT" * 4, 5,
        dict(
            gc=50,
            statuses=SAME | {"Per sequence GC content": "warn", "Sequence Duplication Levels": "fail", "Adapter Content": "pass"},
            gc_counts={47: 2.5, 48: 5.0, 49: 5.0, 50: 5.0, 51: 5.0, 52: 5.0, 53: 2.5}, slot=4, kept=20.0,
            poly_a=0.0
        )
    ),
}


@pytest.mark.parametrize("name", [*KNOWN])
def test_reports_equal_known_ones(spark, tmp_path, name):
    bases, n, rest = KNOWN[name]
    (tmp_path / f"{name}.fastq").write_text("".join(f"@r{i}\n{bases}\n+\n{'I' * 16}\n" for i in range(n)))
    report = analyse(read_fastq(spark, str(tmp_path / f"{name}.fastq")))[0]
    assert text_report(report).splitlines()[1:] == expected(f"{name}.fastq", n, bases=bases, record=f"{bases}\t{n}\t100.0\tNo Hit", **rest)
    assert len(summary(report).splitlines()) == 10
    data = json_report(report)
    assert [m["id"] for m in data["modules"]][-1] == "kmer_content" and data["summary"]["overall_status"] == "fail"
    made = write_all(report, tmp_path, extract=True, as_json=True)
    assert all(p.exists() for p in made) and (tmp_path / f"{name}_qc" / "qc_data.txt").exists()


def frame(spark, seqs, quals=None, ids=None):
    data = [("f", i, (ids or [f"r{i}" for i in range(len(seqs))])[i], s, (quals or ["I" * len(x) for x in seqs])[i], None, False) for i, s in enumerate(seqs)]
    return spark.createDataFrame(data, "file_name string, read_idx long, id string, sequence string, quality string, colorspace string, is_filtered boolean")


def test_percentiles_need_more_than_a_hundred(spark):
    for n, known in ((100, False), (101, True)):
        r = positions.base_quality(frame(spark, ["A"] * n, ["5"] * n), QcConfig()).first()
        assert (r.median == 20.0) is known and r.mean == 20.0


def test_first_distinct_keys_by_simulation(spark):
    seqs = ["ACGT"[i * i % 4] + "ACGT"[i // 3 % 4] + "ACGT"[i * 7 % 4] for i in range(60)]
    cap, known, limit = 5, {}, 60
    for i, s in enumerate(seqs):
        if s in known:
            known[s] += 1
        elif len(known) < cap:
            known[s] = 1
            if len(known) == cap:
                limit = i + 1
    keys = sequences.key_counts(frame(spark, seqs), QcConfig(unique_cap=cap)).collect()
    assert {r.key: r.n for r in keys} == known
    assert max(r["first"] for r in keys) == limit


def test_metrics_dont_depend_on_partitions(spark):
    seqs = [("ACGTN" * 30)[i : i + 20 + i % 40] for i in range(120)]
    reads = frame(spark, seqs, ids=[f"S:1:F:1:{1100 + i % 3}:{i}:1" for i in range(120)])
    config = QcConfig(compat=False)
    for make in (
        lambda r: positions.tile_quality(r, config), lambda r: sequences.adapter_content(r, config),
        basic.length_distribution, lambda r: positions.base_content(r, config)
    ):
        a, b = (sorted(map(str, make(r).collect())) for r in (reads, reads.repartition(7, F.rand(3))))
        assert a == b


def test_four_workers_agree_with_one_on_few_reads(spark):
    reads = frame(spark, [("ACGT" * 15)[i % 4 : 30 + i % 9] for i in range(200)])
    for make in (lambda c: sequences.adapter_content(reads, c), lambda c: sequences.kmer_counts(reads, c), lambda c: positions.n_content(reads, c)):
        assert sorted(map(str, make(QcConfig(compat=True)).collect())) == sorted(map(str, make(QcConfig(compat=False)).collect()))


def test_key_and_gc_parts(spark):
    sizes = [50, 51, 100, 101, 1000, 1001, 80]
    df = spark.createDataFrame([("A" * n,) for n in sizes], "s string")
    assert [r[0] for r in df.select(F.length(R.duplicate_key(F.col("s")))).collect()] == [50] * 7
    assert [r[0] for r in df.select(F.length(R.duplicate_key(F.col("s"), 100))).collect()] == [50, 50, 50, 100, 100, 100, 50]
    assert [r[0] for r in df.select(F.length(R.gc_part(F.col("s")))).collect()] == [50, 51, 100, 100, 1000, 1000, 80]


def test_contaminants(spark):
    df = spark.createDataFrame(
        [("TTT" + "ACGTACGTTGCAACGTACGTTTGACA"[:20] + "CC",), ("TTT" + "ACGTACGTTGCAACCTACGT" + "CC",), ("G" * 30,), ("CCATG",)],
        "q string"
    )
    source = sequences.possible_source(F.col("q"), [("Tiny", "CATG"), ("Long", "ACGTACGTTGCAACGTACGTTTGACA")])
    assert [r[0] for r in df.select(source).collect()] == ["Long (100%)", "Long (95%)", "No Hit", "Tiny (100%)"]


def test_trimming_runs(spark, tmp_path):
    adapter = "AGATCGGAAGAGC"
    (tmp_path / "a.fastq").write_text(
        "".join(
            f"@r{i}\n{'ACGTACGTAC' * 3 + (adapter if i % 2 else 'TTTTTTTTTTTTG')}\n+\n{'I' * 43}\n" for i in range(6)
        ) + "@s\n" + "N" * 43 + "\n+\n" + "I" * 43 + "\n"
    )
    made = run_trim(spark, [str(tmp_path / "a.fastq")], f"file://{tmp_path}/out", T.TrimConfig(max_n=5, stringency=3, files=("a",)))
    kept = records(spark, made[0])
    assert sorted(len(r.sequence) for r in kept.collect()) == [30] * 3 + [43] * 3
    report = "".join(r.value + "\n" for r in spark.read.text(made[1]).collect())
    assert "Sequences with adapters: 3 (42.9%)" in report and "too many Ns: 1 (14.3%)" in report
    hard = run_trim(spark, [str(tmp_path / "a.fastq")], f"file://{tmp_path}/out", T.TrimConfig(hardtrim3=7, files=("a",)))
    assert {len(r.sequence) for r in records(spark, hard[0]).collect()} == {7}


def test_paired_trimming_counts_both_files(spark, tmp_path):
    adapter = "AGATCGGAAGAGC"
    for name, quality in (("a", "I" * 43), ("b", "I" * 37 + "#" * 6)):
        (tmp_path / f"{name}.fastq").write_text(
            "".join(f"@r{i}\n{'ACGTACGTAC' * 3 + (adapter if i % 2 and name == 'a' else 'TTTTTTTTTTTTG')}\n+\n{quality}\n" for i in range(6))
        )
    files = [str(tmp_path / f"{n}.fastq") for n in "ab"]
    config = T.TrimConfig(
        paired=True, adapter=adapter, retain_unpaired=True, length=35, length_1=20, length_2=35, stringency=3,
        basename="both", files=tuple(files)
    )
    made = run_trim(spark, files, f"file://{tmp_path}/out", config, qc=QcConfig())
    names = [m.rsplit("/", 1)[-1] if isinstance(m, str) else m.name for m in made]
    assert names[:6] == ["both_val_1.fq", "both_unpaired_1.fq", "both_val_2.fq", "both_unpaired_2.fq", "a.fastq_trimming_report.txt", "b.fastq_trimming_report.txt"]
    texts = ["".join(r.value + "\n" for r in spark.read.text(made[k]).collect()) for k in (4, 5)]
    assert "Sequences with adapters: 3 (50.00%)" in texts[0]
    assert "Bases trimmed for quality: 0" in texts[0]
    assert "Bases trimmed for quality: 36" in texts[1]
    assert "Sequences with adapters: 0 (0.00%)" in texts[1]
    assert [records(spark, m).count() for m in made[:4]] == [3, 3, 3, 3]
    assert any(n.endswith(".zip") for n in names[6:])
    assert "no report" not in str(run_trim(spark, files, f"file://{tmp_path}/other", config, report=False))


def test_pairs_of_different_lengths_are_an_error(spark):
    short = frame(spark, ["ACGT"])
    with pytest.raises(Exception, match="different numbers"):
        T.pair_up(short, short.limit(0)).collect()


def test_adapter_detection(spark):
    none = frame(spark, ["ACGT" * 10] * 3)
    assert T.detect_adapter(none)[0] == "AGATCGGAAGAGC"
    assert T.detect_adapter(none, 0)[0] == "X"
    assert T.detect_adapter(frame(spark, ["ACGTCTGTCTCTTATACC"] * 3))[0] == "CTGTCTCTTATA"
    assert T.adapters_for(none, T.TrimConfig(preset="small_rna", paired=True))[1] == "GATCGTCGGACT"
    assert T.least_length("TGGAATTCTCGG", T.TrimConfig()) == 18
    assert T.clip_second(T.TrimConfig(rrbs=True, paired=True)) == 2


def test_written_fastq_is_read_again(spark, tmp_path):
    reads = frame(spark, ["ACGT", "GG"])
    write_fastq(reads, f"file://{tmp_path}/w", gzip=True)
    assert rows(records(spark, f"file://{tmp_path}/w"), "id", "sequence", "quality") == [("@r0", "ACGT", "IIII"), ("@r1", "GG", "II")]


def test_streamed_cube_equals_the_batch(spark, tmp_path):
    from seqloom.schema import READS
    from seqloom.streaming.metrics import cube_stream, current_quality, read_stream

    reads = spark.createDataFrame(frame(spark, ["ACGT" * 5] * 150).rdd, READS)
    reads.repartition(2).write.parquet(f"{tmp_path}/in")
    query = cube_stream(read_stream(spark, f"{tmp_path}/in"), "cube", f"{tmp_path}/ck")
    try:
        query.processAllAvailable()
        streamed = sorted(map(str, current_quality(spark, "cube").collect()))
    finally:
        query.stop()
    from seqloom.operators.common import position_cube

    assert streamed == sorted(map(str, positions.position_quality(position_cube(reads)).collect()))


def test_files_of_equal_names_stay_apart(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.fastq").write_text("".join(f"@r{i}\nACGTACGT\n+\nIIIIIIII\n" for i in range(n)))
    reports = analyse(read_fastq(spark, [str(tmp_path / f / "r.fastq") for f in "ab"]))
    assert [(r.file_name, r.modules[0].data["total_sequences"]) for r in reports] == [("r.fastq", 3), ("r.fastq", 5)]


def test_ordinals_skip_filtered_reads(spark):
    from seqloom.operators.common import BATCH, with_ordinal

    rows = spark.range(5 * BATCH + 100).select(
        F.lit("f").alias("file_name"), F.col("id").alias("read_idx"),
        (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).alias("is_filtered")
    )
    skipped = {r.read_idx for r in rows.where("is_filtered").collect()}
    for compat in (True, False):
        count, want = {}, {}
        for i in range(5 * BATCH + 100):
            w = i // BATCH % 4 if compat else 0
            if i not in skipped:
                want[i] = count[w] = count.get(w, 0) + 1
        for dense in (True, False):
            assert {r.read_idx: r.n for r in with_ordinal(rows, "n", compat, dense=dense).collect()} == want
    none = rows.withColumn("is_filtered", F.lit(False))
    plan = with_ordinal(none, "n", True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert with_ordinal(none, "n", False).where("n <> read_idx + 1").count() == 0


def test_tiles_sampled_and_given_up(spark):
    from seqloom.operators import positions

    def reads(n, tile):
        data = [("f", i, f"S:1:F:1:{tile(i)}:{i}:0", "ACGT", "IIII" if i % 3 else "II#I", None, False) for i in range(n)]
        return spark.createDataFrame(
            data,
            "file_name string, read_idx long, id string, sequence string, quality string, colorspace string, is_filtered boolean"
        )

    config = QcConfig(tile_all=20)
    found = {
        r.tile: r.n for r in positions.tile_sums(
            reads(400, lambda i: 7 + i % 2), config
        ).where("pos = 1").groupBy("tile").agg(F.sum("n").alias("n")).collect()
    }
    picked = [i for i in range(400) if i + 1 <= 20 or (i + 1) % 10 == 0]
    assert found == {t: sum(7 + i % 2 == t for i in picked) for t in {7 + i % 2 for i in picked}}
    assert positions.tile_quality(reads(2501, lambda i: i), QcConfig()).select("tile").distinct().count() == 2501
    assert positions.tile_quality(reads(2502, lambda i: i), QcConfig()).count() == 0
    assert positions.tile_quality(reads(30, lambda i: "x" if i == 29 else 1), QcConfig()).count() == 0


def test_lines_of_any_source_are_records(spark):
    from seqloom.sources.fastq import as_reads, records_of_lines

    lines = ["@a", "ACGT", "+", "IIII", "@b", "GG", "+b", "##"]
    frame_ = spark.createDataFrame([("socket", i, x) for i, x in enumerate(lines)], "path string, line_idx long, value string")
    assert rows(as_reads(records_of_lines(frame_), QcConfig()), "id", "sequence", "quality") == [("a", "ACGT", "IIII"), ("b", "GG", "##")]
    with pytest.raises(Exception, match="no FASTQ record at line 5"):
        records_of_lines(frame_.where("line_idx < 6")).collect()


def test_kmers_are_drawn_and_in_the_json(spark):
    from seqloom.report.figures import figure

    data = [
        (
            "f", i, f"r{i}", ("GATTACA" + "ACGT" * 6) if i % 50 == 49 else "ACGT" * 8,
            "I" * 31 if i % 50 == 49 else "I" * 32, None, False
        ) for i in range(4000)
    ]
    reads = spark.createDataFrame(data, "file_name string, read_idx long, id string, sequence string, quality string, colorspace string, is_filtered boolean")
    config = QcConfig()
    config.limits["kmer", "ignore"] = 0.0
    module = analyse(reads, config)[0].modules[-1]
    top = [r["sequence"] for r in module.data["records"]]
    assert "GATTACA" in top
    assert [x["sequence"] for x in module.data["plot_series"]] == top[:6]
    assert all(len(x["obs_exp"]) == len(module.data["position_groups"]) for x in module.data["plot_series"])
    assert max(module.data["plot_series"][0]["obs_exp"]) == module.data["records"][0]["obs_exp_max"]
    assert figure(module).startswith("<svg")


def test_bzip2_is_read(spark, tmp_path):
    import bz2

    (tmp_path / "r.fastq.bz2").write_bytes(bz2.compress("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(50)).encode()))
    assert read_fastq(spark, str(tmp_path / "r.fastq.bz2")).count() == 50


def test_the_first_file_tells_the_adapter_for_all(spark, tmp_path):
    from seqloom import cli

    for name, adapter in (("a", "CTGTCTCTTATA"), ("b", "AGATCGGAAGAGC")):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@r{i}\n{'ACGTACGTAC' * 3}{adapter}\n+\n{'I' * (30 + len(adapter))}\n" for i in range(6)))
    assert cli.main(["trim", str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq"), "-o", f"file://{tmp_path}/out", "-s", "3"]) == 0
    for name, adapters in (("a", 6), ("b", 0)):
        text = "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/out/{name}.fastq_trimming_report.txt").collect())
        assert "Adapter sequence: 'CTGTCTCTTATA'" in text
        assert f"Sequences with adapters: {adapters} " in text


def test_state_of_a_stream_as_files(spark, tmp_path):
    from seqloom.operators.common import position_cube
    from seqloom.operators.positions import position_quality
    from seqloom.streaming import metrics

    reads = frame(spark, ["ACGT", "GGN", "ACGTAC"])
    for part in (reads.limit(2), reads.exceptAll(reads.limit(2))):
        part.write.mode("append").parquet(f"{tmp_path}/in")
    stream = metrics.cube_files(metrics.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/check")
    stream.processAllAvailable()
    stream.stop()
    assert sorted(map(str, metrics.quality_so_far(spark, f"{tmp_path}/state").collect())) == sorted(map(str, position_quality(position_cube(reads)).collect()))
    late = metrics.windowed_totals(reads.withColumn("came", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("read_idx") * 400)), "came")
    assert sorted(r.reads for r in late.collect()) == [1, 2]
