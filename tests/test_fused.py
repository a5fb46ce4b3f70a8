"""One pass for all modules against each module's own operator, on reads that are hard to count."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.config import QcConfig
from seqloom.operators import fused, positions, sequences
from seqloom.plans import qc
from seqloom.schema import READS


def reads(seed, n=5_000, blank=False):
    draw = random.Random(seed)
    rows = []
    for name, letters in (("a.fastq", "ACGTN"), ("b.fastq", "ACGTNRacg")):
        pool = ["".join(draw.choices(letters, k=draw.choice([0, 3, 7, 36, 50, 51, 90, 150, 1200 if draw.random() < 0.05 else 60]))) for _ in range(500)]
        for i in range(n if name == "a.fastq" else n // 3):
            seq = draw.choice(pool)
            seq = seq[:5] + "AGATCGGAAGAG" + seq[5:] if draw.random() < 0.1 else seq
            qual = "".join(chr(draw.randint(35, 74)) for _ in seq)
            if blank and draw.random() < 0.01:
                qual = ""
            elif not blank and not seq:
                seq, qual = "A", "I"
            where = f"SIM:1:FC:1:{1101 + draw.randint(0, 3)}:{i}:9 1:N" if name == "a.fastq" else f"M:1:{draw.randint(1, 3)}:4:5"
            rows.append((name, i, where, seq, qual, "T01" if name == "b.fastq" else None, draw.random() < 0.05))
    rows.append(("c.fastq", 0, "x", "ACGT", "IIII", None, True))  # a file all of whose reads are filtered
    draw.shuffle(rows)
    return rows


def tables(frames):
    def norm(v):
        return None if v is None else ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v

    return {k: sorted(map(str, (tuple(norm(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))) for k, df in ((k, make()) for k, make in frames.items())}


def run(df, config, monkeypatch, one_pass):
    with monkeypatch.context() as m:
        if not one_pass:
            m.setattr(fused, "skips", lambda _: None)
        frames, held = qc.frames_of(df, config)
        out = tables(frames)
        for h in held:
            h.unpersist()
    return out


@pytest.mark.parametrize("options", [{"compat": True, "unique_cap": 400, "tile_all": 30}, {"compat": False, "dup_length": 40, "kmer_size": 3}])
def test_equals_the_modules(spark, monkeypatch, options):
    df = spark.createDataFrame(reads(1), READS).repartition(5)  # c.fastq has no tiles
    config = QcConfig(keep_reads=False, **options)
    config.limits["kmer", "ignore"] = 0
    a, b = (run(df, config, monkeypatch, one) for one in (True, False))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k], k
    assert a["tile"] and a["kmer_groups"] and len(a["basic"]) == 3


def test_reads_without_qualities_and_adapters_of_several_lengths(spark, monkeypatch):
    df = spark.createDataFrame(reads(2, 3_000, blank=True), READS).repartition(3)
    config = QcConfig(keep_reads=False)
    object.__setattr__(config, "adapters", [*config.adapters[:2], ("Short", "ACGTA")])
    a, b = (run(df, config, monkeypatch, one) for one in (True, False))
    for k in a:
        assert a[k] == b[k], k


def test_the_reads_are_scanned_once(spark, monkeypatch):
    df = spark.createDataFrame(reads(3, 300), READS).where("file_name <> 'c.fastq'").withColumn("is_filtered", F.lit(False))
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    watched = df.mapInArrow(watch, df.schema).withColumn("is_filtered", F.lit(False))
    qc.collect(watched, QcConfig(keep_reads=False))
    assert seen.value == df.count()


def test_keys_behind_the_cap_are_dropped_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(fused, "KEY_SPAN", 64)
    draw = random.Random(9)
    rows = [("f", i, "x", f"ACGT{'ACGT'[i % 4] * (1 + draw.randint(0, 900) // 30)}" if i < 400 else "".join(draw.choices("ACGT", k=30)), "I", None, i % 7 == 0) for i in range(6_000)]
    rows += [("f", 6_000 + i, "x", rows[i][3], "I", None, False) for i in range(500)]
    df = spark.createDataFrame(rows, READS).repartitionByRange(4, "read_idx")
    config = QcConfig(unique_cap=300, keep_reads=False)
    one = fused.Fused(df, config, fused.skips(df), ("basic", "key"))
    got = one.keys()
    want = sequences.key_counts(df, config)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    one.close()


def test_too_many_filtered_reads_to_travel(spark, monkeypatch):
    df = spark.createDataFrame(reads(4, 200), READS)
    monkeypatch.setattr(fused, "SKIPS_MOST", 3)
    assert fused.skips(df) is None
    assert qc.analyse(df, QcConfig(keep_reads=False))


def by_workers(rows, tile_all):
    """Tiles' sums by definition: each worker in order, giving up on its own; the first worker's giving up holds for the file."""
    sums, gone = {}, False
    for w in range(4):
        own, count, field, given_up = {}, 0, None, False
        for idx, name, quality in sorted(r for r in rows if r[0] // 4096 % 4 == w):
            if not quality or given_up:
                continue
            count += 1
            if count > tile_all and count % 10:
                continue
            parts = name.split(":")
            field = field if field is not None else 4 if len(parts) >= 7 else 2 if len(parts) >= 5 else 99
            try:
                tile = int(parts[field])
            except (IndexError, ValueError):
                given_up = True
                continue
            if tile not in own and len(own) > 2_500:
                own, given_up = {}, True
                continue
            for i, c in enumerate(quality):
                n, s = own.setdefault(tile, {}).get(i, (0, 0))
                own[tile][i] = (n + 1, s + ord(c))
        gone |= given_up and w == 0
        for tile, places in own.items():
            for i, (n, s) in places.items():
                a, b = sums.get((tile, i + 1), (0, 0))
                sums[tile, i + 1] = (a + n, b + s)
    return {} if gone else sums


@pytest.mark.parametrize("bad", [None, (4_096 * 1 + 50, "no tile"), (4_096 * 5 + 3, "A:1:F:1:xx:2:3"), (7, "A:1"), (4_096 * 2, "A:1:7:4:5"), "many", "many in the first"])
def test_a_worker_gives_up_tiles_on_its_own(spark, bad):
    draw = random.Random(6)
    rows = []
    for i in range(4_096 * 6):
        w = i // 4096 % 4
        wide = 3_000 if (bad == "many" and w == 2) or (bad == "many in the first" and w == 0) else 3
        rows.append((i, f"S:1:F:1:{1101 + i % wide}:{i}:2", "".join(chr(draw.randint(40, 70)) for _ in range(3))))
    if isinstance(bad, tuple):
        rows[bad[0]] = (bad[0], bad[1], "III")
    df = spark.createDataFrame([("f", i, name, "ACG", q, None, False) for i, name, q in rows], READS).repartition(4)
    config = QcConfig(tile_all=200_000 if isinstance(bad, str) else 300, keep_reads=False)
    want = by_workers(rows, config.tile_all)
    got = positions.tile_sums(df, config).groupBy("tile", "pos").agg(F.sum("n"), F.sum("s")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want
    one = fused.Fused(df, config, {}, ("basic", "tile"))
    quick = one.tiles()
    assert (quick is None) == (bad is not None)
    if quick is not None:
        got = quick.groupBy("tile", "pos").agg(F.sum("n"), F.sum("s")).collect()
        assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want
    one.close()
