import math

import numpy as np
import pytest

from seqloom.config import QcConfig, parse_limits, parse_sequences
from seqloom.functions import kernels as K
from seqloom.report.writers import output_base
from seqloom.trim import kernels as T
from seqloom.trim.operators import TrimConfig


def test_groups():
    assert K.base_groups(75) == [(i, i) for i in range(1, 76)]
    assert len(K.base_groups(100)) == 55 and K.base_groups(100)[-1] == (100, 100)
    assert len(K.base_groups(150)) == 38 and K.base_groups(150)[-1] == (150, 150)
    assert len(K.base_groups(30_000)) <= 75
    assert K.base_groups(400, nogroup=True)[-1] == (400, 400)
    wide = K.base_groups(2500, expgroup=True)
    assert wide[9] == (10, 11) and wide[-1][1] == 2500
    assert K.base_groups(5, min_length=8)[-1] == (8, 8)
    assert K.base_groups(0) == []
    for groups in (wide, K.base_groups(1234)):
        assert all(a[1] + 1 == b[0] for a, b in zip(groups, groups[1:], strict=False))


def test_number_text():
    for value, text in (
        (1e-4, "1.0E-4"), (12345678.9, "1.23456789E7"), (100.0, "100.0"), (0.001, "0.001"),
        (float("nan"), "NaN"), (-math.inf, "-Infinity"), (0.0, "0.0")
    ):
        assert K.number_text(value) == text
    assert K.plain_number(5.0) == "5"
    assert K.bases_text(80) == "80 bp" and K.bases_text(1999) == "1.9 kbp" and K.bases_text(1_000_000) == "1 Mbp" and K.bases_text(2_050_000_000) == "2 Gbp"


def test_duplication_slots_and_levels():
    assert [K.duplication_slot(x) for x in (1, 9, 10, 11, 51, 101, 501, 1001, 5001, 10001)] == [0, 8, 9, 9, 10, 11, 12, 13, 14, 15]
    kept, slots = K.duplication_levels([(1, 5), (5, 1)], 10, 10)
    assert kept == 60 and slots[0] == 50 and slots[4] == 50
    assert K.duplication_levels([], 0, 0)[0] == 100


def test_correction_grows_rare_levels():
    assert K.corrected_count(100, 100, 1, 7) == 7
    assert K.corrected_count(100, 10_000, 1, 50) == pytest.approx(50 * 100, rel=0.02)
    assert K.corrected_count(5_000, 10_000, 50, 3) == 3


def test_gc_fit():
    bell = [1000 * math.exp(-((i - 40) ** 2) / 50) for i in range(101)]
    assert K.gc_fit(bell)[1] < 5
    assert K.gc_fit([0.0] * 101)[1] == 0
    assert K.gc_fit([0.0] * 50 + [7.0] + [0.0] * 50)[1] == pytest.approx(100, abs=1)


def test_erfc():
    for x in (-2, -0.5, 0, 0.3, 1, 3):
        assert K.erfc(x) == pytest.approx(math.erfc(x), abs=2e-7)


def test_limits_and_lists(tmp_path):
    assert parse_limits("# no\nkmer ignore 0\nbad line\ntile warn x\ntile error 3") == {("kmer", "ignore"): 0, ("tile", "error"): 3}
    assert parse_sequences("# c\nName one\t\tacgt\nTwo words TTTT\n\n") == [("Name one", "ACGT"), ("Two words", "TTTT")]
    f = tmp_path / "limits"
    f.write_text("tile warn 1\n")
    custom = QcConfig(limits_file=str(f))
    assert custom.limit("tile", "warn") == 1 and custom.limit("quality_sequence", "warn") == 20 and custom.limit("kmer", "ignore") == 0
    assert QcConfig().limit("quality_sequence", "warn") == 27
    with pytest.raises(ValueError):
        QcConfig(nogroup=True, expgroup=True)
    assert output_base("a.fastq.gz") == "a" and output_base("b.bam") == "b"


def quality_by_definition(quality, cutoff):
    total, best, cut = 0, 0, len(quality)
    for i in range(len(quality) - 1, -1, -1):
        total += cutoff - (ord(quality[i]) - 33)
        if total < 0:
            break
        if total > best:
            best, cut = total, i
    return cut


def test_quality_cut():
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(33, 74, n))) for n in rng.integers(0, 40, 200)]
    m, size = T.flat(texts)
    assert T.quality_cut(m, size, 20).tolist() == [quality_by_definition(t, 20) for t in texts]


def adapter_by_definition(read, adapter, rate, overlap):
    """Every alignment's cost and matches by a table for each start."""
    best = (-1, 0, 0)
    m, n = len(adapter), len(read)
    for s in range(n + 1):
        for part in range(max(1, min(overlap, m)), m + 1):
            for e in range(s, n + 1):
                if part < m and e < n:
                    continue
                row = [(j, 0) for j in range(e - s + 1)]
                for i in range(1, part + 1):
                    new = [(i, 0)]
                    for j in range(1, e - s + 1):
                        same = read[s + j - 1] == adapter[i - 1]
                        new.append(min([(row[j - 1][0] + (not same), row[j - 1][1] - same), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])]))
                    row = new
                cost, minus = row[-1]
                if cost <= math.floor(rate * part + 1e-9) and (-minus, -cost, -s) > best:
                    best = (-minus, -cost, -s)
    return len(read) if best[0] < 0 else -best[2]


def test_exact_and_partial_adapters():
    adapter = "AGATCGGAAGAGC"
    reads = ["ACGTTTGC" + adapter + "AAAA", "ACGTTTGCAGATCGG", "CCCCCCCC", "", adapter, "ACGTTTGCAGATCGCAAGAGCTT", "ACGTTTGCAGATGGAAGAGCTT"]
    m, size = T.flat(reads)
    assert T.adapter_cut(m, size, adapter, 0.1, 3).tolist() == [8, 8, 8, 0, 0, 8, 8]


def test_adapter_cut_finds_matches_of_the_definition():
    rng = np.random.default_rng(4)
    reads = ["".join(rng.choice(list("AC"), n)) for n in rng.integers(0, 9, 60)]
    m, size = T.flat(reads)
    got = T.adapter_cut(m, size, "ACCA", 0.0, 2)
    assert got.tolist() == [adapter_by_definition(r, "ACCA", 0.0, 2) for r in reads]


def test_adapter_cut_across_windows(monkeypatch):
    """Windows of few bases, as if reads were long: the same as one table for each whole read."""
    rng = np.random.default_rng(7)
    adapter = "ACGGTNAC"
    plant = lambda r, p: r[:p] + "".join(rng.choice(list(adapter.replace("N", "T"))) if rng.random() < 0.1 else c for c in adapter.replace("N", "G")) + r[p:]
    reads = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(0, 70, 150)]
    reads = [plant(r, int(rng.integers(0, len(r) + 1))) if i % 2 else r for i, r in enumerate(reads)]
    m, size = T.flat(reads)
    for rate, overlap in ((0.0, 1), (0.13, 3), (0.26, 2), (1.0, 1)):
        monkeypatch.setattr(T, "WINDOW", 256)
        whole = T.adapter_cut(m, size, adapter, rate, overlap)
        for window, cells in ((5, 40), (16, 1 << 21)):
            monkeypatch.setattr(T, "WINDOW", window)
            monkeypatch.setattr(T, "CELLS", cells)
            assert T.adapter_cut(m, size, adapter, rate, overlap).tolist() == whole.tolist()
    part = size // 2
    assert T.adapter_cut(m, part, adapter, 0.13, 2).tolist() == T.adapter_cut(*T.flat([r[: len(r) // 2] for r in reads]), adapter, 0.13, 2).tolist()


def test_a_long_read_among_short_ones_takes_memory_for_its_bases_only():
    import resource
    import subprocess
    import sys

    code = """
import resource, numpy as np
from seqloom.trim import kernels as T
rng = np.random.default_rng(1)
reads = ["".join(rng.choice(list("ACGT"), 150)) for _ in range(9_999)] + ["".join(rng.choice(list("ACGT"), 1_000_000))]
reads[-1] = reads[-1][:777_777] + "AGATCGGAAGAGC" + reads[-1][777_777:]
m, size = T.flat(reads)
q, _ = T.flat(["I" * len(r) for r in reads])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert T.quality_cut(q, size, 20).tolist() == size.tolist()
kept = T.adapter_cut(m, size, "AGATCGGAAGAGC", 0.0, 13)
assert kept[-1] == 777_777, kept[-1]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert resource and int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500


def test_odd_texts():
    m, size = T.flat(["é" * 3 + "ACGT", None, "", "ACGT"])
    assert size.tolist() == [7, 0, 0, 4] and T.adapter_cut(m, size, "ACGT", 0.0, 4).tolist() == [3, 0, 0, 0]
    q = T.fitted(T.flat(["II", None, "", "IIIIII"])[0], size)
    assert T.quality_cut(q, size, 20).tolist() == [2, 0, 0, 4]
    import pyarrow as pa

    assert T.first_parts(pa.array(["éab", None, "", "ACGT"]), np.array([2, 3, 1, 3])).to_pylist() == ["éa", None, "", "ACG"]
    assert T.first_parts(pa.array(["Aab", None, "", "ACGT"]), np.array([2, 3, 1, 3])).to_pylist() == ["Aa", None, "", "ACG"]


def test_trim_options():
    for wrong in (
        {"error_rate": 2}, {"adapter": "A", "preset": "nextera"}, {"hardtrim5": 3, "hardtrim3": 3},
        {"hardtrim5": 0}, {"nextseq": 20, "quality": 30}, {"retain_unpaired": True},
        {"paired": True, "files": ("a",)}
    ):
        with pytest.raises(ValueError):
            TrimConfig(**wrong)
