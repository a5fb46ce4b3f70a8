from collections import Counter

import pytest

from seqloom import queries as Q
from seqloom.functions.kernels import base_groups, label

TEXTS = ["Acgt n GATTACA.\n" * 437, "gC" * 1600 + "é日 t", "short one", "", None, "x" * 3999 + "G"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def bases():
    table = dict(zip(Q.LETTERS, Q.BASES, strict=True))
    return ["".join(table.get(c, "N") for c in t) for t in TEXTS if t]


def test_long_reads_are_whole_texts(spark, folder):
    assert sorted(r.sequence for r in Q.long_reads(spark, folder).collect()) == sorted(bases())


def test_long_read_queries_equal_brute_force(spark, folder):
    reads = bases()
    longest = max(map(len, reads))
    assert longest > 2000
    want = {}
    for lo, hi in base_groups(longest):
        n = Counter(c for s in reads for c in s[lo - 1 : hi])
        total = sum(n[b] for b in "GATC")
        want[label(lo, hi)] = tuple(round(n[b] * 100 / total, 6) if total else 0 for b in "GATC")
    assert {r[0]: tuple(round(x, 6) for x in r[1:]) for r in Q.per_base_content_grouped(spark, folder).collect()} == want

    part = lambda s: s[: len(s) // 1000 * 1000] if len(s) > 1000 else s[: len(s) // 100 * 100] if len(s) > 100 else s
    want = Counter((len(p), p.count("G") + p.count("C")) for p in map(part, reads))
    assert {(r.len, r.gc): r.n for r in Q.gc_counts(spark, folder).collect()} == want

    found = [(*map(int, r.label.split("-")), r.n) for r in Q.length_distribution_wide(spark, folder).where("n > 0").collect()]
    assert all(x[-1] == sum(x[0] <= n <= x[-2] for n in map(len, reads)) for x in found)
    assert sum(x[-1] for x in found) == len(reads)
    assert max(x[-2] for x in found) == longest
