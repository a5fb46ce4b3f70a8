"""Reads of several lengths in groups of positions: a k-mer's expected count ends where its own positions do."""

import random

import numpy as np
import pytest

from seqloom.config import QcConfig
from seqloom.operators.common import in_groups
from seqloom.operators.sequences import kmer_counts, kmer_enrichment
from seqloom.schema import READS

K, EVERY, MOST = 5, 50, 500


def drawn(seed, n=30_000):
    draw, out = random.Random(seed), []
    for name, longest in (("a", 140), ("b", 620)):
        for i in range(n if name == "a" else n // 3):
            size = draw.choice([0, 2, 40, 77, 101, longest]) if i % 1000 else longest
            letters = "ACGTN" if i % 3 else "ACGTR"
            seq = "".join(draw.choices(letters, weights=[30, 30, 3, 3, 1], k=size))
            out.append((name, i, f"r{i}", seq, "I" * size, None, i % 97 == 0))
    return out


def walked(reads, compat):
    """By file: places' totals, and each k-mer's counts by place, as far as they reach."""
    totals, found, seen = {}, {}, {}
    for name, i, _, seq, _, _, gone in reads:
        if gone:
            continue
        w = i // 4096 % 4 if compat else 0
        seen[name, w] = seen.get((name, w), 0) + 1
        if seen[name, w] % EVERY:
            continue
        s = seq[:MOST]
        for at in range(len(s) - K + 1):
            kmer = s[at : at + K]
            if "N" in kmer:
                continue
            totals.setdefault(name, {})[at] = totals.setdefault(name, {}).get(at, 0) + 1
            own = found.setdefault((name, kmer), {}).setdefault(w, [0] * (len(s) - K + 1))
            own.extend([0] * (at + 1 - len(own)))
            own[at] += 1
    merged = {}
    for key, by in found.items():
        places = [0] * max(map(len, by.values()))
        for own in by.values():
            for at, n in enumerate(own):
                places[at] += n
        merged[key] = places
    return totals, merged


@pytest.mark.parametrize(("compat", "dense"), [(True, True), (False, True), (True, False)])
def test_expected_counts_end_where_places_do(spark, compat, dense):
    reads, config = drawn(compat), QcConfig(kmer_size=K, compat=compat, dense=dense)
    df = spark.createDataFrame(reads, READS).repartition(5).cache()
    totals, merged = walked(reads, compat)
    got = {(r.file_name, r.kmer, r.pos): r.n for r in kmer_counts(df, config).collect()}
    assert got == {(f, x, at + 1): n for (f, x), places in merged.items() for at, n in enumerate(places) if n}
    places = spark.createDataFrame([(f, p) for f, longest in (("a", 136), ("b", 496)) for p in range(1, longest + 1)], "file_name string, pos int")
    groups = {(r.file_name, r.grp): (r.lo, r.hi) for r in in_groups(places, config).collect()}
    f32, cut, want = np.float32, 0, {}
    for (name, kmer), own in merged.items():
        share = f32(sum(own)) / f32(sum(totals[name].values()))
        for (f, grp), (lo, hi) in groups.items():
            hits = sum(own[lo - 1 : hi]) if f == name else 0
            if hits:
                cut += lo <= len(own) < hi
                expected = f32(share * f32(sum(totals[name].get(at, 0) for at in range(lo - 1, min(hi, len(own))))))
                want[name, kmer, grp] = (sum(own), hits, float(f32(hits) / expected))
    rows = kmer_enrichment(df, config).collect()
    found = {(r.file_name, r.kmer, r.grp): (r["count"], r.hits, r.ratio) for r in rows}
    assert cut > 10 and len(rows) == len(found) and found.keys() == want.keys()
    assert all(found[k][:2] == want[k][:2] and found[k][2] == pytest.approx(want[k][2], rel=1e-5) for k in want)
    df.unpersist()
