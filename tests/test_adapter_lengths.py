"""Adapters of several lengths: a hit counts only where the worker's longest read so far allows it."""

import random

import pytest

from seqloom.config import QcConfig
from seqloom.operators import common
from seqloom.operators.sequences import adapter_places
from seqloom.schema import READS


@pytest.mark.parametrize("span", [1, 1 << 16])
def test_longest_so_far_by_batches_equals_a_walk(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(common, "SPAN", span)
    (tmp_path / "adapters.txt").write_text("short\tGGTT\nlong\tACACACAC\n")
    config = QcConfig(adapters_file=str(tmp_path / "adapters.txt"))
    adapters, draw, reads = [s for _, s in config.adapters], random.Random(span), []
    longest = max(map(len, adapters))
    for name, n in (("a", 40_000), ("b", 300), ("c", 1)):
        for i in range(n):
            size = draw.randint(0, 8 + i // 900)  # later batches have longer reads
            seq = "".join(draw.choices("ACGT", k=size))
            if draw.random() < 0.3:
                seq = seq[: size - 4] + "GGTT" if size >= 4 else seq
            reads.append((name, i, f"r{i}", seq, "I" * size, None, draw.random() < 0.01))
    want, most = {}, {}
    for name, i, _, seq, _, _, gone in reads:
        if gone:
            continue
        w = i // 4096 % 4
        most[name, w] = max(most.get((name, w), 0), len(seq))
        for k, at in [(-1, len(seq)), *((k, seq.find(a)) for k, a in enumerate(adapters))]:
            if k < 0 or 0 <= at <= max(most[name, w] - longest, 0):
                want[name, w, k, at] = want.get((name, w, k, at), 0) + 1
    df = spark.createDataFrame(reads, READS).repartition(5)
    got = {(r.file_name, r.worker, r.adapter, r["at"]): r.n for r in adapter_places(df, config).collect()}
    assert got == want and any(k[2] >= 0 for k in want)
