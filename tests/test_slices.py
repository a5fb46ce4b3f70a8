"""Kernels over batches of long reads: memory by slices of a batch, not by the batch."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from seqloom.config import QcConfig
from seqloom.functions import columns
from seqloom.operators import common, fused


def batch(sizes):
    draw = random.Random(3)
    seqs = ["".join(draw.choices("ACGTN", k=50)) * (n // 50) for n in sizes]
    n = len(seqs)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["f"] * n), pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array(seqs),
            pa.array(["I" * len(s) for s in seqs]), pa.nulls(n, pa.string())
        ],
        ["file_name", "read_idx", "is_filtered", "sequence", "quality", "colorspace"],
    )


def walk(kinds):
    return fused.Kernel(QcConfig(), kinds, SimpleNamespace(value={}))


def summed(batches):
    out = {}
    for b in batches:
        for r in b.to_pylist():
            n = r.pop("n")
            key = tuple(r.values())
            out[key] = out.get(key, 0) + n
    return out


def test_memory_doesnt_grow_with_the_batch():
    for kernel in (common._position_counts, walk(("cube", "mean", "gc"))):
        rows = batch([20_000] * 800)  # 16 MB of bases
        tracemalloc.start()
        for _ in kernel(iter([rows])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 160e6


def test_slices_give_the_same_counts(monkeypatch):
    rows = batch([0, 50, 5_000, 100, 0, 900, 50, 20_000, 0])
    for kernel in (common._position_counts, walk(("cube", "gc", "length", "mean"))):
        whole = summed(kernel(iter([rows])))
        with monkeypatch.context() as m:
            m.setattr(columns, "SLICE_BYTES", 300)
            m.setattr(columns, "_MERGED", 10)
            assert summed(kernel(iter([rows]))) == whole and whole


def test_slices_cover_all_rows():
    off = np.array([0, 0, 3 << 20, 3 << 20, (3 << 20) + 5, (4 << 20) + 6, (4 << 20) + 6])
    runs = list(columns.slices(off))
    assert [a for a, _ in runs] + [6] == [0] + [b for _, b in runs]
    assert list(columns.slices(np.zeros(1, np.int64))) == []
