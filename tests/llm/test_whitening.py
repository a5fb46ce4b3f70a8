"""Operator 11 against a dense eigendecomposition of the whole covariance."""

import numpy as np
import pytest

from seqloom.llm import whitening
from seqloom.llm.shared import work_dir

KIND = "vec_id long, embedding array<float>, label int"


def run(spark, rows, count=32):
    df = spark.createDataFrame(rows, KIND)
    return whitening.components(df, work_dir(spark, "whitening"), count).toPandas()


def expected(rows, count=32):
    """(x, eigenvalues, eigenvectors) of the vectors that count."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows], object)
    n, s = len(x), x.sum(0)
    d = ((n * x - s) / n).astype(float)
    e, w = np.linalg.eigh(d.T @ d / n)
    return x, n, s, d, e[::-1], w[:, ::-1]


def check(found, rows, count):
    x, n, s, d, e, w = expected(rows, count)
    k = min(count, int((e > 1e-9 * e[0]).sum()))
    assert len(found) == n * k and set(found.n) == {n}
    assert found.identity_error.max() <= 1e-8
    for j in range(k):
        own = found[found.component == j + 1].sort_values("vec_id")
        assert own.explained.iloc[0] == pytest.approx(e[j] / e.sum(), rel=1e-9)
        true = d @ w[:, j] / np.sqrt(e[j])
        sign = np.sign(true @ own.whitened.to_numpy())
        assert np.abs(sign * true - own.whitened.to_numpy()).max() < 1e-6
        assert own.deviation.tolist() == [int(v) for v in ((n * x - s) ** 2).sum(1)]


def test_equals_dense(spark):
    draw = np.random.default_rng(3)
    mix = draw.standard_normal((12, 12)) * np.geomspace(1, 0.02, 12)
    rows = [(i, (draw.standard_normal(12) @ mix).astype(np.float32).tolist(), 0) for i in range(300)]
    check(run(spark, rows, 5), rows, 5)
    check(run(spark, rows), rows, 32)


def test_dependent_and_constant_dimensions(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [a, a, 0.5, b, -b, float(i % 2)], 0) for i, (a, b) in enumerate(draw.standard_normal((80, 2)).astype(np.float32).tolist())]
    found = run(spark, rows)
    x, *_, e, w = expected(rows)
    rank = int((e > 1e-9 * e[0]).sum())
    assert rank < 6 and found.component.max() == rank and found.identity_error.max() < 1e-8


def test_repeated_eigenvalues_by_restarts():
    """A product whose operator has each eigenvalue twice: a single Krylov space holds but one of each pair."""
    values = np.repeat([9.0, 4.0, 1.0], 2)
    x = np.diag(np.sqrt(values))

    def product(earlier, y):
        w = x @ y
        return (x @ earlier).T @ w, x.T @ w, float(w @ w)

    right, small = whitening.bidiagonal(product, 6, 4, values.sum())
    assert np.allclose(np.linalg.svd(small)[1][:4] ** 2, [9, 9, 4, 4])
    assert np.allclose(right.T @ right, np.eye(right.shape[1]), atol=1e-12)


def test_edges(spark):
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [], 0), (6, [1.0], 0)]
    good = [(7, [1.0, 2.0], 0), (8, [2.0, 1.0], 0), (8, [2.0, 1.0], 0), (None, [0.5, 0.0], 1)]
    found = run(spark, rows + good)
    assert set(found.n) == {4} and len(found) == 8
    check(run(spark, good[:3] + [(9, [0.5, 0.0], 1)]), good[:3] + [(9, [0.5, 0.0], 1)], 32)
    assert len(run(spark, [])) == 0 and len(run(spark, good[:1])) == 0 and len(run(spark, rows)) == 0


def test_exact_beyond_long():
    f = np.array([[1 << 40, -3], [5, 7]])
    sums = [int(x) for x in f.sum(0)]
    assert whitening.deviations(f, 2, sums) == [None if (v := sum((2 * int(x) - s) ** 2 for x, s in zip(r, sums, strict=True))) >= 1 << 63 else v for r in f]
