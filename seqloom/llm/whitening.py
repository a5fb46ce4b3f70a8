"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 11).

The rows are whole numbers (a grid of entries), so their sums and each row's squared distance from the mean are exact.  Rows are
centred before anything is multiplied.  A step takes one pass over the rows: each task multiplies its centred rows by the new
right vector (Xv, corrected for the left vectors before it) and, with the same rows in hand, by the left vector so found (X'u);
only these products are added up.  A left vector is as long as the table and never stored: it is X times a short vector, from
which any task gets its own part again.  Both sides are reorthogonalised against all earlier vectors; where that takes away more
than rounding, the pass is made again.  The singular values and right vectors of the small bidiagonal matrix give the deviations
and the components.

Where a step meets an invariant subspace (an eigenvalue that occurs several times, dimensions that depend on each other), it goes
on with a fresh vector orthogonal to all before it.  It ends when what is left of the trace is less than the last component
wanted, so that none can be missed, or with as many steps as there are dimensions.

Edge cases: a row whose vector is null, empty, or holds a null or an entry that isn't finite is left out, and so is one whose
length isn't the commonest (of several the greatest); equal rows count as often as they are there; a null id is kept; ties of
eigenvalues come in either order; components without spread (fewer rows than components, dependent dimensions) aren't given, so
that a table of one row, or none, gives no rows; an exact deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

GRID, SHIFT = 64, 1_000_000  # an entry c stands for floor(GRID * c) + SHIFT; the shift cancels in all that is centred
LEAST_SPREAD = 1e-9  # of the greatest deviation; below it a component has none
LOW = (1 << 32) - 1


def usable(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, f): whole numbers floor(GRID * c) of the vectors that count."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).alias("key"), F.when(good, F.transform(v, lambda x: F.floor(x * GRID).cast("long"))).alias("f"))
    return rows.where(F.col("f").isNotNull())


def _rows(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    """The batch's vectors as a matrix of whole numbers."""
    column = batch.column("f")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), wide)


def _pieces(values: np.ndarray, kind: type = np.float64) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(kind))], ["at", "value"])


def _whole_sums(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Each task's number of rows and sums, in a high and a low part so that none overflows."""
    total = np.zeros(2 * wide + 1, np.int64)
    for batch in batches:
        f = _rows(batch, wide)
        total[0] += len(f)
        total[1 : wide + 1] += (f >> 32).sum(0)
        total[wide + 1 :] += (f & LOW).sum(0)
    yield _pieces(total, np.int64)


def centred(f: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean, by whole numbers where these fit."""
    if n * max(int(np.abs(f).max(initial=0)), 1) + max(map(abs, sums)) < 1 << 62:
        return (n * f - np.array(sums, np.int64)) / n
    return f - np.array([s / n for s in sums])


def deviations(f: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum over dimensions of (n * x - S) ** 2."""
    s = np.array([float(x) for x in sums])
    if (np.square(np.abs(f.astype(np.float64)) * n + np.abs(s)).sum(1).max(initial=0)) < float(1 << 62):
        return np.square(n * f - np.array(sums, np.int64)).sum(1).tolist()
    exact = [sum((n * x - y) ** 2 for x, y in zip(row, sums, strict=True)) for row in f.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def _products(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], shared) -> Iterator[pa.RecordBatch]:
    """Of w = X y, y being the last vector: its products with the earlier left vectors, X'w and w'w."""
    earlier, y = shared.value
    total = np.zeros(earlier.shape[1] + len(y) + 1)
    for batch in batches:
        x = centred(_rows(batch, len(y)), n, sums)
        w = x @ y
        total += np.concatenate([(x @ earlier).T @ w, x.T @ w, [w @ w]])
    yield _pieces(total)


def _spread(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for batch in batches:
        total += float(np.square(centred(_rows(batch, len(sums)), n, sums)).sum())
    yield _pieces(np.array([total]))


def bidiagonal(product: Callable, wide: int, want: int, spread: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors as columns, bidiagonal matrix): ``product(earlier, y)`` makes one pass over the rows; ``spread`` is the sum
    of all squares of the centred rows."""
    draw = np.random.default_rng(seed)
    noise = 1e-13 * np.sqrt(spread)
    right, left, images = np.zeros((wide, 0)), np.zeros((wide, 0)), np.zeros((wide, 0))  # v; y with u = X y; X'u
    alpha, beta = [], []

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = orthogonal(draw.standard_normal(wide))
        return v / np.linalg.norm(v)

    v = fresh()
    while True:
        right = np.column_stack([right, v])
        y = v - beta[-1] * left[:, -1] if beta else v
        for _ in range(4):
            along, image, square = product(left, y)
            y, image, rest = y - left @ along, image - images @ along, square - along @ along
            if along @ along <= 1e-8 * square:
                break
        a = np.sqrt(max(rest, 0.0))
        a = a if a > noise else 0.0
        alpha.append(a)
        left = np.column_stack([left, y / a if a else np.zeros(wide)])
        images = np.column_stack([images, image / a if a else np.zeros(wide)])
        next_v = orthogonal(images[:, -1] - a * v)
        b = np.linalg.norm(next_v)
        if len(alpha) == wide:
            break
        open_ = a > 0 and b > noise
        small = np.diag(alpha) + np.diag(beta, 1)
        p, s, _ = np.linalg.svd(small)
        if len(alpha) >= want and (not open_ or (b * np.abs(p[-1, :want]) <= 1e-12 * s[0]).all()) and spread - (s**2).sum() < s[want - 1] ** 2 * (1 - 1e-9):
            break
        if spread - (s**2).sum() <= noise**2:
            break
        beta.append(b if open_ else 0.0)
        v = next_v / b if open_ else fresh()
    return right, np.diag(alpha) + np.diag(beta, 1)


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of floor(GRID * c), a dimension each
    vectors: np.ndarray  # a column for each component, by falling eigenvalue
    values: np.ndarray  # eigenvalues of the covariance
    trace: float

    def whiten(self, f: np.ndarray) -> np.ndarray:
        return centred(f, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def _add_up(rows: DataFrame, kernel: Callable, kind: str = "double") -> list:
    """One pass: what the tasks add up for each place, in order."""
    found = rows.select("f").mapInArrow(kernel, f"at int, value {kind}").groupBy("at")
    total = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "long" else F.sum("value")
    return [r[1] for r in sorted(found.agg(total).collect())]


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """``rows`` (f) have vectors of one length and are read once a step: a written table.  None if there are none."""
    one = rows.select(F.size("f").alias("wide")).first()
    if one is None:
        return None
    wide = one.wide
    whole = [int(x) for x in _add_up(rows, partial(_whole_sums, wide=wide), "long")]
    n, sums = whole[0], [(h << 32) + low for h, low in zip(whole[1 : wide + 1], whole[wide + 1 :], strict=True)]
    spread = _add_up(rows, partial(_spread, n=n, sums=sums))[0]
    if not spread > 0:
        return Whitening(n, sums, np.zeros((wide, 0)), np.zeros(0), 0.0)
    context = rows.sparkSession.sparkContext

    def product(earlier: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        shared = context.broadcast((earlier, y))  # as many short vectors as steps so far
        out = np.array(_add_up(rows, partial(_products, n=n, sums=sums, shared=shared)))
        shared.destroy()
        return out[: earlier.shape[1]], out[earlier.shape[1] : -1], out[-1]

    right, small = bidiagonal(product, wide, min(components, wide), spread)
    _, s, q = np.linalg.svd(small)
    some = s[:components] > LEAST_SPREAD * s[0]
    vectors = (right @ q.T)[:, : len(some)][:, some]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])  # the greatest entry is positive
    return Whitening(n, sums, vectors, s[:components][some] ** 2 / n, spread / n)


def _second_moments(batches: Iterator[pa.RecordBatch], model: Whitening, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    total = np.zeros(k if mean is None else k * k)
    for batch in batches:
        w = model.whiten(_rows(batch, len(model.sums)))
        total += w.sum(0) if mean is None else ((w - mean).T @ (w - mean)).ravel()
    yield _pieces(total)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the whitened rows' covariance less the identity: two more passes."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = np.array(_add_up(rows, partial(_second_moments, model=model, mean=None))) / model.n
    cov = np.array(_add_up(rows, partial(_second_moments, model=model, mean=mean))).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = _rows(batch, len(model.sums))
        w = model.whiten(f)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(deviations(f, model.n, model.sums), pa.int64()), flat], ["key", "deviation", "whitened"])


def prepare(df: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The vectors that count, of the commonest length, written to ``path``."""
    rows = stage(usable(df, vector, key), path)
    common = rows.groupBy(F.size("f").alias("wide")).count().orderBy(F.desc("count"), F.desc("wide")).first()
    return rows.where(F.size("f") == common.wide) if common else rows


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(key, deviation, whitened): an array of the components' values for each row."""
    if model is None or not len(model.values):
        return rows.select("key", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    return rows.select("key", "f").mapInArrow(partial(_whitened, model=model), f"key {rows.schema['key'].dataType.simpleString()}, deviation long, whitened array<double>")


def components(df: DataFrame, path: str, count: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = prepare(df, path, vector, key)
    model = fit(rows, count)
    error = identity_error(rows, model) if model else 0.0
    out = transform(rows, model).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(e / model.trace) for e in model.values] if model and len(model.values) else [0.0]
    return out.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", F.get(F.lit(shares), F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
