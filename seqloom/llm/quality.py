"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Each feature of a text falls into one of a few bins.  Boosting goes round the features again and again; each time a shallow
tree over one feature's bins is fitted to the logistic loss's gradients and, shrunk, added to that feature's lookup table.
Then pairs of features whose trees lower the loss most get tables of their own in the same way.  A score is the logistic of
the intercept and the tables' entries at a text's bins: vectorised additions, no tree is kept.

Training uses at most ``max_rows`` labelled texts (a documented bound; 20,000 rows of some thirty numbers reach the driver);
scoring reads every whole text, in one pass without a shuffle.  Labels, language, source and ids are never features.

Edge cases: a null or empty text has features 0 and gets a score like any other; without labels, or with one class only, the
score is the (smoothed) share of label 1; repeated rows repeat (in training, a repeated doc_id counts once); a null doc_id is scored
and never learned from; very long texts are read whole; ties have equal scores; an empty table gives no rows; other columns are
ignored by score() and kept, whatever their names, by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, column_bytes, mix, slices, span_hashes, word_bounds
from .labelled import sample

SCORED = "doc_id long, score double"
KINDS = 12
_kind = np.zeros(256, np.uint8)
_kind[97:123] = 1
_kind[65:91] = 2
_kind[48:58] = 3
_kind[SPACE] = 4
_kind[10] = 5
_kind[128:] = 6
_kind[[ord(c) for c in "|\\/_=<>{}[]"]] = 7
_kind[[ord(c) for c in "#$%&*@^~+"]] = 8
_kind[[ord(c) for c in "!?"]] = 9
_kind[[ord(c) for c in ".,;:"]] = 10
_kind[[i for i in range(32) if not SPACE[i]] + [127]] = 11
NAMES = [
    *(
        "log_bytes", "log_words", "lower", "upper", "digits", "blanks", "newlines", "beyond_ascii", "bars",
        "symbols", "shouts", "stops", "controls", "other_marks"
    ),
    *(
        "word_size", "word_size_spread", "long_words", "short_words", "distinct", "distinct_pairs",
        "top_share", "repeated_next", "upper_words", "marked_words", "stop_words", "words_a_line",
        "word_after_mark"
    ),
]


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of len(NAMES) numbers for each text."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)), np.float64)
    size = np.diff(off)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), size)
    kinds = _kind[raw]
    counts = np.bincount(row * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    share = counts / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    out[:, 2:14] = share[:, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0]]
    starts, ends, rows, low = word_bounds(raw, off)
    if not len(starts):
        return out
    h = span_hashes(low, starts, ends)
    words = np.bincount(rows, minlength=n)
    per = np.maximum(words, 1)
    length = ends - starts
    mean = lambda x: np.bincount(rows, weights=x, minlength=n) / per
    out[:, 1] = np.log1p(words)
    out[:, 14] = mean(length)
    out[:, 15] = np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - out[:, 14] ** 2))
    out[:, 16] = mean(length > 12)
    out[:, 17] = mean(length <= 3)
    key = mix(h + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, many = np.unique(key, return_index=True, return_counts=True)
    out[:, 18] = np.bincount(rows[first], minlength=n) / per
    top = np.zeros(n)
    np.maximum.at(top, rows[first], many)
    out[:, 20] = top / per
    same = rows[1:] == rows[:-1]
    pair_rows = rows[1:][same]
    if len(pair_rows):
        pairs = mix(key[:-1][same] * np.uint64(3) + key[1:][same])
        pair_first = np.unique(pairs, return_index=True)[1]
        out[:, 19] = np.bincount(pair_rows[pair_first], minlength=n) / np.maximum(np.bincount(pair_rows, minlength=n), 1)
        out[:, 21] = np.bincount(pair_rows, weights=h[1:][same] == h[:-1][same], minlength=n) / per
    first_kind, last_kind = kinds[starts], kinds[ends - 1]
    out[:, 22] = mean((last_kind == 2) & (first_kind == 2))
    out[:, 23] = mean((last_kind == 7) | (last_kind == 8) | (last_kind == 9))
    out[:, 24] = mean((last_kind == 10))
    out[:, 25] = np.log1p(words / (counts[:, 5] + 1))
    alone = (length == 1) & (kinds[starts] != 1) & (kinds[starts] != 2) & (kinds[starts] != 3)
    out[:, 26] = mean(alone)
    return out


@dataclass
class AdditiveModel:
    """Lookup tables: one for each feature, and one for each chosen pair of features (on coarser bins)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over ordered bins: Newton steps for each bin."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], int(at[k])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _corner(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of depth two over a pair's bins: one cut on the first feature, one on the second within each half."""
    best, found = 0.0, np.zeros(g.shape)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for cut in range(1, g.shape[0]):
        gain, table = -whole, np.zeros(g.shape)
        for part in (slice(0, cut), slice(cut, None)):
            pg, ph = np.cumsum(g[part].sum(0)), np.cumsum(h[part].sum(0))
            worth = pg[:-1] ** 2 / (ph[:-1] + ridge) + (pg[-1] - pg[:-1]) ** 2 / (ph[-1] - ph[:-1] + ridge)
            if not len(worth):
                return found, 0.0
            k = int(worth.argmax())
            gain += worth[k]
            table[part, : k + 1] = pg[k] / (ph[k] + ridge)
            table[part, k + 1 :] = (pg[-1] - pg[k]) / (ph[-1] - ph[k] + ridge)
        if gain > best:
            best, found = gain, table
    return found, best


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, leaves: int = 3,
    n_pairs: int = 4, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 4.0
) -> AdditiveModel:
    """Cyclic boosting; with no rows or one class the model is its intercept."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    f = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(f)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    raw = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(f):
            g, h = slopes()
            step = rate * _steps(np.bincount(at[j], g, len(model.tables[j])), np.bincount(at[j], h, len(model.tables[j])), leaves, ridge)
            model.tables[j] += step
            raw += step[at[j]]
    model.pair_edges = [_edges(x[:, j], pair_bins) for j in range(f)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * width[j] + coarse[j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slopes()
    gains = sorted(((_corner(grid(i, j, g), grid(i, j, h), ridge)[1], i, j) for i in range(f) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _corner(grid(i, j, g), grid(i, j, h), ridge)[0]
            model.pair_tables[k] += step
            raw += step[coarse[i], coarse[j]]
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        x = np.concatenate([features(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off)]) if len(off) > 1 else np.zeros((0, len(NAMES)))
        yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["label", *NAMES])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, out: int = 0, max_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents outside the fold ``out``."""
    rows = sample(docs, labels, label, modulus, out, max_rows).select("label", "text").mapInArrow(
        _rows, "label int, " + ", ".join(f"{n} double" for n in NAMES)
    ).toPandas()
    rows = rows.sort_values([*rows.columns])  # the order of tasks must not matter
    return fit(rows[NAMES].to_numpy(), rows["label"].to_numpy(np.float64))


def _score(batches: Iterator[pa.RecordBatch], model: AdditiveModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        out = [model.score(features(raw[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in slices(off)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of every document; the tables are a few thousand numbers and travel with the tasks."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cols.mapInArrow(partial(_score, model=model), SCORED)


def _keep(batches: Iterator[pa.RecordBatch], model: AdditiveModel, least: float, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = column_bytes(batch.column(text))
        out = [model.score(features(raw[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in slices(off)]
        if out:
            yield batch.filter(pa.array(np.concatenate(out) >= least))


def keep(docs: DataFrame, model: AdditiveModel, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that score at least ``least``."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots can't be handed to Python
    return plain.mapInArrow(partial(_keep, model=model, least=least, text=docs.columns.index("text")), plain.schema).toDF(*docs.columns)
