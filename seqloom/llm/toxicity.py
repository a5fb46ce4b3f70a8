"""Toxicity by class-conditional Kneser-Ney models (operator 10).

Two word models, one of toxic and one of ordinary labelled texts, interpolated and discounted.  The upper level is the
probability of a word after the word before it, by counts of pairs; its weight for the lower level is the context's own.  The
lower level counts continuations: in how many different contexts of the class a word occurs.  The lowest level is one for both
classes, by the pooled continuations, so that a rare expression has the same share in both and doesn't tell.

Discounts of either level follow from its counts of counts, for things seen once, twice and more often, and lie below the count
that they are taken from: every pair and every word keeps a share.

A text's signals are the differences of the two log-likelihoods divided by length: over the whole text, and the highest ones over
passages of some words, each by both levels and by the lower one alone.  A logistic calibrated on labelled texts turns them into a
probability.  So that these texts are new to the models, they are dealt into FOLDS parts, and
each part is seen by models without it, whose counts come from the same aggregation; the final models have all parts.

Training uses at most ``max_rows`` labelled texts of each class (a documented bound).  Pairs are counted by exact keys (64-bit
hashes, no slots) in Spark; what comes to the driver and is broadcast has a row for each distinct pair of the sample.

Edge cases: a null or empty text has differences of 0; with one class or no labels every score is the share of label 1,
smoothed; repeated rows repeat (in training, a repeated doc_id counts once); a null doc_id is scored and never learned from; very
long texts are scored whole; ties have equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, column_bytes, join_hashes, slices, span_hashes, word_bounds
from .labelled import sample

SCORED = "doc_id long, score double"
WINDOWS = (1, 2, 4, 8, 16, 32, 64, 128)
SIGNALS = 2 * len(WINDOWS) + 1
FOLDS = 3
_mark = np.zeros(256, bool)
_mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def text_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words (without marks around them) and of the words before (0: none), and the words of each text."""
    n = np.zeros(len(off) - 1, np.int64)
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, U), n
    starts, ends, rows, low = word_bounds(raw, off)
    for _ in range(4):
        ends = ends - ((ends - starts > 1) & _mark[low[ends - 1]])
        starts = starts + ((ends - starts > 1) & _mark[low[np.minimum(starts, len(low) - 1)]])
    n = np.bincount(rows, minlength=len(n)).astype(np.int64)
    h = span_hashes(low, starts, ends)
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    return h, before, n


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and more, by the numbers of counts 1 to 4; where one of these is missing, a half of the
    count, three at most."""
    seen = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].astype(np.float64)
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if seen.all():
        y = seen[0] / (seen[0] + 2 * seen[1])
        out[1:] = np.clip([k - (k + 1) * y * seen[k] / seen[k - 1] for k in (1, 2, 3)], 0.05, [0.95, 1.95, 2.95])
    return out


def kept_of(n: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return n - discounts(n)[np.minimum(n, 3).astype(np.int64)]


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Frame:
    """The sample's pairs, words and words before, sorted; all folds' models share it."""

    pairs: np.ndarray  # keys of (word before, word)
    words: np.ndarray
    contexts: np.ndarray
    of_word: np.ndarray  # of each pair
    of_context: np.ndarray

    @classmethod
    def of(cls, before: np.ndarray, h: np.ndarray) -> tuple[Frame, np.ndarray]:
        """The frame, and the order of its pairs."""
        keys = join_hashes([before, h])
        order = np.argsort(keys)
        words, of_word = np.unique(h[order], return_inverse=True)
        contexts, of_context = np.unique(before[order], return_inverse=True)
        return cls(keys[order], words, contexts, of_word.astype(np.int32), of_context.astype(np.int32)), order


@dataclass
class ClassModels:
    """The two models' tables; row 0 ordinary, row 1 toxic."""

    words: np.ndarray  # sorted
    kept: np.ndarray  # (2, words): discounted shares of the continuations
    rest: np.ndarray  # (2,): weight of the lowest level
    shared: np.ndarray  # (words,): the lowest level
    other: float  # the lowest level's share of a word that isn't in the table
    pairs: np.ndarray  # sorted keys of (word before, word)
    pair_kept: np.ndarray  # (2, pairs)
    contexts: np.ndarray  # sorted words before
    context_rest: np.ndarray  # (2, contexts): weight of the lower level

    @classmethod
    def build(cls, frame: Frame, n: list[np.ndarray]) -> ClassModels:
        """``n``: both classes' counts of pairs in the frame's order."""
        size = len(frame.contexts)
        pair_kept, context_rest = np.zeros((2, len(frame.pairs)), np.float32), np.zeros((2, size))
        for c in (0, 1):  # the longest columns: one class at a time
            contexts = np.maximum(np.bincount(frame.of_context, n[c], size), 1)
            own = kept_of(n[c]) / contexts[frame.of_context]
            context_rest[c] = 1 - np.bincount(frame.of_context, own, size)
            pair_kept[c] = own
        follows = np.stack([np.bincount(frame.of_word, n[c] > 0, len(frame.words)) for c in (0, 1)])
        kept = np.stack([kept_of(f) / max(f.sum(), 1) for f in follows])
        pooled = follows.sum(0)
        total = max(pooled.sum(), 1)
        stays = kept_of(pooled)
        other = max(total - stays.sum(), 1) / total / ((pooled > 0).sum() + 1)
        small = lambda x: x.astype(np.float32)
        return cls(
            frame.words, small(kept), 1 - kept.sum(1), small(stays / total + other), float(other), frame.pairs, pair_kept, frame.contexts, small(context_rest)
        )

    def differences(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | toxic) - log P(word | ordinary) for each word: of the lower level, and of the upper one."""
        at, there = _place(self.words, h)
        p = np.broadcast_to(self.other * self.rest[:, None], (2, len(h))).astype(np.float64)
        p[:, there] = self.kept[:, at[there]] + self.rest[:, None] * self.shared[at[there]]
        lower = np.log(p[1]) - np.log(p[0])
        at, there = _place(self.contexts, before)
        p[:, there] *= self.context_rest[:, at[there]]
        at, there = _place(self.pairs, join_hashes([before, h]))
        p[:, there] += self.pair_kept[:, at[there]]
        return lower, np.log(p[1]) - np.log(p[0])

    def signals(self, h: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each text: the mean difference, and the highest means over passages of WINDOWS words, by both levels and by the
        lower one (a shorter text's passage is filled up with words that don't tell)."""
        out = np.zeros((len(n), SIGNALS))
        if not len(h):
            return out
        lower, upper = self.differences(h, before)
        start = np.cumsum(n) - n
        some = np.flatnonzero(n)
        out[some, 0] = np.add.reduceat(upper, start[some]) / n[some]
        first, place = np.repeat(start, n), np.arange(len(h))
        for j, level in enumerate((lower, upper)):
            total = np.concatenate([[0.0], np.cumsum(level)])
            for k, width in enumerate(WINDOWS):
                mean = (total[place + 1] - total[np.maximum(place + 1 - width, first)]) / width
                out[some, 1 + j * len(WINDOWS) + k] = np.maximum.reduceat(mean, start[some])
        return out


@dataclass
class Scorer:
    models: ClassModels | None
    weights: np.ndarray  # of the signals, the last one alone
    mean: np.ndarray
    spread: np.ndarray

    def score(self, h: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.zeros((len(n), SIGNALS)) if self.models is None else (self.models.signals(h, before, n) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of words of each text, counted within it."""
    names = ["label", "fold", "before", "h", "n"]
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        for k, (label, fold) in enumerate(zip(batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
            h, before, _ = text_words(raw[off[k] : off[k + 1]], off[k : k + 2] - off[k])
            both = np.stack([before, h], 1).view([("b", U), ("h", U)]).ravel()
            own, many = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(own), label, np.int32)), pa.array(np.full(len(own), fold, np.int32)),
                    pa.array(own["b"].view(np.int64) if len(own) else np.zeros(0, np.int64)),
                    pa.array(np.ascontiguousarray(own["h"]).view(np.int64)), pa.array(many)
                ],
                names
            )


def _signals(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Each calibrating text's signals by the models without its fold."""
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        x = np.zeros((batch.num_rows, SIGNALS))
        for k, fold in enumerate(batch.column("fold").to_pylist()):
            x[k] = models.value[fold].signals(*text_words(raw[off[k] : off[k + 1]], off[k : k + 2] - off[k]))[0]
        yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in x.T)], ["label", *(f"s{k}" for k in range(SIGNALS))])


def _models(pairs: DataFrame) -> list[ClassModels]:
    """The models without each fold, and those of all."""
    of = lambda c, f: F.sum(F.when((F.col("label") == c) & (F.col("fold") != f), F.col("n")).otherwise(0)).cast("int")
    every = [(c, f) for f in range(FOLDS + 1) for c in (0, 1)]  # no text is in the last fold
    table = pairs.groupBy("before", "h").agg(*(of(c, f).alias(f"n{c}_{f}") for c, f in every)).toArrow()
    frame, order = Frame.of(*(table[c].to_numpy().view(U) for c in ("before", "h")))
    counts = [[table[f"n{c}_{f}"].to_numpy()[order] for c in (0, 1)] for f in range(FOLDS + 1)]
    del table, order
    return [ClassModels.build(frame, n) for n in counts]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, out: int = 0, max_rows: int = 2_000) -> Scorer:
    """Fit on at most ``max_rows`` labelled documents of each class, outside the fold ``out``."""
    rows = sample(docs, labels, label, modulus, out, max_rows, by_class=True).withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    )
    pairs = rows.select("label", "fold", "text").mapInArrow(_pairs, "label int, fold int, before long, h long, n long")
    models = _models(pairs)
    shared = docs.sparkSession.sparkContext.broadcast(models[:-1])
    held = rows.select("label", "fold", "text").mapInArrow(
        partial(_signals, models=shared), "label int, " + ", ".join(f"s{k} double" for k in range(SIGNALS))
    ).toPandas()
    shared.destroy()
    held = held.sort_values([*held.columns])  # the order of tasks must not matter
    y, x = held["label"].to_numpy(np.float64), held.iloc[:, 1:].to_numpy()
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        weights = np.zeros(SIGNALS + 1)
        weights[-1] = np.log(share / (1 - share))
        return Scorer(None, weights, np.zeros(SIGNALS), np.ones(SIGNALS))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    return Scorer(models[-1], logistic((x - mean) / spread, y), mean, spread)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        out = [m.score(*text_words(raw[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in slices(off)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """(doc_id, score) of every document, in one pass over the whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cols.mapInArrow(partial(_score, model=shared), SCORED)
