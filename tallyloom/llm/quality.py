"""Quality: a generalised additive model with pairwise interactions.

Each feature, and each of a few pairs of features, has a lookup table over bins.  The tables are learned
by boosting shallow trees on one feature (or pair) at a time, in turn; a score is the sum of the
entries that a document's bins point at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.batches import small_batches
from tallyloom.llm.samples import labelled_sample

#: The model is fitted on at most so many labelled documents of each class, first by a hash of doc_id.
PER_CLASS = 6000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15
LEAVES = 3
LEAST_IN_LEAF = 8
#: Strength of pulling leaves towards zero.
SHRINK = 4.0
PREDICTED_FROM = 0.3

FEATURES = [
    "words", "word_length", "upper", "shouts", "symbols", "separators", "digits", "stops", "commas",
    "distinct", "repeats", "twins", "lines", "line_repeats", "line_words", "closed_lines", "long_words",
    "wide",
]


def features(text: str | None) -> list[float]:
    """Numbers of one whole text, in the order of FEATURES; all 0 for an empty one."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    closed = sum(line.rstrip()[-1] in ".!?…\"'”»)" for line in lines)
    letters = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n),
        float(lengths.mean()),
        counts[65:91].sum() / letters,
        (counts[33] + counts[63]) / n,
        counts[[35, 36, 37, 38, 42, 60, 62, 94, 95, 126]].sum() / n,
        counts[124] / n,
        counts[48:58].sum() / letters,
        counts[46] / n,
        counts[44] / n,
        len(set(words)) / n,
        1 - pairs / max(n - 1, 1),
        sum(map(eq, words, words[1:])) / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        closed / max(len(lines), 1),
        float((lengths > 24).mean()),
        counts[128:].sum() / letters,
    ]


@dataclass(frozen=True)
class Model:
    """Bin edges of every feature, a table for each, and tables for pairs of coarser bins."""

    base: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right")
                                for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features: additions of looked-up entries."""
        found = self.bins(x)
        total = np.full(len(x), self.base)
        for k, entries in enumerate(self.tables):
            total += entries[found[:, k]]
        for (i, j), entries in zip(self.pairs, self.pair_tables):
            total += entries[self.coarse[i][found[:, i]], self.coarse[j][found[:, j]]]
        return 1 / (1 + np.exp(-total))


def _sums(keys: np.ndarray, size: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(keys, v, size) for v in values]


def _tree(slope: np.ndarray, bend: np.ndarray, count: np.ndarray, leaves: int) -> np.ndarray:
    """Step of a shallow tree over one feature's bins, from sums by bin: the best cuts one after
    another, then a Newton step in each leaf."""
    def gain(a, b):
        s, h = slope[a:b].sum(), bend[a:b].sum()
        return s * s / (h + SHRINK)

    parts = [(0, len(slope))]
    total_s, total_h, total_n = (np.concatenate(([0], np.cumsum(v))) for v in (slope, bend, count))
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            cuts = np.arange(a + 1, b)
            if not len(cuts):
                continue
            left, right = total_s[cuts] - total_s[a], total_s[b] - total_s[cuts]
            better = (left ** 2 / (total_h[cuts] - total_h[a] + SHRINK)
                      + right ** 2 / (total_h[b] - total_h[cuts] + SHRINK) - gain(a, b))
            enough = ((total_n[cuts] - total_n[a] >= LEAST_IN_LEAF)
                      & (total_n[b] - total_n[cuts] >= LEAST_IN_LEAF))
            better = np.where(enough, better, -np.inf)
            k = int(better.argmax())
            if better[k] > best[0]:
                best = (better[k], part, int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(slope))
    for a, b in parts:
        step[a:b] = slope[a:b].sum() / (bend[a:b].sum() + SHRINK)
    return step


def _pair_tree(slope: np.ndarray, bend: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """Step and gain of the best four cells that one cut in each of two features makes."""
    def corner(v):
        return np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    s, h, n = corner(slope), corner(bend), corner(count)
    best, at = 0.0, None
    for i in range(1, slope.shape[0]):
        for j in range(1, slope.shape[1]):
            cells = [(0, i, 0, j), (0, i, j, -1), (i, -1, 0, j), (i, -1, j, -1)]
            sums = [[v[b, d] - v[a, d] - v[b, c] + v[a, c] for v in (s, h, n)]
                    for a, b, c, d in cells]
            if min(x[2] for x in sums) < LEAST_IN_LEAF:
                continue
            gain = sum(x[0] ** 2 / (x[1] + SHRINK) for x in sums)
            if gain > best:
                best, at = gain, (i, j, [x[0] / (x[1] + SHRINK) for x in sums])
    step = np.zeros(slope.shape)
    if at is not None:
        i, j, values = at
        step[:i, :j], step[:i, j:], step[i:, :j], step[i:, j:] = values
    return step, best


def boost(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Fit the tables.  ``weight``: how many labelled documents a sample row stands for; weights
    are scaled so that they add up to the number of rows."""
    weight = weight * (len(weight) / weight.sum())
    edges = tuple(np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
                  for k in range(x.shape[1]))
    sizes = [len(e) + 1 for e in edges]
    coarse = tuple((np.arange(n) * PAIR_BINS // max(n, PAIR_BINS)).astype(np.int64) for n in sizes)
    rate = float(np.clip((weight * label).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = math.log(rate / (1 - rate))
    bins = np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])
    tables = [np.zeros(n) for n in sizes]
    total = np.full(len(x), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return weight * (label - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, n in enumerate(sizes):
            slope, bend = slopes()
            step = RATE * _tree(*_sums(bins[:, k], n, slope, bend, np.ones(len(x))), LEAVES)
            tables[k] += step
            total += step[bins[:, k]]

    cells = [coarse[k][bins[:, k]] for k in range(x.shape[1])]

    def pair_step(i, j):
        slope, bend = slopes()
        keys = cells[i] * PAIR_BINS + cells[j]
        return _pair_tree(*(v.reshape(PAIR_BINS, PAIR_BINS) for v in _sums(
            keys, PAIR_BINS ** 2, slope, bend, np.ones(len(x)))))

    ranked = sorted(((pair_step(i, j)[1], -i, -j) for i in range(x.shape[1]) for j in range(i)),
                    reverse=True)
    pairs = tuple((-i, -j) for gain, i, j in ranked[:PAIRS] if gain > 0)
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            step = RATE * pair_step(i, j)[0]
            pair_tables[k] += step
            total += step[cells[i], cells[j]]
    return Model(base, edges, tuple(tables), coarse, pairs, tuple(pair_tables))


def _features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def all_features(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return all_features(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The model from labelled documents (``labels``: doc_id, quality) that are not held out; None
    without labels of both classes."""
    sample, counts = labelled_sample(docs, labels, "quality", held_out(F.col("doc_id")), per_class)
    # At most 2 * per_class rows of numbers.
    rows = sample.select("doc_id", "label", _features(F.col("text")).alias("x")).toPandas()
    rows = rows.sort_values("doc_id")
    sizes = rows["label"].value_counts()
    if len(sizes) < 2:
        return None
    share = rows["label"].map({c: counts[c] / sizes[c] for c in (0, 1)})
    return boost(np.vstack(rows["x"]), rows["label"].to_numpy(float), share.to_numpy(float))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from PREDICTED_FROM) of every row of
    ``docs`` (doc_id, text); whole texts.

    Null and empty texts have all features 0; without a model every score is 0.5.  Repeated rows
    and rows without doc_id are returned as they come (the latter not held out); an empty table
    gives an empty result; other columns are not looked at.
    """
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or texts.empty:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([features(t) for t in texts])))

    return (small_batches(docs)
            .select(F.col("doc_id").cast("long"), score(F.col("text")).alias("score"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted")))
