"""Quality classifier (operator 10): a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; at each visit a shallow tree over that feature's bins
takes a small step, so that every feature ends up with one lookup table. Pairs come after, on what
the tables leave unexplained. A score is the sigmoid of a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakeep.llm.statistics import FEATURES, labelled_sample, measure, training_rows
from stratakeep.llm.words import chunks


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class AdditiveModel:
    """cuts: bin edges by feature; single: a table by feature; pairs: a table by pair of features."""

    intercept: float
    cuts: dict[str, np.ndarray]
    single: dict[str, np.ndarray]
    coarse: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each row, by bin additions."""
        bins = {c: np.searchsorted(self.cuts[c], x[c], "left") for c in self.cuts}
        z = np.full(len(next(iter(bins.values()))), self.intercept)
        for c, values in self.single.items():
            z += values[bins[c]]
        for (a, b), values in self.pairs.items():
            z += values[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return sigmoid(z)


def _edges(values: np.ndarray, most: int) -> np.ndarray:
    v = np.unique(np.quantile(values, np.linspace(0, 1, most + 1)))
    return (v[1:] + v[:-1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Newton steps of a tree with few leaves over ordered bins with gradients g and weights h."""
    cuts = [0, len(g)]
    sums = np.c_[np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]]
    value = lambda a, b: (sums[b, 0] - sums[a, 0]) ** 2 / (sums[b, 1] - sums[a, 1] + ridge)
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = np.arange(a + 1, b)
            k = k[(sums[k, 1] - sums[a, 1] >= least) & (sums[b, 1] - sums[k, 1] >= least)]
            if len(k):
                gain = value(a, k) + value(k, b) - value(a, b)
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(k[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (sums[b, 0] - sums[a, 0]) / (sums[b, 1] - sums[a, 1] + ridge)
    return out


def fit(x: dict[str, np.ndarray], y: np.ndarray, rounds: int = 150, rate: float = 0.15, most_bins: int = 48, most_pairs: int = 6, pair_bins: int = 8) -> AdditiveModel:
    """Cyclic boosting on rows x with labels y (0 or 1); without rows of both labels, a constant."""
    n, ones = len(y), int(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    cuts = {c: _edges(x[c], most_bins) if n else np.zeros(0) for c in FEATURES}
    sizes = {c: len(cuts[c]) + 1 for c in FEATURES}
    coarse = {c: np.arange(sizes[c]) * min(pair_bins, sizes[c]) // sizes[c] for c in FEATURES}
    model = AdditiveModel(base, cuts, {c: np.zeros(sizes[c]) for c in FEATURES}, coarse, {})
    if not 0 < ones < n:
        return model
    bins = {c: np.searchsorted(cuts[c], x[c], "left") for c in FEATURES}
    z = np.full(n, base)
    for _ in range(rounds):
        for c in FEATURES:
            p = sigmoid(z)
            step = rate * _tree(np.bincount(bins[c], y - p, sizes[c]), np.bincount(bins[c], p * (1 - p), sizes[c]))
            model.single[c] += step
            z += step[bins[c]]
    p = sigmoid(z)
    cells, gains = {}, {}
    for a, b in combinations(FEATURES, 2):
        width = int(coarse[b][-1]) + 1
        cells[a, b] = coarse[a][bins[a]] * width + coarse[b][bins[b]]
        size = (int(coarse[a][-1]) + 1) * width
        g, h = np.bincount(cells[a, b], y - p, size), np.bincount(cells[a, b], p * (1 - p), size)
        gains[a, b] = float((g * g / (h + 1)).sum())
    for a, b in sorted(gains, key=gains.get, reverse=True)[:most_pairs]:
        model.pairs[a, b] = np.zeros((int(coarse[a][-1]) + 1, int(coarse[b][-1]) + 1))
    for _ in range(rounds // 3):
        for (a, b), values in model.pairs.items():
            p = sigmoid(z)
            g, h = np.bincount(cells[a, b], y - p, values.size), np.bincount(cells[a, b], p * (1 - p), values.size)
            # a tree of depth two: the better of the two features splits first, the other below it
            rows = [_tree(gr, hr, 2, 4.0) for gr, hr in zip(g.reshape(values.shape), h.reshape(values.shape))]
            columns = [_tree(gr, hr, 2, 4.0) for gr, hr in zip(g.reshape(values.shape).T, h.reshape(values.shape).T)]
            by_row, by_column = np.array(rows), np.array(columns).T
            step = rate * max((by_row, by_column), key=lambda s: float((s.ravel() * g).sum() - 0.5 * (s.ravel() ** 2 * h).sum()))
            values += step
            z += step.ravel()[cells[a, b]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000, modulus: int | None = 5, fold: int | None = 0) -> AdditiveModel:
    """A model of labels.quality from at most `most` labelled documents outside the held-out fold."""
    return fit(*training_rows(labelled_sample(docs, labels, "quality", most, modulus, fold)))


def _scored(model: AdditiveModel):
    def run(batches):
        for batch in chunks(batches, "text"):
            score = model.score({k: v.astype(np.float64) for k, v in measure(batch.column(0)).items()})
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])

    return run


def score_quality(docs: DataFrame, model: AdditiveModel, *columns: str) -> DataFrame:
    """(columns, by default doc_id, and score: probability of good quality, of every whole text).

    Null and empty texts have the statistics of an empty text and get its score.
    """
    columns = columns or ("doc_id",)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])
    return docs.select(F.col("text").cast("string").alias("text"), *columns).mapInArrow(_scored(model), schema)
