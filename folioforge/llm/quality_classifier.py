"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

The features cos(Wx + b) of standardised document statistics x approximate a Gaussian kernel. Ridge weights solve the
normal equations, whose matrices each partition sums for itself; the partitions' sums are added up in Spark, so the
driver gets one matrix whatever the input. Scores become probabilities by isotonic regression (pool adjacent
violators) over counts in equal bins of the ridge score, which also have a fixed size.

All labelled rows of the learning fold are used. A null text counts as the empty text and gets that text's score.
Without labelled rows the score is 0. Label rows that repeat a document count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, held_out
from folioforge.llm.textstats import COUNTS, ratios, statistics

FEATURES, WIDTH, RIDGE, SEED, BINS = 160, 2.5, 1e-3, 17, 4000
LOW, HIGH = -1.0, 2.0  # the range of the bins; scores beyond are counted at its ends


class Features:
    """The map to random Fourier features; mean and spread standardise the statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.maximum(spread, 1e-6)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        x = np.clip((ratios(counts) - self.mean) / self.spread, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _added_up(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays in column `part`: one row per place of the array comes to the driver."""
    sums = rows.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[sums["at"].to_numpy(int)] = sums["x"]
    return out


def _per_partition(rows: DataFrame, make) -> DataFrame:
    """Each partition's sum of make(counts, truth)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = make(batch[list(COUNTS)].to_numpy(), batch["truth"].to_numpy(float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [total]})

    return rows.select(*COUNTS, "truth").mapInPandas(run, "part array<double>")


class Classifier:
    """Ridge weights over random Fourier features, with isotonic steps from ridge score to probability."""

    def __init__(self, features: Features | None, weights: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.features, self.weights, self.at, self.value = features, weights, at, value

    def ridge(self, counts: np.ndarray) -> np.ndarray:
        return self.features(counts) @ self.weights

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.zeros(len(counts))
        return np.interp(self.ridge(counts), self.at, self.value)


def isotonic(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The non-decreasing fractions nearest to positives / totals, weighted by totals."""
    pools: list[list[float]] = []
    for p, n in zip(positives, totals, strict=True):
        pools.append([p, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in pools]) if pools else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Classifier:
    """Learns from statistics and labels of the learning fold."""
    truth = labels.filter(~held_out(key) & F.col(label).isNotNull()).select(F.col(key).alias("labelled"), F.col(label).cast("double").alias("truth"))
    rows = cut(stats.join(truth, F.col(key) == F.col("labelled")).select(*COUNTS, "truth"), "classifier-rows")
    d = ratios(np.zeros((1, len(COUNTS)))).shape[1]
    sums = _added_up(_per_partition(rows, lambda c, y: np.concatenate([[len(y)], (r := ratios(c)).sum(axis=0), (r * r).sum(axis=0)])), 1 + 2 * d)
    n = sums[0]
    if not n:
        return Classifier(None, np.zeros(0), np.zeros(0), np.zeros(0))
    mean = sums[1 : d + 1] / n
    features = Features(mean, np.sqrt(np.maximum(sums[d + 1 :] / n - mean**2, 0)))
    m = FEATURES + 1

    def equations(c: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = features(c)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = _added_up(_per_partition(rows, equations), m * m + m)
    weights = np.linalg.solve(total[: m * m].reshape(m, m) + RIDGE * n / m * np.eye(m), total[m * m :])
    model = Classifier(features, weights, np.zeros(1), np.zeros(1))

    def counted(c: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.ridge(c) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    bins = _added_up(_per_partition(rows, counted), 2 * BINS)
    some = bins[BINS:] > 0
    centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    return Classifier(features, weights, centres[some], isotonic(bins[:BINS][some], bins[BINS:][some]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per document (key, score): the probability that its label is 1."""
    stats = cut(statistics(docs, key, text), "classifier-stats")
    model = fit(stats, labels, key, label)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[key]].assign(score=model.score(batch[list(COUNTS)].to_numpy()))

    return stats.mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
