"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

Base rules drop what is too short or repeats itself. Of the rest, a document is anomalous if random splits of the
statistics isolate it early: its mean path length over the trees is short. The forest is grown on a bounded sample of
documents (`SAMPLE` rows by a hash of their ids; each tree takes `PER_TREE` of them, as the method has it). The
threshold is the anomaly score that parts the labelled rows of the learning fold best while it keeps `KEEP` of the
good ones. All documents are scored.

A null or empty text has no words and fails the base rules. Without labelled rows of both kinds the forest drops
nothing. Repeated rows get equal verdicts; label rows that repeat a document count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, held_out
from folioforge.llm.textstats import COUNTS, ratios, statistics

TREES, PER_TREE, SAMPLE, SEED, KEEP = 100, 256, 8192, 3, 0.99
MIN_WORDS, MAX_REPEAT = 50, 50
#: Equal bins of the anomaly score, in which labelled rows are counted for the threshold.
BINS = 2000
EULER = 0.5772156649015329
#: Places in `ratios` that the forest splits: symbols, capitals, letters among all characters, exclamation marks, words
#: of letters only. What the base rules judge is left to them; a statistic that says nothing only lengthens paths.
SPLIT = [2, 5, 6, 8, 12]


def rules(counts: np.ndarray) -> np.ndarray:
    return ratios(counts)[:, SPLIT]


def _usual(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, right child, path length at a leaf. Left children follow."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(per_tree, len(rows))
        self.trees = []
        for _ in range(trees if self.size > 1 else 0):
            take = rows[rng.choice(len(rows), self.size, replace=False)]
            nodes: list[list[float]] = []
            self._grow(take, 0, int(np.ceil(np.log2(self.size))), rng, nodes)
            t = np.array(nodes)
            self.trees.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3]))

    def _grow(self, rows: np.ndarray, depth: int, most: int, rng: np.random.Generator, nodes: list) -> None:
        spread = rows.max(axis=0) > rows.min(axis=0) if len(rows) else np.zeros(0, bool)
        if depth >= most or len(rows) < 2 or not spread.any():
            nodes.append([-1, 0, 0, depth + float(_usual(len(rows)))])
            return
        j = int(rng.choice(np.flatnonzero(spread)))
        at = rng.uniform(rows[:, j].min(), rows[:, j].max())
        me = len(nodes)
        nodes.append([j, at, 0, 0])
        self._grow(rows[rows[:, j] <= at], depth + 1, most, rng, nodes)
        nodes[me][2] = len(nodes)
        self._grow(rows[rows[:, j] > at], depth + 1, most, rng, nodes)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, from 0 to 1."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, at, right, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                goes_left = rows[np.arange(len(rows)), f] <= at[node]
                node = np.where(inner, np.where(goes_left, node + 1, right[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / float(_usual(self.size)))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", keep: float = KEEP) -> DataFrame:
    """Per document (key, COUNTS..., base_failed, anomaly, kept)."""
    stats = cut(statistics(docs, key, text).withColumn("base_failed", base_failed()), "rules-stats")
    passed = stats.filter(~F.col("base_failed"))
    n = passed.count()
    place = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30))
    some = passed.withColumn("place", place).filter(F.col("place") < int(min(1.0, 1.5 * SAMPLE / max(n, 1)) * (1 << 30)))
    rows = some.orderBy("place", *COUNTS).limit(SAMPLE).select(*COUNTS).toPandas().to_numpy()
    forest = Forest(rules(rows))
    scored = cut(_scores(stats, forest), "rules-scores")
    truth = labels.filter(~held_out(key) & F.col(label).isNotNull()).select(F.col(key).alias("labelled"), F.col(label).alias("truth"))
    bins = scored.filter(~F.col("base_failed")).join(truth, F.col(key) == F.col("labelled"))
    bins = bins.groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("anomaly") * BINS)).cast("int").alias("bin")).agg(F.count_if(F.col("truth") == 1).alias("good"), F.count_if(F.col("truth") == 0).alias("bad")).toPandas()
    limit = threshold(bins, keep)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def threshold(bins: pd.DataFrame, keep: float) -> float:
    """The score from which documents are dropped: of the bins' lower ends, the one that parts good and bad rows best."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    good[bins["bin"].to_numpy(int)], bad[bins["bin"].to_numpy(int)] = bins["good"], bins["bad"]
    if not good.sum() or not bad.sum():
        return float("inf")
    kept_good = np.concatenate([[0], np.cumsum(good)])[: BINS + 1] / good.sum()
    kept_bad = np.concatenate([[0], np.cumsum(bad)])[: BINS + 1] / bad.sum()
    gain = np.where(kept_good >= keep, kept_good - kept_bad, -1.0)
    return float(gain.argmax() / BINS) if gain.max() > 0 else float("inf")


def _scores(stats: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(anomaly=forest.score(rules(batch[list(COUNTS)].to_numpy())))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields]
    return stats.mapInPandas(run, ", ".join([*fields, "anomaly double"]))
