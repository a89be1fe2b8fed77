"""Connected components of an edge list by large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, release, workers

#: Edges that a partition reduces to a forest at once.
BLOCK = 500_000
#: Parts that a node's neighbours are dealt to.
SALTS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Each partition first reduces its edges to a spanning forest. Then, until nothing changes, every node hands its
    larger neighbours (large star) and its smaller ones (small star) its smallest neighbour. Only a count and a
    checksum come to the driver. Nodes are integers; edges with a null end or of a node with itself are ignored.
    """
    workers(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInPandas(_forest, "a long, b long")
    now, state = cut(now.distinct(), "edges"), None
    while True:
        star = _star(now.union(now.select("b", "a")), "a < b")
        star = _star(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "true")
        before, now = now, cut(star.distinct(), "edges")
        release(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        state = new


def _star(pairs: DataFrame, those: str) -> DataFrame:
    """Edges from each neighbour b of a to the least of a and its neighbours; a's own edge in a small star.

    A node may have most others as its neighbours, so they are dealt by a salt: the least of each (a, salt) makes the
    least of a, and that goes back to each (a, salt).
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = pairs.groupBy("a", "salt").agg(F.min("b").alias("part"))
    least = parts.groupBy("a").agg(F.min("part").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = pairs.filter(those).join(parts.join(least, "a").drop("part"), ["a", "salt"]).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if those == "true":
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] = up.setdefault(y, y)
            x = up[x]
        return x

    def out() -> pd.DataFrame:
        pairs = [(x, find(x)) for x in list(up) if find(x) != x]
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > BLOCK:
            yield out()
            up.clear()
    yield out()
