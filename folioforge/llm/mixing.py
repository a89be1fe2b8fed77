"""Mixing sources to target weights by capped water-filling.

Sizes are words. A source's target is its share of the budget by weight; a target above `cap` epochs of its source is
clamped there, and the excess is dealt again among the others by weight, until none is above. Each round is two sums
over the sources; no more than these come to the driver.

A target of e epochs takes every document floor(e) times, and a seeded share of documents once more: each row has a
place, whose first bits hash seed, key and text, and those below its source's threshold are taken. The last bits tell
equal rows apart, so of n equal rows as many are taken as the target asks for, and it doesn't matter which. The
threshold is found by radix: sizes are summed by the place's first bits, the bin in which the wanted size is reached is
split by the next bits, and so on, so no source's documents ever meet in one task. At the last level a bin is about one
row, which is taken if that brings the source nearer to its target.

A null text has size 0. A null source is a source of its own and comes last. Null and repeated keys are like any other:
rows are told apart by their texts too, and equal rows by their place in the table. Sources of size 0, and an empty
table, have target 0. Extra columns don't matter to the mix and are kept by the sample, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, cut, whole_row

#: Bits of a place that one radix level tells apart, and the levels; the last `SAME` bits tell equal rows apart.
RADIX, LEVELS, SAME = 12, 5, 20
HASH_BITS = RADIX * LEVELS


def words(text: str = "text") -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with `rank` from 0 by code points, nulls last; sorted by ranges, not in one task."""
    order = [F.col(column).isNull(), F.col(column)]
    n = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(values.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, at = [], 0
    for k in range(n):
        before.append(at)
        at += counts.get(k, 0)
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("rank", within + F.array(*(F.lit(x).cast("long") for x in before))[F.col("range")]).drop("range")


def water_fill(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """sources(source_size, weight, ...) with `target`: the budget dealt by weight, at most cap times the size."""
    size, weight = F.col("source_size").cast("double"), F.col("weight").cast("double")
    total = sources.agg(F.sum(size)).first()[0] or 0.0
    budget, level, clamped = min(budget, cap * total), 0.0, -1
    while True:  # the level only rises, so what is clamped stays clamped
        full = size * cap <= weight * level
        n, taken, rest = sources.agg(F.count(F.when(full, 1)), F.sum(F.when(full, size * cap)), F.sum(F.when(~full, weight))).first()
        if n == clamped or not rest:
            return sources.withColumn("target", F.when(full, size * cap).otherwise(weight * level))
        clamped, level = n, (budget - (taken or 0.0)) / rest


def _place(seed: int, key: str, text: str) -> Column:
    """A row's place: a hash of seed, key and text, then one of where the row lies. It is fixed once it is written."""
    content = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), 64 - HASH_BITS + SAME)
    return F.shiftleft(content, SAME).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 64 - SAME))


def _limits(rows: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """Per source of rows(mix_source, size, hash): (src, source_size, target, whole, extra, threshold)."""
    sums = cut(rows.groupBy("mix_source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weight = F.array(*(F.lit(float(w)) for w in weights))[(F.col("rank") % len(weights)).cast("int")]
    sources = cut(ranked(sums, "mix_source").withColumn("weight", weight), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(sources, share * total, cap)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(epochs + 1e-12)).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    return _thresholds(rows, cut(targets.select("mix_source", "source_size", "target", "whole", "extra"), "mix-targets"))


def _times(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with what `limits` says of their sources, and `times`: how often the mix takes a row."""
    found = rows.join(limits, rows.mix_source.eqNullSafe(limits.src), "left")
    return found.withColumn("times", (F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document (key, source, size, source_size, target, taken): how many words the mix takes of it.

    Sources weigh `weights` in turn by code point; the mix has `share` times all words, at most `cap` of any source.
    """
    rows = cut(docs.select(F.col(key).alias("mix_key"), F.col(source).alias("mix_source"), words(text).alias("size"), _place(seed, key, text).alias("hash")), "mix-sizes")
    found = _times(rows, _limits(rows, weights, share, cap))
    return found.select(F.col("mix_key").alias(key), F.col("mix_source").alias(source), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def sample(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs, each row as often as the mix takes it; one without words like any other of its source.

    The rows are written once, with size and place beside them; nothing but sums by source is shuffled after that.
    """
    rows = cut(docs.select(whole_row(docs), F.col(source).alias("mix_source"), words(text).alias("size"), _place(seed, key, text).alias("hash")), "mix-rows")
    found = _times(rows, _limits(rows.select("mix_source", "size", "hash"), weights, share, cap)).filter("times > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `threshold`: documents of the source whose hash is below it have `extra` words together, or nearly."""
    now = targets.withColumnRenamed("mix_source", "src").withColumn("threshold", F.lit(0).cast("long")).withColumn("want", F.col("extra"))
    for level in range(LEVELS):
        shift = HASH_BITS - RADIX * (level + 1)
        size = 1 << (shift + RADIX)
        ranges = now.select("src", F.col("threshold").alias("low"), "want")
        inside = rows.join(ranges, rows.mix_source.eqNullSafe(ranges.src)).filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + size))
        bins = inside.groupBy("src", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("n"))
        up_to = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** RADIX bins
        bins = bins.withColumn("sum", F.sum("n").over(up_to))
        bins = bins.join(now.select(F.col("src").alias("s"), "want"), F.col("src").eqNullSafe(F.col("s")))
        fits = F.expr("sum <= want" if level + 1 < LEVELS else "sum - n / 2 <= want")
        done = bins.groupBy("src").agg(F.max(F.when(fits, F.col("bin"))).alias("bin"), F.max(F.when(fits, F.col("sum"))).alias("got"), F.min(F.when(~fits, F.col("bin"))).alias("next")).withColumnRenamed("src", "s")
        after = F.when(F.col("got").isNull(), F.col("threshold")).otherwise(F.shiftleft(F.col("bin") + 1, shift))
        if level + 1 < LEVELS:  # the first bin that doesn't fit is split, also if empty ones lie before it
            after = F.when(F.col("next").isNotNull(), F.shiftleft("next", shift)).otherwise(after)
        now = now.join(done, F.col("src").eqNullSafe(F.col("s")), "left").select(
            *targets.drop("mix_source").columns,
            "src",
            after.alias("threshold"),
            (F.col("want") - F.coalesce("got", F.lit(0))).alias("want"),
        )
        now = cut(now, "mix-threshold")
    return now
