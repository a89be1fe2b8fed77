"""Pages of a long sorted list without sorting it up to the page.

Rows are kept in ranges of their order, each a folder, with the number of rows before each range. A page reads the one or
two ranges that it lies in, however deep it is, and of those only its own rows: each has its `place` in the range.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a range, about, and the most ranges: the driver samples three hundred rows a range to part them, and keeps
#: their counts.
ROWS, MOST = 100_000, 1000


class PageIndex:
    """Rows in a folder, in the order that they were indexed by."""

    def __init__(self, spark: SparkSession, folder: str, order: list[str | Column]):
        self.spark, self.folder, self.order = spark, folder, order
        meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        self.before, self.total = meta["before"], meta["total"]
        self.rows = spark.read.schema(StructType.fromJson(meta["schema"])).parquet(f"{folder}/rows")

    @classmethod
    def build(cls, df: DataFrame, folder: str, order: list[str | Column], rows: int = ROWS) -> PageIndex:
        """Indexes df by an order, which should be total: rows that tie may change places between pages."""
        spark = df.sparkSession
        parts = max(1, min(MOST, -(-df.count() // rows)))
        dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
        dealt = dealt.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        dealt.write.partitionBy("range").parquet(f"{folder}/rows")
        counts = {r["range"]: r["n"] for r in spark.read.schema(dealt.schema).parquet(f"{folder}/rows").groupBy("range").agg(F.count("*").alias("n")).collect()}  # MOST at most
        before, at = [], 0
        for k in range(parts):
            before.append(at)
            at += counts.get(k, 0)
        meta = {"before": before, "total": at, "schema": json.loads(dealt.schema.json())}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/meta")
        return cls(spark, folder, order)

    def slice(self, start: int, size: int) -> DataFrame:
        """Rows start to start + size of the order; reads the ranges that these lie in."""
        first, last = (bisect_right(self.before, x) - 1 for x in (start, max(start, start + size - 1)))
        mine = F.lit(False)
        for k in range(first, last + 1):
            low = start - self.before[k]
            mine = mine | ((F.col("range") == k) & F.col("place").between(max(0, low), low + size - 1))
        return self.rows.filter(mine).orderBy(*self.order).drop("range", "place").limit(size)

    def page(self, number: str | int, size: int) -> DataFrame:
        """As `browse.page_of`: a bad number means the first page, one beyond the end the last."""
        try:
            n = int(number)
        except ValueError:
            n = 1
        pages = max(1, -(-self.total // size))
        return self.slice(((pages if n > pages or n < 1 else n) - 1) * size, size)

    def look_ahead(self, number: int, size: int) -> DataFrame:
        """As `browse.look_ahead`: a page with `has_next`."""
        return self.slice((number - 1) * size, size).withColumn("has_next", F.lit(number * size < self.total))
