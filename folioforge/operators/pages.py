"""Page texts (doc, page, text): running positions, appendix cut-off, and the page of each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(pages: DataFrame) -> DataFrame:
    """pages with `start`, the character at which each begins in the joined text (W6); pages are joined by nothing."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))


def without_appendix(pages: DataFrame, cutoff: int = 5000) -> DataFrame:
    """Pages before the first appendix page that begins after more than `cutoff` characters."""
    marked = positions(pages).withColumn("cut", (F.col("start") > cutoff) & F.col("text").rlike(r"(^|\n)\s*(APPENDIX|APPENDICES)"))
    w = Window.partitionBy("doc")
    first = F.min(F.when(F.col("cut"), F.col("page"))).over(w)
    return marked.withColumn("first", first).filter(F.col("first").isNull() | (F.col("page") < F.col("first"))).drop("first", "cut")


def last_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """The last n pages of each document (S8); page 1 alone is pages.filter("page = 1")."""
    return pages.withColumn("last", F.max("page").over(Window.partitionBy("doc"))).filter(F.col("page") > F.col("last") - n).drop("last")


def page_of_chunks(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks (doc, chunk_id, text) with the page on which each begins.

    A chunk is looked for after the start of the one before it, so overlaps are found; null if it isn't there.
    """
    spans = F.array_sort(F.collect_list(F.struct("page", "text")))
    whole = pages.groupBy("doc").agg(spans.alias("pages"))
    listed = chunks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.col("text").alias("body")))).alias("chunks"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<chunk_id:int,at:int>>)").alias("out"))

    def step(acc, c):
        at = F.call_function("locate", c["body"], F.col("whole"), acc["at"] + 1)
        item = F.struct(c["chunk_id"].cast("int").alias("chunk_id"), at.cast("int").alias("at"))
        return F.struct(F.when(at > 0, at).otherwise(acc["at"]).cast("int").alias("at"), F.array_append(acc["out"], item).alias("out"))

    joined = whole.join(listed, "doc").withColumn("whole", F.array_join(F.transform("pages", lambda p: p["text"]), ""))
    found = joined.withColumn("found", F.explode(F.aggregate("chunks", zero, step, lambda acc: acc["out"])))
    start = positions(pages).select("doc", "page", "start", (F.col("start") + F.length("text")).alias("stop"))
    at = found.select("doc", F.col("found.chunk_id").alias("chunk_id"), (F.col("found.at") - 1).alias("at"))
    hit = at.join(start, "doc", "left").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))).select("doc", "chunk_id", "page")
    return chunks.join(hit, ["doc", "chunk_id"], "left")
