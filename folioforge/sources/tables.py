"""The data directory's tables as the entities of the model. Scans are lazy; Catalyst prunes columns and pushes filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.package import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """df in parts of about `rows` rows, for what takes long per row: a few megabytes of Parquet, which Spark reads in one
    task, may hold a million short rows."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items from part: title, college, program, year, tags, cached citations, registered flag."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("college"),
        F.col("p_type").alias("program"),
        F.col("p_size").alias("year"),
        F.split("p_name", " ").alias("tags"),
        F.floor("p_retailprice").cast("long").alias("cites_cached"),
        (F.col("p_partkey") % 3 == 0).alias("registered"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges from lineitem: source, matched, raw, score, seq."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("matched"), F.col("l_shipdate").cast("string").alias("raw"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").cast("long").alias("seq")
    )


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, author): suppliers of each part as its authors, as often as they supplied it."""
    items, names = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return items.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("id"), F.col("s_name").alias("author"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the paper that their source is."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, paper_id, vec) of the embeddings; the label is the paper."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("paper_id"), F.col("embedding").alias("vec"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as paged chunks: two turns a page."""
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("paper_id"), F.floor(F.col("turn") / 2 + 1).cast("int").alias("page"), F.col("turn").cast("int").alias("chunk_id"), "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views: user, item, time."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
