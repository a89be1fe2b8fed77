"""Changes as new tables: each function takes the old rows and returns the new ones (copy on write)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.sources.scratch import file_system


def get_or_create(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old and those of new whose keys it lacks (M1)."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti"))


def upsert_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tags (name, description) by lower-case name; a description that isn't empty replaces another; blank names go (M2)."""
    named = new.select(F.lower(F.trim("name")).alias("name"), F.nullif(F.col("description"), F.lit("")).alias("fresh")).filter("name <> ''")
    fresh = named.groupBy("name").agg(F.max("fresh").alias("fresh"))
    return old.select("name", "description").join(fresh, "name", "full").select("name", F.coalesce("fresh", "description").alias("description"))


def rename_tag(tags: DataFrame, old: str, new: str) -> DataFrame:
    """tags with one renamed unless the new name is taken (M3); papers keep the old name."""
    taken = tags.filter(F.col("name") == new).select(F.lit(1).alias("taken")).limit(1)
    marked = tags.join(F.broadcast(taken), F.lit(True), "left")
    return marked.withColumn("name", F.when((F.col("name") == old) & F.col("taken").isNull(), new).otherwise(F.col("name"))).drop("taken")


def toggle(df: DataFrame, where, column: str) -> DataFrame:
    return df.withColumn(column, F.when(where, ~F.col(column)).otherwise(F.col(column)))


def set_where(df: DataFrame, where, **values) -> DataFrame:
    """df with columns set where a condition holds (M4, M6, M11); the condition is that of the old values."""
    return df.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children without those of deleted parents (M5)."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children with the reference to deleted parents set to null (M5)."""
    marked = children.join(gone.select(F.col("id").alias(key), F.lit(True).alias("gone")).distinct(), key, "left")
    return marked.withColumn(key, F.when(F.col("gone"), None).otherwise(F.col(key))).drop("gone")


def last_wins(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key (M7)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def backfill(df: DataFrame, fresh: DataFrame, key: str, column: str, force: bool = False) -> DataFrame:
    """Nulls of a column filled from fresh(key, column); with force everything that fresh has (M9)."""
    joined = df.join(fresh.select(key, F.col(column).alias("fresh")), key, "left")
    return joined.withColumn(column, F.coalesce("fresh", column) if force else F.coalesce(column, "fresh")).drop("fresh")


def reindex(chunks: DataFrame, fresh: DataFrame, key: str = "paper_id") -> DataFrame:
    """chunks with those of the papers in fresh replaced; doing it twice changes nothing more (M8)."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def recents(events: DataFrame, most: int = 10) -> DataFrame:
    """Most recent distinct items of each user, `most` of them."""
    last = events.groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item")
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def outcome_counts(df: DataFrame, outcome: str, *kinds: str) -> DataFrame:
    """How many rows had each outcome."""
    return df.agg(*(F.count_if(F.col(outcome) == k).alias(k) for k in kinds))


def in_batches(df: DataFrame, change: Callable[[DataFrame], DataFrame], folder: str, key: str = "id", size: int = 100) -> DataFrame:
    """change(df) made in batches of about `size` rows, each of which is one transaction (M10), in one pass over df.

    Batches are by a hash of the key, and each is one file that one task writes; it is committed as the file appears,
    when its task ends, whatever becomes of the others. After a crash the next call takes up the rows of batches that
    have no file yet, so each counts once. `change` may add and alter columns, but keeps the key.
    """
    spark = df.sparkSession
    fs, path = file_system(spark, folder)
    held = path(f"{folder}/batches")
    if fs.exists(held):  # as many as at first, whatever has become of df
        many = int(fs.listStatus(held)[0].getPath().getName())
    else:
        many = max(1, -(-df.count() // size))
        fs.create(path(f"{folder}/batches/{many}"), True).close()
    number = F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
    done = sorted({int(name.split("=")[1]) for run in _names(fs, path(f"{folder}/data")) for name in _names(fs, path(f"{folder}/data/{run}")) if name.startswith("batch=")})
    todo = df.withColumn("batch", number)
    if done:
        todo = todo.join(spark.createDataFrame([(k,) for k in done], "batch int"), "batch", "left_anti")
    made = change(todo.drop("batch")).withColumn("batch", number)
    writer = made.repartition("batch").write.partitionBy("batch").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.parquet(f"{folder}/data/{uuid.uuid4().hex}")
    runs = [f"{folder}/data/{run}" for run in _names(fs, path(f"{folder}/data"))]
    return spark.read.schema(made.schema).parquet(*runs).drop("batch")


def _names(fs, folder) -> list[str]:
    """What is in a folder, but for Spark's own files."""
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [name for name in found if not name.startswith(("_", "."))]
