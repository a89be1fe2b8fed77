"""Helpers that the corpus operators share: reading tables, cutting lineage, dealing out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.package import importable
from folioforge.sources.scratch import fresh, remove, shared_folder

__all__ = ["WORD", "cut", "held_out", "release", "shared_folder", "table", "whole_row", "workers"]

#: Words of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; any path that Spark's readers can open."""
    workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers(spark: SparkSession) -> None:
    """Lets Python workers find this package, and keeps Arrow batches of long texts small."""
    importable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def cut(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder; large ones by `rows` at a time, since Parquet's
    writer looks at its size every hundred rows only, and its reader takes 4,096.

    Later jobs neither recompute them nor depend on the executors that made them. Spark removes the shuffle files of a
    finished job when the driver's JVM collects its garbage, so that is asked for here.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", rows) if rows else writer).parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, so that columns beside it can't clash with them."""
    return F.struct(*(F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns)).alias(name)


def release(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rsplit("/", 1)[0])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is of the held-out fold: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
