"""The folder that driver and executors share, for tables, checkpoints and files between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. In local mode one is made where that is unset; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/folioforge/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, its path class)."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def write_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> str:
    """Writes a few small files from the driver; returns the folder."""
    fs, path = file_system(spark, folder)
    for name, content in files.items():
        stream = fs.create(path(f"{folder}/{name}"), True)
        stream.write(bytearray(content))
        stream.close()
    return folder


def remove(spark: SparkSession, path: str) -> None:
    fs, kind = file_system(spark, path)
    fs.delete(kind(path), True)
