"""What surrounds queries: caches that expire, scheduler pools, a store of uploaded files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.scratch import file_system, fresh, write_files


class Cached:
    """A DataFrame that is kept for some seconds, or until it is invalidated."""

    def __init__(self, build: Callable[[], DataFrame], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.build, self.seconds, self.clock = build, seconds, clock
        self._kept: DataFrame | None = None
        self._until = 0.0

    def get(self) -> DataFrame:
        if self._kept is None or self.clock() >= self._until:
            self.invalidate()
            self._kept, self._until = self.build().persist(), self.clock() + self.seconds
        return self._kept

    def invalidate(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = None


@contextmanager
def in_pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside run in a pool of the fair scheduler: high, default, low, or whatever pools are set up."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.scheduler.pool")
    context.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        context.setLocalProperty("spark.scheduler.pool", before)


@contextmanager
def uploaded(spark: SparkSession, files: dict[str, bytes]) -> Iterator[str]:
    """A folder with a request's files that executors can read; it goes at the end, whatever happens."""
    folder = write_files(spark, fresh(spark, "upload"), files)
    try:
        yield folder
    finally:
        fs, path = file_system(spark, folder)
        fs.delete(path(folder), True)
