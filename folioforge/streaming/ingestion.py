"""Ingestion of uploads by steps whose errors are data.

A step sets some columns of each row. What it fails on is written into the row's `failed`, an array of (step, error); the
row keeps the values it had and goes on with the next step. There are two kinds:

- `checked`: columns of built-in functions beside an expression that says what is wrong with a row, null if nothing is.
  Its values are only evaluated for rows that pass.
- `attempted`: a Python function over a list of rows (dicts). It gets many rows at once; where it raises, or gives
  something else than the declared columns, the rows are halved in memory down to the failing ones. So exactly these
  are marked, however many there are and even if rows are equal. The function may see a row again after a neighbour
  of it failed, so it has to be repeatable.

All steps of a batch are one plan: a batch is one job over its rows, and its results are written once before the sink
gets them. A step may fail on every row. What takes the whole worker down is Spark's to retry and isn't isolated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from folioforge.sources.package import importable
from folioforge.sources.scratch import fresh, remove

Step = Callable[[DataFrame], DataFrame]
FAILED = "array<struct<step: string, error: string>>"


def started(uploads: DataFrame) -> DataFrame:
    """uploads with an empty `failed`."""
    return uploads.withColumn("failed", F.array().cast(FAILED))


def checked(name: str, values: dict[str, Column], wrong: Column) -> Step:
    """A step of column expressions, each for the rows where `wrong` is null; otherwise it is the error's text."""

    def step(df: DataFrame) -> DataFrame:
        kinds = df.select(*(value.alias(c) for c, value in values.items())).schema
        seen = df.withColumn("__error", wrong.cast("string"))
        old = [F.col(c) if c in df.columns else F.lit(None).cast(kinds[c].dataType) for c in values]
        fine = F.col("__error").isNull()
        entry = F.array(F.struct(F.lit(name).alias("step"), F.col("__error").alias("error"))).cast(FAILED)
        fresh_values = {c: F.when(fine, value).otherwise(was) for (c, value), was in zip(values.items(), old, strict=True)}
        return seen.withColumns(fresh_values | {"failed": F.when(fine, F.col("failed")).otherwise(F.concat("failed", entry))}).drop("__error")

    return step


def attempted(name: str, inputs: list[str], columns: str, run: Callable[[list[dict]], list[dict]], batch: int = 256) -> Step:
    """A step of a Python function from rows with `inputs` to rows with `columns` (DDL), `batch` rows at a time."""
    new = StructType.fromDDL(columns)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]

    def step(df: DataFrame) -> DataFrame:
        importable(df.sparkSession)
        kept = [c for c in df.columns if c != "failed"]
        result = pa.struct([*((c, kind) for c, kind in kinds), ("error", pa.string())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for k in range(0, part.num_rows, batch):
                    rows = part.slice(k, batch)
                    asked = pa.Table.from_batches([rows]).select(inputs).to_pylist()
                    found = [{**(values or {}), "error": error} for values, error in attempt(run, asked, kinds)]
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, result)], [*rows.schema.names, "__new"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        made = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in new.fields)
        seen = df.mapInArrow(work, f"{fields}, __new struct<{made}, error: string>")
        error = F.col("__new.error")
        entry = F.array(F.struct(F.lit(name).alias("step"), error.alias("error"))).cast(FAILED)
        values = {f.name: F.when(error.isNull(), F.col("__new")[f.name]).otherwise(F.col(f.name) if f.name in kept else F.lit(None)) for f in new.fields}
        return seen.withColumns(values | {"failed": F.when(error.isNull(), F.col("failed")).otherwise(F.concat("failed", entry))}).drop("__new")

    return step


def attempt(run: Callable[[list[dict]], list[dict]], rows: list[dict], kinds: list[tuple[str, pa.DataType]]) -> list[tuple[dict | None, str | None]]:
    """(values, error) of each row; one of the two is null. Rows that fail together are parted until they fail alone."""
    try:
        out = run(rows)
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} rows for {len(rows)}")
        for name, kind in kinds:
            pa.array([row.get(name) for row in out], kind)
        return [({name: row.get(name) for name, _ in kinds}, None) for row in out]
    except Exception as e:  # whatever a step raises is reported in the row
        if len(rows) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    middle = len(rows) // 2
    return attempt(run, rows[:middle], kinds) + attempt(run, rows[middle:], kinds)


def through(uploads: DataFrame, steps: list[Step]) -> DataFrame:
    """uploads after all steps, with `failed` and `status` (complete or failed); lazy."""
    df = started(uploads)
    for step in steps:
        df = step(df)
    return df.withColumn("status", F.when(F.size("failed") == 0, "complete").otherwise("failed"))


def dead_letters(done: DataFrame, key: str = "id") -> DataFrame:
    """(key, step, error) of every step that a row missed."""
    return done.select(key, F.explode("failed").alias("f")).select(key, "f.step", "f.error")


def ingest(uploads: DataFrame, steps: list[Step], sink: Callable[[DataFrame, int], None], every: str | None = None) -> DataStreamWriter:
    """A writer that takes each batch of uploads through the steps, and looks for new ones at an interval.

    A batch's results are stored for the sink, which may read them several times, and removed after it.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, path = df.sparkSession, fresh(df.sparkSession, "batch")
        done = through(df, steps)
        try:
            done.write.parquet(path)
            sink(spark.read.schema(done.schema).parquet(path), number)
        finally:
            remove(spark, path)

    writer = uploads.writeStream.foreachBatch(batch)
    return writer.trigger(processingTime=every) if every else writer
