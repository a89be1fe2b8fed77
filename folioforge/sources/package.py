"""Lets Python workers import this package, wherever the driver was started and whatever machine they run on."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from folioforge.sources.scratch import fresh, write_files

#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession | None = None) -> None:
    """In local mode workers import it where it lies; on a cluster it is sent to them once, by way of the shared folder."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    context = spark.sparkContext
    if context.master.split("[")[0] == "local":
        context.environment.setdefault("PYTHONPATH", ROOT)
    elif not any(x.startswith("folioforge-") for x in context._python_includes):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for file in sorted(Path(ROOT, "folioforge").rglob("*.py")):
                z.write(file, file.relative_to(ROOT))
        name = f"folioforge-{uuid.uuid4().hex}.zip"
        context.addPyFile(f"{write_files(spark, fresh(spark, 'package'), {name: packed.getvalue()})}/{name}")
