"""op8_mixing: all documents mixed to weights 3, 1, 2 by source, 150 % of all words, two epochs at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.mixing import mix

QUERY = "op8_mixing"
#: The seeded sample has no SQL; tests/llm/test_mixing.py holds targets and sample against brute force.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
