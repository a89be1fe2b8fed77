"""op2_simhash: fingerprints and components of near-copies over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table
from folioforge.llm.simhash import near_duplicates

QUERY = "op2_simhash"
#: SQL has no XXH64 of shingles; tests/llm/test_simhash.py holds the query against brute force over all pairs.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
