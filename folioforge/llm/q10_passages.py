"""op10_passages: near-duplicate passages of 50 words or more over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table
from folioforge.llm.passages import classes

QUERY = "op10_passages"
#: SQL has no Cartesian trees; tests/llm/test_passages.py holds exact runs of the corpus and edited passages of small
#: texts against brute force over all pairs, and measures recall on planted ones.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_passages, spans ("first-last" word of each, comma-joined)."""
    found = classes(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")
    return found.select("doc_id", "class_id", "n_links", F.size("spans").cast("long").alias("n_passages"), listed.alias("spans"))
