"""op4_language: the language of every document by a linear-chain conditional random field over its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import held_out, table
from folioforge.llm.crf import fit, predict

QUERY = "op4_language"
#: SQL can't train or run a CRF; tests/llm/test_crf.py holds it against enumeration of paths and held-out accuracy.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
