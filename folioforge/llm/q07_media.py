"""op7_media: every document as a lossless WebP image and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.media import round_trip

QUERY = "op7_media"
#: SQL has no image format; tests/llm/test_webp.py holds the codec against exact round trips.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return round_trip(table(spark, sf_dir, "documents"))
