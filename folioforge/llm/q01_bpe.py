"""op1_bpe: round trip of every whole document through the byte-level BPE encoder and decoder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.bpe import round_trip
from folioforge.llm.common import table

QUERY = "op1_bpe"
#: SQL has no byte-level BPE; tests/llm/test_bpe.py holds the query against the tokenizer library.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, lossless."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
