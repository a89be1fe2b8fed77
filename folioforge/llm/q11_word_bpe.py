"""op11_word_bpe: round trip of every whole document through the BPE encoder and decoder with word ends."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.word_bpe import round_trip

QUERY = "op11_word_bpe"
#: SQL has no BPE; tests/llm/test_word_bpe.py holds the query against the tokenizer library.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
