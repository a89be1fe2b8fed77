"""op6_rollups: token totals of all documents by source, language and tokenizer version, kept by deltas.

Every document is inserted with a rough count, then each count is revised to the exact one, in batches that are all
delivered twice; documents without text are deleted at the end. So the totals are those of the documents with text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import cut, shared_folder, table
from folioforge.llm.rollups import DELETE, INSERT, REVISE, Rollup, token_counts

QUERY = "op6_rollups"
VERSION = "byte_bpe_50k"
#: SQL has no byte-level BPE; tests/llm/test_rollups.py holds totals against a count of the tokens in Python.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source, lang and tokenizer: documents, tokens."""
    docs = table(spark, sf_dir, "documents")
    counts = cut(token_counts(docs, public_tokenizers.path(f"{VERSION}.tiktoken"), public_tokenizers.PATTERN, VERSION), "token-counts")
    rollup = Rollup(spark, f"{shared_folder(spark)}/folioforge/rollup-{uuid.uuid4().hex}")
    change = lambda op, old, new: counts.select(F.lit(op).alias("op"), "source", "lang", "tokenizer", old.alias("old_tokens"), new.alias("new_tokens"))
    none = F.lit(None).cast("long")
    batches = {
        "insert": change(INSERT, none, F.col("rough")),
        "revise": change(REVISE, F.col("rough"), F.col("n_tokens")),
        "empty": change(DELETE, F.col("n_tokens"), none).filter("old_tokens = 0"),
    }
    for name, changes in batches.items():
        rollup.commit(name, changes)
    rollup.compact()
    for name, changes in batches.items():
        rollup.commit(name, changes)
    return rollup.totals()
