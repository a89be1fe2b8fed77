"""From documents to token ids: language, near-copies, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. Rows without an id, language, source or text are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe import encode_documents
from folioforge.llm.common import cut, table
from folioforge.llm.crf import accept, fit
from folioforge.llm.mixing import sample
from folioforge.llm.pii import sanitise
from folioforge.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the CRF knows with a score of 0.5 or more; it learns from docs outside the held-out fold."""
    return accept(docs, fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that with the smallest id, or of several with it any one."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; n_chars follows the text."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, lossless, n_tokens of every document of the mixture."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.drop("text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: Training, fingerprints and tokens have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written, and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
