"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules with a query each: QUERY is its name, query(spark, sf_dir) its DataFrame, ORACLE_SQL its SQL or None.
MODULES = (
    "q01_bpe", "q02_simhash", "q03_pii", "q04_language", "q05_rules", "q06_rollups", "q07_media", "q08_mixing", "q09_classifier", "q10_passages",
    "q11_word_bpe", "q12_variants", "q13_phrases",
)


def queries() -> dict:
    return {m.QUERY: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}


def _modules():
    return [importlib.import_module(f"folioforge.llm.{m}") for m in MODULES]
