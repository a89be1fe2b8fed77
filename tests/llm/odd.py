"""Documents that are odd in every way the operators have a rule for."""

from __future__ import annotations

DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, digest long, fp string, size string, spans string, ids string, kept string"
LONG = "word " * 30_000 + "end."


def documents(spark, texts=()):
    rows = [(1, None), (2, ""), (None, None), (None, "a b c d"), (3, " \n\t"), (4, LONG), (5, "12 34 !!"), (6, "x"), (6, "x"), (7, "one two three four"), (7, "another text with this id"), *texts]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 1 else f"s{k % 2}", None, "r", k, "f", "z", "s", "i", "k") for k, (i, t) in enumerate(rows)], DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)
