"""Chunkers: greedy packers as native higher-order functions, the recursive splitter as a Pandas UDF."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import col
from folioforge.sources.package import importable

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def pack_sentences(text, most: int = 1000) -> Column:
    """Chunks of whole sentences while their characters stay below `most`; empty chunks are dropped.

    Sentences end at ". "; a chunk is stripped. A sentence longer than `most` is a chunk of its own.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) < most
        piece = F.concat(s, F.lit(". "))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], F.trim(acc["now"]))).alias("done"),
            F.when(fits, F.concat(acc["now"], piece)).otherwise(piece).alias("now"),
        )

    last = lambda acc: F.filter(F.array_append(acc["done"], F.trim(acc["now"])), lambda c: c != "")
    return F.aggregate(F.split(F.coalesce(col(text), F.lit("")), r"\. ", -1), zero, step, last)


def pack_paragraphs(text, most: int = 500) -> Column:
    """Chunks of paragraphs while their words stay at or below `most` (X8); a chunk joins its paragraphs by blank lines."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = F.size(F.filter(F.split(p, r"(?U)\s+"), lambda w: w != ""))
        fits = (acc["n"] + n <= most) | (acc["n"] == 0)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"),
            F.when(fits & (acc["n"] > 0), F.concat(acc["now"], F.lit("\n\n"), p)).otherwise(p).alias("now"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
        )

    return F.aggregate(paragraphs, zero, step, lambda acc: F.filter(F.array_append(acc["done"], acc["now"]), lambda c: c != ""))


def split_recursively(text: str | None, size: int = 1000, overlap: int = 200, separators=SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that serves, overlapping by up to `overlap`.

    Text between separators that is too long is split by the next one. A separator stays with the text after it.
    """
    if not (text or "").strip():
        return []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep in separators else ()
    pieces = list(text) if sep == "" else [p for i, x in enumerate(text.split(sep)) if (p := x if i == 0 else sep + x)]
    out: list[str] = []
    run: deque[str] = deque()
    held = 0  # characters in run

    def flush() -> None:
        if chunk := "".join(run).strip():
            out.append(chunk)

    for p in pieces:
        if len(p) > size and finer:
            if run:
                flush()
                run.clear()
                held = 0
            out += split_recursively(p, size, overlap, finer)
            continue
        if run and held + len(p) > size:
            flush()
            while run and (held > overlap or held + len(p) > size):
                held -= len(run.popleft())
        run.append(p)
        held += len(p)
    flush()
    return out


def recursive_chunks(size: int = 1000, overlap: int = 200):
    """A Pandas UDF from text to its recursive chunks."""
    importable()

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap))

    return chunks
