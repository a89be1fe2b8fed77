"""Column builders over dense vectors; all arithmetic is in double."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import col
from folioforge.sources.package import importable


def dot(a, b) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity (Q6); null if a vector is null, zero or of another length."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_eps(a, b, eps: float = 1e-8) -> Column:
    """Cosine similarity with eps added to the denominator (Q7)."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def unit(a) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))


def min_max(x, over) -> Column:
    """x between 0 and 1 within a window; 1 for all if they are equal (Q5)."""
    low, high = F.min(col(x)).over(over), F.max(col(x)).over(over)
    return F.when(high == low, 1.0).otherwise((col(x) - low) / (high - low))


def embedder(encode: Callable[[list[str]], list[list[float]]], batch: int = 64):
    """An Arrow UDF from text to vector (Q24): `encode` gives the vectors of a list of texts, `batch` at a time.

    A null or blank text has a null vector and isn't sent.
    """
    importable()

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        some = [i for i, t in enumerate(texts) if t.is_valid and t.as_py().strip() != ""]
        out, place = [pa.array([], pa.list_(pa.float32()))], [None] * len(texts)
        for k in range(0, len(some), batch):  # no more than these are Python objects at once
            found = encode(texts.take(pa.array(some[k : k + batch])).to_pylist())
            for n, (i, _) in enumerate(zip(some[k : k + batch], found, strict=True)):
                place[i] = k + n
            out.append(pa.array(found, pa.list_(pa.float32())))
        return pa.concat_arrays(out).take(pa.array(place, pa.int64()))

    return vectors


@lru_cache(maxsize=1 << 16)
def _bucket(term: str, size: int) -> int:
    return int.from_bytes(md5(term.encode("utf-8", "replace"), usedforsecurity=False).digest()[:2], "big") % size


def hashed_terms(texts: list[str], size: int = 64) -> list[list[float]]:
    """Vectors of unit length that count a text's terms by their hash: an encoder that needs no model."""
    out = []
    for text in texts:
        v = [0.0] * size
        for term in re.findall(r"[^\W_]+", text.lower()):
            v[_bucket(term, size)] += 1.0
        length = sum(x * x for x in v) ** 0.5
        out.append([x / length for x in v] if length else v)
    return out
