"""Keyword, full-text, vector and hybrid search over chunks (id, paper_id, text, vec)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import SearchSettings
from folioforge.functions import stemming
from folioforge.functions import text as T
from folioforge.functions import vectors as V
from folioforge.sources.package import importable

if TYPE_CHECKING:
    from folioforge.operators.text_index import TextIndex, TrigramIndex

#: BM25's parameters (Robertson and Zaragoza 2009).
K1, B = 1.2, 0.75
#: Rows of a block of vectors.
BLOCK = 1024


def keyword(chunks: DataFrame, q: str, top_k: int = 5, most: int | None = None, index: TrigramIndex | None = None) -> DataFrame:
    """Literal occurrences summed by paper, with the first matching chunk highlighted.

    With an index of trigrams only the texts that have all of the query's are read; without one all texts are scanned.
    `most` takes only the first so many matching chunks by id, as the reference does; by default all are taken.
    """
    if not q.strip():
        return chunks.select("paper_id", F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    hits = index.containing(chunks, q) if index else chunks.filter(T.contains_ci("text", q))
    if most:
        hits = hits.orderBy("id").limit(most)
    found = hits.groupBy("paper_id").agg(F.sum(T.occurrences("text", q)).cast("double").alias("score"), F.min_by("text", "id").alias("first"))
    best = found.orderBy(F.desc("score"), "paper_id").limit(top_k)
    return best.select("paper_id", "score", T.highlight("first", q).alias("snippet"))


def postings(chunks: DataFrame) -> DataFrame:
    """(id, term, tf, length) of every chunk; `text_index.TextIndex` keeps them with positions, in blocks."""
    terms = chunks.select("id", T.tokens("text").alias("terms"))
    return terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, q: str) -> DataFrame:
    """(id, rank) of the chunks that have every term of q, by BM25 (Q4, F14). No terms, no rows.

    Statistics of the corpus are one aggregate over all texts. Terms are counted where a text contains them, by one scan
    of it; only the rows with every term are ranked.
    """
    terms = sorted({t for t, _ in stemming.terms(q, "simple")[0]})
    if not terms:
        return chunks.select("id", F.lit(0.0).alias("rank")).limit(0)
    body = F.lower("text")
    alone = lambda t: F.regexp_count(body, F.lit(rf"(?<![\p{{L}}\p{{N}}]){T.literal(t)}(?![\p{{L}}\p{{N}}])"))
    has = [F.contains(body, F.lit(t)) for t in terms]
    length = F.coalesce(F.regexp_count(body, F.lit(r"[\p{L}\p{N}]+")), F.lit(0))
    counts = [F.when(here, alone(t)).otherwise(0).alias(f"tf{i}") for i, (t, here) in enumerate(zip(terms, has, strict=True))]
    stats = chunks.select(length.alias("length"), *counts).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    counted = chunks.filter(reduce(and_, has)).select("id", length.alias("length"), *counts)
    rank = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        rank = rank + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    every = reduce(and_, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    return counted.filter(every).crossJoin(F.broadcast(stats)).select("id", rank.alias("rank"))  # stats is one row


def similarity(vec, query: list[float]) -> Column:
    return V.cosine(vec, F.array(*(F.lit(float(x)) for x in query)))


def nearest(rows: DataFrame, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """The k rows with the most similar vectors, then only those at or above `least`."""
    best = rows.withColumn("similarity", similarity("vec", query)).filter("similarity is not null").orderBy(F.desc("similarity"), "id").limit(k)
    return best if least is None else best.filter(F.col("similarity") >= least)


def best_per_row(left: DataFrame, right: DataFrame, k: int, key: str = "qid", other: str = "id", unlike: str | None = None) -> DataFrame:
    """(key, other, similarity, rank) of the k most similar rows of right(other, vec) for each row of left(key, qvec):
    similarity join with top k (J10, J11). Rows whose `unlike`, a column of left, equals `other` don't count.

    Both sides are put in blocks, and each pair of blocks is one matrix product, which leaves only the best k of a row
    and what ties with them. So nothing is compared row by row, and no more than k rows (and ties) of a pair of blocks
    are shuffled by key.
    """
    importable(left.sparkSession)
    asked = _blocks(left.select(F.col(key).alias("key"), F.col(unlike or key).alias("unlike"), F.col("qvec").alias("vec")), "q")
    rows = _blocks(right.select(F.col(other).alias("key"), F.col(other).alias("unlike"), "vec"), "r")
    apart = unlike is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                keys, others, found = _nearest_of_blocks(x.values, y.values, k, apart)
                yield pa.RecordBatch.from_arrays([keys, others, pa.array(found)], ["key", "other", "similarity"])

    kinds = [side.schema[name].dataType.simpleString() for side, name in ((left, key), (right, other))]
    pairs = asked.crossJoin(rows)  # blocks, each of up to BLOCK rows
    best = pairs.select("q", "r").mapInArrow(run, f"key {kinds[0]}, other {kinds[1]}, similarity double")
    w = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("key").alias(key), F.col("other").alias(other), "similarity", "rank")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Arrays of up to BLOCK rows (key, unlike, vec), in one column; rows without a vector are left out."""
    rows = rows.filter(F.col("vec").isNotNull()).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    block = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK)
    return rows.groupBy("part", block.alias("block")).agg(F.collect_list(F.struct("key", "unlike", "vec")).alias(name)).select(name)


def _nearest_of_blocks(x: pa.StructArray, y: pa.StructArray, k: int, apart: bool) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Keys of x, keys of y and similarity of the best k (and ties) in y of each row of x; those of other lengths apart."""
    a, b = x.field("vec"), y.field("vec")
    at, to, out = [], [], []
    sizes = np.asarray(pc.list_value_length(a)), np.asarray(pc.list_value_length(b))
    for size in np.unique(sizes[0]):
        i, j = np.flatnonzero(sizes[0] == size), np.flatnonzero(sizes[1] == size)
        if not size or not len(j):
            continue
        p, q = (np.asarray(v.take(pa.array(m)).flatten(), dtype=np.float64).reshape(-1, size) for v, m in ((a, i), (b, j)))
        p_norm, q_norm = (np.sqrt((m * m).sum(axis=1)) for m in (p, q))
        s = p @ q.T / np.where(p_norm, p_norm, np.nan)[:, None] / np.where(q_norm, q_norm, np.nan)[None, :]
        if apart:
            mine, theirs = x.field("unlike").take(pa.array(i)), y.field("unlike").take(pa.array(j))
            s[np.asarray(mine)[:, None] == np.asarray(theirs)[None, :]] = np.nan
        s = np.where(np.isfinite(s), s, -2.0)
        least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
        row, column = np.nonzero((s >= least[:, None] - 1e-9) & (s > -2.0))
        at.append(i[row])
        to.append(j[column])
        # added up in one order whatever the block, so that equal vectors tie
        dots = np.zeros(len(row))
        for c in range(size):
            dots += p[row, c] * q[column, c]
        out.append(dots / (p_norm[row] * q_norm[column]))
    at, to, out = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((at, np.int64), (to, np.int64), (out, np.float64)))
    return x.field("key").take(pa.array(at)), y.field("key").take(pa.array(to)), out


def hybrid(chunks: DataFrame, q: str, query: list[float], s: SearchSettings | None = None, index: TextIndex | None = None) -> DataFrame:
    """Text rank and similarity, each scaled over the candidates and weighed; best chunk per paper.

    Candidates are the best by text rank, from a kept index if there is one, otherwise by a scan of the texts. Only the
    scores that reach min_score stay. The scores are rounded last.
    """
    s = s or SearchSettings()
    best = index.best(q, s.candidates) if index else bm25(chunks, q).orderBy(F.desc("rank"), "id").limit(s.candidates)
    ranked = best.join(chunks, "id").withColumn("similarity", similarity("vec", query))
    everything = Window.partitionBy()  # the candidates, a bounded number
    scored = ranked.withColumn("score", s.bm25_weight * V.min_max("rank", everything) + s.vector_weight * V.min_max("similarity", everything))
    first = Window.partitionBy("paper_id").orderBy(F.desc("score"), F.desc("rank"), "id")
    best = scored.filter(F.col("score") >= s.min_score).withColumn("n", F.row_number().over(first)).filter("n = 1")
    return best.orderBy(F.desc(F.round("score", 4)), F.desc("rank"), "id").limit(s.top_k).select("paper_id", "id", F.round("score", 4).alias("score"))


def semantic(chunks: DataFrame, q: str, query: list[float], s: SearchSettings | None = None) -> DataFrame:
    """hybrid, or if no chunk has the terms, the nearest chunks by vector alone, several to a paper (Q2, Q3)."""
    s = s or SearchSettings()
    terms = [t for t, _ in stemming.terms(q, "simple")[0]]
    body = F.lower("text")
    every = reduce(and_, (F.contains(body, F.lit(t)) & F.array_contains(T.tokens("text"), t) for t in terms), F.lit(bool(terms)))
    if not chunks.filter(every).isEmpty():  # stops at the first chunk
        return hybrid(chunks, q, query, s)
    return nearest(chunks, query, s.top_k, s.min_score).select("paper_id", "id", F.round("similarity", 4).alias("score"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """first, or second if first is empty (U5), without an action: an anti join against whether there is a row."""
    some = first.limit(1).select(F.lit(1).alias("some"))
    return first.unionByName(second.join(F.broadcast(some), F.lit(True), "left_anti"))


def post_filtered(hits: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """Hits whose paper passed the filters; they are dropped after the top k, so fewer may be left."""
    return hits.join(papers, key)


def autocomplete(papers: DataFrame, q: str, n: int = 5, authors_of: int = 0, index: TrigramIndex | None = None) -> DataFrame:
    """Titles and distinct authors with q, n of each (Q12, U6); titles by an index of their trigrams if there is one.

    `authors_of` looks at the authors of the first so many papers only, as the reference does; 0: of all.
    """
    titles = (index.containing(papers, q, "title") if index else papers.filter(T.contains_ci("title", q))).orderBy("id").limit(n).select(F.lit("paper").alias("kind"), F.col("title").alias("value"))
    some = papers.orderBy("id").limit(authors_of) if authors_of else papers
    names = some.select(F.explode("authors").alias("value")).filter(T.contains_ci("value", q)).distinct().orderBy("value").limit(n)
    return titles.unionByName(names.select(F.lit("author").alias("kind"), "value"))


def related(chunks: DataFrame, paper: int, query: list[float], s: SearchSettings | None = None) -> DataFrame:
    """Papers nearest to a vector, best chunk of each title."""
    s = s or SearchSettings()
    near = nearest(chunks.filter(F.col("paper_id") != paper), query, s.related_factor * s.related_top_k)
    best = near.groupBy("title").agg(F.max("similarity").alias("similarity"))
    return best.filter(F.col("similarity") >= s.related_min_score).orderBy(F.desc("similarity"), "title").limit(s.related_top_k)


def extract_tags(docs: DataFrame, tags: DataFrame, s: SearchSettings | None = None) -> DataFrame:
    """Tags of each document: top n by similarity, without names inside another's, then those over the threshold (Q20)."""
    s = s or SearchSettings()
    best = best_per_row(docs, tags.filter("is_active and vec is not null"), s.tag_top_n, other="name")
    names = best.groupBy("qid").agg(F.collect_list("name").alias("names"))
    alone = best.join(names, "qid").filter(~F.exists("names", lambda o: (o != F.col("name")) & F.contains(o, F.col("name"))))
    return alone.filter(F.col("similarity") >= s.tag_min_score).select("qid", "name", "similarity", "rank")
