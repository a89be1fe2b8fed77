"""Citations: finding reference lines, joining them to entries, matching them to papers, keeping the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.vector_index import VectorIndex


def reference_lines(lines: DataFrame, last_pages: int = 3) -> DataFrame:
    """Lines (doc, page, pos, line) after a references heading on the last pages, up to an end line."""
    w = Window.partitionBy("doc")
    near = lines.withColumn("last", F.max("page").over(w)).filter(F.col("page") > F.col("last") - last_pages).withColumn("line", T.strip(F.col("line")))
    at = F.struct("page", "pos")
    head = near.filter(F.col("line").rlike(r"(?i)^\s*(references|bibliography|works cited)\s*$")).groupBy("doc").agg(F.min(at).alias("head"))
    ends = F.lower("line").isin(*T.ENDS) | F.col("line").rlike(r"^\d+\.\s+[A-Z]")
    after = near.join(head, "doc").filter(at > F.col("head"))
    stop = after.filter(ends).groupBy("doc").agg(F.min(at).alias("stop"))
    heading = F.col("line").rlike(r"(?i)^\s*(references|bibliography|works cited)\s*$")
    return after.join(stop, "doc", "left").filter((F.col("stop").isNull() | (at < F.col("stop"))) & (F.col("line") != "") & (~heading)).select("doc", "page", "pos", "line")


def merge_lines(lines: DataFrame) -> DataFrame:
    """Entries of reference lines: a line with a year begins one unless none has begun."""
    order = Window.partitionBy("doc").orderBy("page", "pos")
    flag = F.when(F.col("line").rlike(r"\(\d{4}\)"), 1).otherwise(0)
    first = F.row_number().over(order) == 1
    grouped = lines.withColumn("entry", F.sum(F.when(first, 0).otherwise(flag)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("page", "pos", "line")))
    return grouped.groupBy("doc", "entry").agg(F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("raw"))


def best_match(citations: DataFrame, papers: VectorIndex, threshold: float = 0.15, least: float = 0.10, probes: int | None = None) -> DataFrame:
    """The most similar other paper of each citation(qid, source, title, qvec), if it reaches both bounds.

    The papers are an index, of which only what can reach the bounds is read; exact unless `probes` is given.
    """
    asked = citations.filter(F.length("title") >= 10)
    best = papers.best_per_row(asked, 1, unlike="source", least=max(threshold, least, 0.0), probes=probes)
    return best.filter(F.col("similarity") > 0)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (source, matched, raw, score, seq) with the best score of each pair; the earliest on ties, old before new."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    best = F.min_by(F.struct("raw", "score", "seq"), F.struct((-F.col("score")).alias("s"), F.col("age"), F.col("seq")))
    return both.groupBy("source", "matched").agg(best.alias("b")).select("source", "matched", "b.raw", "b.score", "b.seq")


def counts(edges: DataFrame) -> DataFrame:
    """(id, citations, matched) of each paper: outgoing edges, and distinct pairs that come in."""
    distinct = edges.filter("matched is not null").select("source", "matched").distinct()
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("citations"))
    into = distinct.groupBy(F.col("matched").alias("id")).agg(F.count("*").alias("matched"))
    return out.join(into, "id", "full").select("id", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("matched", F.lit(0)).alias("matched"))


def weighted(title_similarity, author_overlap, year_match):
    """The older score of a match (Q18)."""
    return 0.7 * title_similarity + 0.2 * author_overlap + 0.1 * year_match
