"""Aggregates of the insights page: histograms, trends, matrices, top lists. Ties are broken by name or id, ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(array))


def histogram(df: DataFrame, array: str, name: str) -> DataFrame:
    """How often each element occurs."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n rows with the largest `by`."""
    return df.orderBy(F.desc_nulls_last(by), F.asc_nulls_last(tie)).limit(n)


def per_year(papers: DataFrame, year: str = "year") -> DataFrame:
    """Items of each year; no year and year 0 don't count."""
    return papers.filter(F.col(year).isNotNull() & (F.col(year) != 0)).groupBy(year).agg(F.count("*").alias("n"))


def citation_counts(edges: DataFrame, key: str = "matched") -> DataFrame:
    """Edges of each matched item (A4); null keys dropped."""
    return edges.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def author_averages(authorships: DataFrame, counts: DataFrame, paper: str = "id", author: str = "author") -> DataFrame:
    """Papers and mean citations of each author; uncited papers count as 0."""
    joined = authorships.join(counts.select(F.col("matched").alias(paper), F.col("n").alias("cites")), paper, "left")
    return joined.groupBy(author).agg(F.count("*").alias("papers"), F.bround(F.avg(F.coalesce("cites", F.lit(0))), 2).alias("avg_cites"))


def tag_year_trend(papers: DataFrame, tags: int = 5) -> DataFrame:
    """Papers of the most frequent tags by year, zero-filled; a paper counts once per tag (A12). One pass, no cell queries."""
    once = papers.filter("year is not null and year <> 0").select("id", "year", F.explode(F.array_distinct("tags")).alias("tag"))
    best = top(papers.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")), "n", "tag", tags).select("tag")
    spine = best.crossJoin(papers.filter("year is not null and year <> 0").select("year").distinct())  # tags x years, both bounded
    return spine.join(once.groupBy("tag", "year").agg(F.count("*").alias("n")), ["tag", "year"], "left").select("tag", "year", F.coalesce("n", F.lit(0)).alias("n"))


def college_program_matrix(papers: DataFrame, programs: int = 5) -> DataFrame:
    """Papers by college and each of the most frequent programs, zero-filled."""
    counts = papers.groupBy("college", "program").agg(F.count("*").alias("n"))
    best = top(counts.groupBy("program").agg(F.sum("n").alias("n")), "n", "program", programs).select("program")
    spine = counts.select("college").distinct().crossJoin(best)
    return spine.join(counts, ["college", "program"], "left").select("college", "program", F.coalesce("n", F.lit(0)).alias("n"))


def by_declared(papers: DataFrame, declared: DataFrame, key: str = "college") -> DataFrame:
    """Items of each declared group, empty ones kept."""
    return declared.join(papers.groupBy(key).agg(F.count("id").alias("n"), F.min("id").alias("first_id")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "first_id")


def totals(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Items, registered ones, edges, matched edges, sum of cached counts, and the item with the largest one (A1-A3)."""
    p = papers.agg(
        F.count("*").alias("items"), F.count_if("registered").alias("registered"), F.coalesce(F.sum("cites_cached"), F.lit(0)).alias("sum_cached"),
        F.min_by("id", F.struct(-F.col("cites_cached"), F.col("id"))).alias("most_cited"),
    )
    e = edges.agg(F.count("*").alias("edges"), F.count("matched").alias("matched_edges"))
    return p.crossJoin(e)  # one row each
