"""Context for questions about one document: retrieve, rerank, expand by pages, order, join into text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.search import nearest

#: The rule between pages and the page head of a context.
RULE, HEAD = "=" * 60, "\U0001f4c4 PAGE "


def rerank(hits: DataFrame, q: str, boost: float = 0.01) -> DataFrame:
    """hits with `overlap`, the number of words in common with q, and `score`, distance less a boost for each (Q13, U4)."""
    mine = F.array_distinct(T.words(F.lower(F.lit(q))))
    overlap = F.size(F.array_intersect(mine, F.array_distinct(T.words(F.lower("text")))))
    return hits.withColumn("overlap", overlap).withColumn("score", (1 - F.col("similarity")) - boost * F.col("overlap"))


def expand(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Distinct chunks on the pages around each hit (J8, F12, U2, W2); a hit without a page brings its whole paper.

    The band is an equi-join: each hit is dealt to the pages it wants, so no page is compared with another's chunks.
    """
    paged = hits.filter("coalesce(page, 0) <> 0").select("paper_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - window), F.col("page") + window)).alias("page")).distinct()
    whole = hits.filter("coalesce(page, 0) = 0").select("paper_id").distinct()
    near = chunks.join(paged, ["paper_id", "page"], "left_semi")
    return near.unionByName(chunks.join(whole, "paper_id", "left_semi")).dropDuplicates(["id"])


def context(chunks: DataFrame) -> DataFrame:
    """One context of each paper: chunks by page and position, a head where the page changes."""
    w = Window.partitionBy("paper_id").orderBy(F.coalesce("page", F.lit(0)), "chunk_id")
    first = F.row_number().over(w) == 1
    turned = chunks.withColumn("turn", first | ~F.col("page").eqNullSafe(F.lag("page").over(w)))
    head = F.concat(F.lit(f"\n{RULE}\n{HEAD}"), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(f"\n{RULE}\n"))
    parts = turned.withColumn("part", F.concat(F.when(F.col("turn"), head).otherwise(F.lit("")), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("p"), F.col("chunk_id").alias("c"), F.col("part").alias("part"))))
    return parts.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("context"), F.count_distinct("page").alias("pages"), F.count("*").alias("chunks"))


def answer_context(chunks: DataFrame, paper: int, q: str, query: list[float], k: int = 5, window: int = 1, boost: float = 0.01) -> DataFrame:
    """The context of a question about a paper (Q14)."""
    mine = chunks.filter(F.col("paper_id") == paper)
    return context(expand(rerank(nearest(mine, query, k), q, boost), mine, window))


def prompt(contexts: DataFrame, q: str, template: str = "Context:\n{context}\n\nQuestion: {question}\nAnswer:") -> DataFrame:
    """contexts with the prompt to hand to a generator."""
    before, _, after = template.replace("{question}", q).partition("{context}")
    return contexts.withColumn("prompt", F.concat(F.lit(before), F.col("context"), F.lit(after)))


def query_variants(q: str, reply: str, most: int = 3) -> list[str]:
    """The question and the numbered lines of a model's reply, `most` together (Q15)."""
    lines = [x.strip() for x in reply.splitlines()]
    return [q, *(x[2:].strip() for x in lines if x[:2] in ("1.", "2.", "3."))][:most]


def multi_query(chunks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Distinct chunks among the k nearest of each query(qid, qvec)."""
    from folioforge.operators.search import best_per_row

    return chunks.join(best_per_row(queries, chunks, k).select("id").distinct(), "id", "left_semi").select("id", "paper_id")


def full_text(chunks: DataFrame, sep: str = " ") -> DataFrame:
    """Texts of each paper joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "id", "text")))
    return chunks.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), sep).alias("text"))
