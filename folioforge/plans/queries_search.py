"""Keyword, full-text, vector and hybrid search, tags, citations by similarity, contexts for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.config import SearchSettings
from folioforge.functions import vectors as V
from folioforge.functions.text import contains_ci, occurrences
from folioforge.operators import citations, rag, search
from folioforge.operators.text_index import TextIndex, TrigramIndex
from folioforge.operators.vector_index import VectorIndex
from folioforge.plans.queries_aggregate import PAPERS, q
from folioforge.plans.registry import ORACLES, register
from folioforge.sources import tables as S
from folioforge.sources.scratch import fresh

#: Chunks with a vector: documents and embeddings of the same number.
CHUNKS = "c AS (SELECT doc_id AS id, source AS paper_id, text, embedding AS vec FROM documents JOIN embeddings ON doc_id = vec_id)"
TERMS = "w AS (SELECT id, paper_id, vec, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM c)"
VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"
SIM = f"list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST({VEC} AS DOUBLE[]))"
E0 = "e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS paper_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def chunks(spark, d):
    return S.chunks(spark, d).join(S.vectors(spark, d).select("id", "vec"), "id")


def query_vector(spark, d) -> list[float]:
    return S.vectors(spark, d).filter("id = 3").first()["vec"]


def indexed(spark, d, rounds: int = 1) -> VectorIndex:
    """An index of all vectors, made anew."""
    return VectorIndex.build(S.vectors(spark, d), fresh(spark, "vectors"), rounds=rounds)


def bm25_sql(terms: list[str], source: str = "w") -> str:
    """CTEs of the rank of `terms`, all of which a chunk must have."""
    tf = ", ".join(f"CAST(len(list_filter(terms, lambda t: t = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    rank = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"x AS (SELECT id, paper_id, vec, len(terms) AS length, {tf} FROM {source}), st AS (SELECT count(*) AS docs, avg(length) AS mean, {df} FROM x), r AS (SELECT id, paper_id, vec, {rank} AS rank FROM x, st WHERE {every})"


@register(
    "keyword_search",
    "WITH k AS (SELECT source AS paper_id, doc_id, text, len(regexp_extract_all(text, '(?i)tion')) AS n FROM documents WHERE contains(lower(text), 'tion')) "
    "SELECT paper_id, CAST(sum(n) AS DOUBLE) AS score, regexp_replace(arg_min(text, doc_id), '(tion)', '<mark>\\1</mark>', 'gi') AS snippet FROM k GROUP BY paper_id ORDER BY score DESC, paper_id LIMIT 5",
)
def keyword_search(spark, d):
    """Q1, A19, F6."""
    return search.keyword(S.chunks(spark, d), "tion", 5)


@register("keyword_by_trigrams", ORACLES["keyword_search"])
def keyword_by_trigrams(spark, d):
    """Q1, F6 from an index of trigrams."""
    c = S.chunks(spark, d)
    return search.keyword(c, "tion", 5, index=TrigramIndex.build(c, fresh(spark, "trigrams")))


@register("substring_hits", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'ing the')")
def substring_hits(spark, d):
    """every text with a run of characters across words."""
    c = S.chunks(spark, d).select("id", "text")
    return TrigramIndex.build(c, fresh(spark, "trigrams")).containing(c, "ING the").select("id")


@register("keyword_counts", "SELECT doc_id AS id, len(regexp_extract_all(text, '(?i)the')) AS n FROM documents")
def keyword_counts(spark, d):
    """Q1: occurrences of every document."""
    return S.chunks(spark, d).select("id", occurrences("text", "the").alias("n"))


@register("fts_bm25", q(CHUNKS.replace(" JOIN embeddings ON doc_id = vec_id", "").replace("embedding AS vec", "NULL AS vec"), TERMS, bm25_sql(["and", "the"]), select="SELECT id, round(rank, 6) AS rank FROM r ORDER BY rank DESC, id LIMIT 20"))
def fts_bm25(spark, d):
    """Q4, F14, T4."""
    return search.bm25(S.chunks(spark, d), "The and").orderBy(F.desc("rank"), "id").limit(20).select("id", F.round("rank", 6).alias("rank"))


@register("postings", q(CHUNKS.replace(" JOIN embeddings ON doc_id = vec_id", "").replace("embedding AS vec", "NULL AS vec"), TERMS, select="SELECT id, length, term, count(*) AS tf FROM (SELECT id, CAST(len(terms) AS INTEGER) AS length, unnest(terms) AS term FROM w) GROUP BY id, length, term"))
def postings(spark, d):
    """The index that Q4 may be kept as."""
    return search.postings(S.chunks(spark, d)).select("id", "length", "term", "tf")


WORDS = CHUNKS.replace(" JOIN embeddings ON doc_id = vec_id", "").replace("embedding AS vec", "NULL AS vec")
RANKED = "SELECT id, round(rank, 6) AS rank FROM r ORDER BY rank DESC, id LIMIT 20"


def text_index(spark, d, analyzer: str = "simple") -> TextIndex:
    """An index of all chunks' texts, made anew."""
    return TextIndex.build(S.chunks(spark, d), fresh(spark, "text-index"), analyzer)


def rounded(ranked):
    return ranked.select("id", F.round("rank", 6).alias("rank"))


@register("fts_by_postings", q(WORDS, TERMS, bm25_sql(["and", "the"]), select=RANKED))
def fts_by_postings(spark, d):
    """Q4, T4 from a kept index: the best by block pruning."""
    return rounded(text_index(spark, d).best("The and", 20))


#: Words with the stems one and ore.
STEMS = "list_transform(terms, lambda t: CASE WHEN regexp_full_match(t, 'on(e|es|ed|edly|ing|ingly)') THEN 'one' WHEN regexp_full_match(t, 'or(e|es|ed|edly|ing|ingly)') THEN 'ore' ELSE t END)"


@register("fts_stemmed", q(WORDS, TERMS, f"y AS (SELECT id, paper_id, vec, {STEMS} AS terms FROM w)", bm25_sql(["one", "ore"], "y"), select=RANKED))
def fts_stemmed(spark, d):
    """Q4, F14 as the reference's configuration has it: English stems, stop words left out."""
    return rounded(text_index(spark, d, "english").best("The oning and ores", 20))


@register("fts_all_hits", q(WORDS, TERMS, f"y AS (SELECT id, paper_id, vec, {STEMS} AS terms FROM w)", bm25_sql(["one", "ore"], "y"), select="SELECT id, round(rank, 6) AS rank FROM r"))
def fts_all_hits(spark, d):
    """every text with both stems."""
    return rounded(text_index(spark, d, "english").ranked("ored ones"))


@register("fts_phrase", q(WORDS, TERMS, bm25_sql(["and", "the"]), "p AS (SELECT r.* FROM r JOIN w USING (id) WHERE list_contains(list_transform(range(1, len(terms)), lambda i: terms[i] = 'and' AND terms[i + 1] = 'the'), true))", select=RANKED.replace("FROM r", "FROM p")))
def fts_phrase(spark, d):
    """Q4: words next to each other, by their positions."""
    return rounded(text_index(spark, d).best("and the", 20, phrase=True))


@register(
    "hybrid_search",
    q(
        CHUNKS, TERMS, bm25_sql(["and", "the"]), f"k AS (SELECT id, paper_id, rank, {SIM} AS sim FROM r ORDER BY rank DESC, id LIMIT 20)",
        "m AS (SELECT min(rank) AS r0, max(rank) AS r1, min(sim) AS s0, max(sim) AS s1 FROM k)",
        "h AS (SELECT id, paper_id, rank, 0.5 * CASE WHEN r1 = r0 THEN 1.0 ELSE (rank - r0) / (r1 - r0) END + 0.5 * CASE WHEN s1 = s0 THEN 1.0 ELSE (sim - s0) / (s1 - s0) END AS score FROM k, m)",
        "b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, rank DESC, id) AS n FROM h WHERE score >= 0.25)",
        select="SELECT paper_id, id, round(score, 4) AS score FROM b WHERE n = 1 ORDER BY round(score, 4) DESC, rank DESC, id LIMIT 5",
    ),
)
def hybrid_search(spark, d):
    """Q2, Q5, A20, A23, W4, T5."""
    return search.hybrid(chunks(spark, d), "the and", query_vector(spark, d))


@register("hybrid_by_index", ORACLES["hybrid_search"])
def hybrid_by_index(spark, d):
    """Q2 with candidates from a kept index."""
    both = chunks(spark, d)
    return search.hybrid(both, "the and", query_vector(spark, d), index=TextIndex.build(both, fresh(spark, "text-index"), "simple"))


@register("semantic_fallback", q(CHUNKS, f"k AS (SELECT id, paper_id, {SIM} AS sim FROM c ORDER BY sim DESC, id LIMIT 5)", select="SELECT paper_id, id, round(sim, 4) AS score FROM k WHERE sim >= 0.25"))
def semantic_fallback(spark, d):
    """Q3, Q11: no chunk has the term, so vectors decide."""
    return search.semantic(chunks(spark, d), "nosuchterm", query_vector(spark, d))


@register("vector_search_topk", q(E0, select=f"SELECT id, round({SIM}, 4) AS similarity FROM e ORDER BY {SIM} DESC, id LIMIT 10"))
def vector_search_topk(spark, d):
    """J9, Q6."""
    return search.nearest(S.vectors(spark, d), query_vector(spark, d), 10).select("id", F.round("similarity", 4).alias("similarity"))


@register("vector_index_topk", q(E0, select=f"SELECT id, paper_id, round({SIM}, 4) AS similarity FROM e ORDER BY {SIM} DESC, id LIMIT 10"))
def vector_index_topk(spark, d):
    """J9, Q6, Q3 from the index: exact, but only lists that can hold one of the best are read."""
    return indexed(spark, d, rounds=3).nearest(query_vector(spark, d), 10).select("id", "paper_id", F.round("similarity", 4).alias("similarity"))


@register("cosine_eps", q(E0, select="SELECT id, round(list_dot_product(vec, v) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(v, v)) + 1e-8), 5) AS similarity FROM e, (SELECT vec AS v FROM e WHERE id = 3)"))
def cosine_eps(spark, d):
    """Q7."""
    one = F.array(*(F.lit(float(x)) for x in query_vector(spark, d)))
    return S.vectors(spark, d).select("id", F.round(V.cosine_eps("vec", one), 5).alias("similarity"))


@register("search_postfilter", q(E0, f"k AS (SELECT id, paper_id, {SIM} AS sim FROM e ORDER BY sim DESC, id LIMIT 10)", select="SELECT id, paper_id FROM k WHERE paper_id IN (1, 2, 3)"))
def search_postfilter(spark, d):
    """J6, trap 4: filters come after the top k."""
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    return search.post_filtered(search.nearest(S.vectors(spark, d), query_vector(spark, d), 10), papers).select("id", "paper_id")


@register(
    "knn_per_query_top3",
    q(E0, "p AS (SELECT a.id AS qid, b.id, list_cosine_similarity(a.vec, b.vec) AS sim FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)", select="SELECT qid, id, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS n FROM p) WHERE n <= 3"),
)
def knn_per_query_top3(spark, d):
    """J10, W1."""
    v = S.vectors(spark, d)
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return indexed(spark, d).best_per_row(asked, 3, unlike="qid").select("qid", "id", F.round("similarity", 4).alias("similarity"))


@register("related_items", q(E0, f"k AS (SELECT id, paper_id, {SIM} AS sim FROM e WHERE paper_id <> 0 ORDER BY sim DESC, id LIMIT 25)", select="SELECT 'paper ' || paper_id AS title, round(max(sim), 4) AS similarity FROM k GROUP BY paper_id HAVING max(sim) >= 0.1 ORDER BY max(sim) DESC, title LIMIT 5"))
def related_items(spark, d):
    """Q16, T11, F13."""
    v = S.vectors(spark, d).withColumn("title", F.concat(F.lit("paper "), F.col("paper_id").cast("string")))
    return search.related(v, 0, query_vector(spark, d)).select("title", F.round("similarity", 4).alias("similarity"))


@register(
    "tag_extraction",
    q(
        E0, "g AS (SELECT CASE id WHEN 0 THEN 'deep' WHEN 1 THEN 'deep learning' WHEN 2 THEN 'learning' ELSE 'tag' || id END AS name, vec FROM e WHERE id < 12)",
        "p AS (SELECT e.id AS qid, g.name, list_cosine_similarity(e.vec, g.vec) AS sim FROM e JOIN g ON true)",
        "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, name) AS n FROM p) WHERE n <= 5)",
        select="SELECT qid, name, round(sim, 4) AS similarity, CAST(n AS INTEGER) AS rank FROM b WHERE sim >= 0.1 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.qid = b.qid AND o.name <> b.name AND contains(o.name, b.name))",
    ),
)
def tag_extraction(spark, d):
    """Q20, Q21, J11, T6, trap 8."""
    v = S.vectors(spark, d)
    name = F.when(F.col("id") == 0, "deep").when(F.col("id") == 1, "deep learning").when(F.col("id") == 2, "learning").otherwise(F.concat(F.lit("tag"), F.col("id").cast("string")))
    tags = v.filter("id < 12").select(name.alias("name"), "vec", F.lit(True).alias("is_active"))
    docs = v.select(F.col("id").alias("qid"), F.coalesce(F.lit(None).cast("array<float>"), "vec").alias("qvec"))
    return search.extract_tags(docs, tags, SearchSettings(tag_min_score=0.1)).select("qid", "name", F.round("similarity", 4).alias("similarity"), "rank")


@register(
    "citation_best_match",
    q(E0, "p AS (SELECT a.id AS qid, b.id, list_cosine_similarity(a.vec, b.vec) AS sim FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0)", select="SELECT qid, id, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS n FROM p) WHERE n = 1 AND sim >= 0.15"),
)
def citation_best_match(spark, d):
    """Q17, Q19, J10, F17."""
    v = S.vectors(spark, d)
    cites = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("id").alias("source"), F.lit("a title of enough letters").alias("title"), F.col("vec").alias("qvec"))
    return citations.best_match(cites, indexed(spark, d)).select("qid", "id", F.round("similarity", 4).alias("similarity"))


AUTOCOMPLETE = q(PAPERS, "a AS (SELECT DISTINCT s_name AS author FROM supplier)", select="SELECT 'paper' AS kind, title AS value FROM (SELECT title FROM p WHERE contains(lower(title), 'sm') ORDER BY id LIMIT 5) UNION ALL SELECT 'author', author FROM (SELECT author FROM a WHERE contains(lower(author), 'sm') ORDER BY author LIMIT 5)")


def titles_and_names(spark, d):
    papers = S.papers(spark, d).withColumn("authors", F.array().cast("array<string>"))
    names = S.table(spark, d, "supplier").select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("title"), F.array("s_name").alias("authors"))
    return papers.select("id", "title", "authors").unionByName(names)


@register("autocomplete", AUTOCOMPLETE)
def autocomplete(spark, d):
    """Q12, U6, T3."""
    return search.autocomplete(titles_and_names(spark, d), "sm")


@register("autocomplete_by_trigrams", AUTOCOMPLETE.replace("'sm'", "'ste'"))
def autocomplete_by_trigrams(spark, d):
    """Q12 with an index of the titles' trigrams."""
    papers = titles_and_names(spark, d)
    return search.autocomplete(papers, "STE", index=TrigramIndex.build(papers.filter("title is not null"), fresh(spark, "trigrams"), "title"))


@register(
    "rerank_overlap",
    "WITH w AS (SELECT conv_id * 1000 + turn AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS words FROM conversations) SELECT id, CAST(len(list_intersect(words, ['the', 'and', 'of'])) AS INTEGER) AS overlap, CAST(round(0.5 - 0.01 * len(list_intersect(words, ['the', 'and', 'of'])), 4) AS DOUBLE) AS score FROM w",
)
def rerank_overlap(spark, d):
    """Q13, U4."""
    return rag.rerank(S.turns(spark, d).withColumn("similarity", F.lit(0.5)), "The and of").select("id", "overlap", F.round("score", 4).alias("score"))


TURNS = "t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS paper_id, CAST(floor(turn / 2 + 1) AS INTEGER) AS page, turn AS chunk_id, text FROM conversations)"


@register("rag_context_expand", q(TURNS, select="SELECT DISTINCT c.id, c.paper_id, c.page FROM t c JOIN t h ON c.paper_id = h.paper_id AND c.page BETWEEN greatest(1, h.page - 1) AND h.page + 1 WHERE contains(lower(h.text), 'tion')"))
def rag_context_expand(spark, d):
    """J8, F12, U2, W2."""
    t = S.turns(spark, d)
    return rag.expand(t.filter(contains_ci("text", "tion")), t).select("id", "paper_id", "page")


@register(
    "rag_context_text",
    q(
        TURNS, "l AS (SELECT *, lag(page) OVER (PARTITION BY paper_id ORDER BY page, chunk_id) IS DISTINCT FROM page AS turned FROM t)",
        select="SELECT paper_id, md5(string_agg(CASE WHEN turned THEN chr(10) || repeat('=', 60) || chr(10) || '📄 PAGE ' || page || chr(10) || repeat('=', 60) || chr(10) ELSE '' END || text, chr(10) ORDER BY page, chunk_id)) AS context_md5, count(DISTINCT page) AS pages, count(*) AS chunks FROM l GROUP BY paper_id",
    ),
)
def rag_context_text(spark, d):
    """Q14, T7, W3, A25, X23."""
    c = rag.context(S.turns(spark, d))
    return c.select("paper_id", F.md5("context").alias("context_md5"), "pages", "chunks")


@register("paper_full_text", "SELECT conv_id AS paper_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def paper_full_text(spark, d):
    """A24, X24."""
    return rag.full_text(S.turns(spark, d)).select("paper_id", F.md5("text").alias("text_md5"))


@register("multi_query_union", q(E0, "p AS (SELECT a.id AS qid, b.id, b.paper_id, list_cosine_similarity(a.vec, b.vec) AS sim FROM e a JOIN e b ON true WHERE a.id IN (1, 2, 3))", select="SELECT DISTINCT id, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS n FROM p) WHERE n <= 3"))
def multi_query_union(spark, d):
    """Q15, U1."""
    v = S.vectors(spark, d)
    return rag.multi_query(v, v.filter("id in (1, 2, 3)").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")))
