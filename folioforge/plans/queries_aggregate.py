"""Insights, counters and changes to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import citations, dml, insights
from folioforge.operators.kept import KeptTable
from folioforge.plans.registry import ORACLES, register
from folioforge.sources import tables as S
from folioforge.sources.scratch import fresh

PAPERS = "p AS (SELECT p_partkey AS id, p_name AS title, p_brand AS college, p_type AS program, p_size AS year, string_split(p_name, ' ') AS tags, CAST(floor(p_retailprice) AS BIGINT) AS cites_cached, p_partkey % 3 = 0 AS registered FROM part)"
TAGS = "t AS (SELECT id, unnest(tags) AS tag, year FROM p)"
EDGES = "e AS (SELECT l_orderkey AS source, l_partkey AS matched, CAST(l_shipdate AS VARCHAR) AS raw, l_extendedprice AS score, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem)"
AUTHORS = "a AS (SELECT l_partkey AS id, s_name AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
RECENT = "v AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, ts, event_type FROM events)"


def q(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


@register("insights_tag_counts", q(PAPERS, TAGS, select="SELECT tag, count(*) AS n FROM t GROUP BY tag"))
def insights_tag_counts(spark, d):
    """A5, S1."""
    return insights.histogram(S.papers(spark, d), "tags", "tag")


@register("insights_top_tags_20", q(PAPERS, TAGS, select="SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 20"))
def insights_top_tags_20(spark, d):
    """A6, T10."""
    return insights.top(insights.histogram(S.papers(spark, d), "tags", "tag"), "n", "tag", 20)


@register("insights_items_per_year", q(PAPERS, select="SELECT year, count(*) AS n FROM p WHERE year IS NOT NULL AND year <> 0 GROUP BY year"))
def insights_items_per_year(spark, d):
    """A7."""
    return insights.per_year(S.papers(spark, d))


@register("insights_author_counts", q(AUTHORS, select="SELECT author, count(*) AS n FROM a GROUP BY author"))
def insights_author_counts(spark, d):
    """A8."""
    return S.authorships(spark, d).groupBy("author").agg(F.count("*").alias("n"))


@register("insights_top_authors", q(AUTHORS, select="SELECT author, count(*) AS n FROM a GROUP BY author ORDER BY n DESC, author LIMIT 10"))
def insights_top_authors(spark, d):
    """A10, A11."""
    return insights.top(insights_author_counts(spark, d), "n", "author", 10)


@register(
    "insights_author_avg_citations",
    q(AUTHORS, EDGES, "c AS (SELECT matched, count(*) AS n FROM e GROUP BY matched)", select="SELECT author, count(*) AS papers, round(sum(coalesce(n, 0)) / count(*), 4) AS avg_cites FROM a LEFT JOIN c ON a.id = c.matched GROUP BY author"),
)
def insights_author_avg_citations(spark, d):
    """A9, J13."""
    counts = insights.citation_counts(S.edges(spark, d))
    cites = S.authorships(spark, d).join(counts.select(F.col("matched").alias("id"), F.col("n").alias("cites")), "id", "left")
    return cites.groupBy("author").agg(F.count("*").alias("papers"), F.round(F.avg(F.coalesce("cites", F.lit(0))), 4).alias("avg_cites"))


@register(
    "insights_tag_year_trend",
    q(
        PAPERS, TAGS, "b AS (SELECT tag FROM t GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 5)", "y AS (SELECT DISTINCT year FROM p WHERE year <> 0)",
        select="SELECT b.tag, y.year, count(DISTINCT t.id) AS n FROM b CROSS JOIN y LEFT JOIN t ON t.tag = b.tag AND t.year = y.year GROUP BY b.tag, y.year",
    ),
)
def insights_tag_year_trend(spark, d):
    """A12."""
    return insights.tag_year_trend(S.papers(spark, d))


@register(
    "insights_college_program_matrix",
    q(
        PAPERS, "b AS (SELECT program FROM p GROUP BY program ORDER BY count(*) DESC, program LIMIT 5)", "c AS (SELECT DISTINCT college FROM p)",
        select="SELECT c.college, b.program, count(p.id) AS n FROM c CROSS JOIN b LEFT JOIN p ON p.college = c.college AND p.program = b.program GROUP BY c.college, b.program",
    ),
)
def insights_college_program_matrix(spark, d):
    """A13, T10."""
    return insights.college_program_matrix(S.papers(spark, d))


@register("insights_items_per_college", q(PAPERS, select="SELECT college, count(*) AS n FROM p GROUP BY college"))
def insights_items_per_college(spark, d):
    """A14."""
    return S.papers(spark, d).groupBy("college").agg(F.count("*").alias("n"))


@register("insights_top_cited", q(EDGES, PAPERS, "c AS (SELECT matched, count(*) AS n FROM e WHERE matched IS NOT NULL GROUP BY matched ORDER BY n DESC, matched LIMIT 10)", select="SELECT id, title, n FROM c JOIN p ON p.id = c.matched"))
def insights_top_cited(spark, d):
    """A4, A15, J14."""
    best = insights.top(insights.citation_counts(S.edges(spark, d)), "n", "matched", 10)
    return best.join(S.papers(spark, d), best.matched == F.col("id")).select("id", "title", "n")


@register(
    "insights_totals",
    q(PAPERS, EDGES, select="SELECT (SELECT count(*) FROM p) AS items, (SELECT count(*) FROM p WHERE registered) AS registered, (SELECT CAST(coalesce(sum(cites_cached), 0) AS BIGINT) FROM p) AS sum_cached, (SELECT id FROM p ORDER BY cites_cached DESC, id LIMIT 1) AS most_cited, (SELECT count(*) FROM e) AS edges, (SELECT count(matched) FROM e) AS matched_edges"),
)
def insights_totals(spark, d):
    """A1, A2, A3."""
    return insights.totals(S.papers(spark, d), S.edges(spark, d))


@register("insights_declared_colleges", q(PAPERS, "c AS (SELECT 'Brand#' || a || b AS college FROM range(1, 7) x(a), range(1, 7) y(b))", select="SELECT c.college, count(p.id) AS n, min(p.id) AS first_id FROM c LEFT JOIN p ON p.college = c.college GROUP BY c.college"))
def insights_declared_colleges(spark, d):
    """Declared groups, empty ones kept."""
    declared = spark.range(6, 42).select(F.concat(F.lit("Brand#"), F.floor(F.col("id") / 6).cast("string"), (F.col("id") % 6 + 1).cast("string")).alias("college"))
    return insights.by_declared(S.papers(spark, d), declared)


@register("tags_sorted_union", q(PAPERS, TAGS, select="SELECT DISTINCT tag FROM t ORDER BY tag"))
def tags_sorted_union(spark, d):
    """A17."""
    return S.papers(spark, d).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@register("tag_paper_counts", q(PAPERS, "n AS (SELECT DISTINCT unnest(string_split(lower(p_type) || ' ' || p_name, ' ')) AS tag FROM part)", select="SELECT n.tag, count(p.id) AS n FROM n LEFT JOIN p ON list_contains(p.tags, n.tag) GROUP BY n.tag"))
def tag_paper_counts(spark, d):
    """Papers of each tag of a list, 0 for unused ones; one explode and an equi-join."""
    names = S.table(spark, d, "part").select(F.explode(F.split(F.concat(F.lower("p_type"), F.lit(" "), "p_name"), " ")).alias("tag")).distinct()
    once = S.papers(spark, d).select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return names.join(once, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


@register("citation_counts", q(EDGES, "o AS (SELECT source AS id, count(*) AS citations FROM e GROUP BY source)", "i AS (SELECT matched AS id, count(DISTINCT source) AS matched FROM e GROUP BY matched)", select="SELECT coalesce(o.id, i.id) AS id, coalesce(citations, 0) AS citations, coalesce(matched, 0) AS matched FROM o FULL JOIN i ON o.id = i.id"))
def citation_counts(spark, d):
    """A22, trap 9."""
    return citations.counts(S.edges(spark, d))


@register("citation_upsert_max", q(EDGES, select="SELECT source, matched, raw, score, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, matched ORDER BY score DESC, seq % 2, seq) AS n FROM e) WHERE n = 1"))
def citation_upsert_max(spark, d):
    """Edges with even numbers are old, those with odd ones new."""
    e = S.edges(spark, d)
    return citations.upsert(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1"))


@register("kept_upsert_max", ORACLES["citation_upsert_max"])
def kept_upsert_max(spark, d):
    """A21, M7 in a kept table: two changes that write deltas only, merged as it is read."""
    e = S.edges(spark, d)
    kept = KeptTable.create(spark, fresh(spark, "edges"), "source long, matched long, raw string, score double, seq long", ["source", "matched"], "best:score", buckets=8)
    for rest in (0, 1):
        some = e.filter(F.col("seq") % 2 == rest)
        kept.upsert(citations.upsert(some.limit(0), some))
    return kept.read()


@register("kept_get_or_create", "SELECT user_id, paper_id, min(src) AS src FROM (SELECT o_custkey AS user_id, o_orderkey % 50 AS paper_id, o_orderstatus AS src FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY user_id, paper_id")
def kept_get_or_create(spark, d):
    """M1 in a kept table: later changes add only rows whose keys are new; after them the table is compacted."""
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("paper_id"), F.col("o_orderstatus").alias("src"))
    kept = KeptTable.create(spark, fresh(spark, "saved"), "user_id long, paper_id long, src string", ["user_id", "paper_id"], "first", buckets=8)
    for status in ("F", "O"):
        kept.upsert(o.filter(F.col("src") == status).distinct())
    kept.compact()
    return kept.read()


@register("kept_update_delete", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0")
def kept_update_delete(spark, d):
    """M5, M7, M8 in a kept table: rows are replaced, removed, and some of these put back."""
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    kept = KeptTable.create(spark, fresh(spark, "orders"), "id long, status string", ["id"], buckets=8)
    kept.upsert(o)
    kept.delete(o.filter("id % 7 = 0"))
    kept.upsert(o.filter("id % 14 = 0"))
    kept.compact()
    kept.upsert(o.filter("id % 3 = 0 and (id % 7 <> 0 or id % 14 = 0)").withColumn("status", F.lit("new")))
    return kept.read()


WEIGHTED = "CAST(0.7 AS DOUBLE) * (score / CAST(100000 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * ((seq % 3) / CAST(2 AS DOUBLE)) + CAST(0.1 AS DOUBLE) * CAST(matched % 2 AS DOUBLE)"


@register("citation_weighted_score", q(EDGES, select=f"SELECT source, matched, seq, {WEIGHTED} AS score FROM e WHERE {WEIGHTED} >= CAST(0.75 AS DOUBLE)"))
def citation_weighted_score(spark, d):
    """Q18."""
    e = S.edges(spark, d)
    score = citations.weighted(F.col("score") / 100000, (F.col("seq") % 3) / 2, F.col("matched") % 2)
    return e.filter(score >= 0.75).select("source", "matched", "seq", score.alias("score"))


@register("view_counts", q(RECENT, select="SELECT item, count(*) AS views FROM v WHERE event_type = 'view' GROUP BY item"))
def view_counts(spark, d):
    """R2 as a batch."""
    from folioforge.streaming.counters import view_counts as count

    return count(S.events(spark, d).filter("event_type = 'view'"))


@register("mru_recents", q(RECENT, "l AS (SELECT user_id, item, max(ts) AS ts FROM v GROUP BY user_id, item)", select="SELECT user_id, item, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS rank FROM l) WHERE rank <= 10"))
def mru_recents(spark, d):
    """W9, R3 as a batch."""
    return dml.recents(S.events(spark, d)).select("user_id", "item", "rank")


@register("tag_upsert", q("o AS (SELECT DISTINCT lower(p_type) AS name, 'old' AS description FROM part)", "f AS (SELECT name, max(d) AS fresh FROM (SELECT lower(trim(p_type)) AS name, nullif(CASE WHEN p_size > 25 THEN 'new' || p_size ELSE '' END, '') AS d FROM part UNION ALL SELECT lower(p_brand), 'brand' FROM part) GROUP BY name)", select="SELECT coalesce(o.name, f.name) AS name, coalesce(fresh, description) AS description FROM o FULL JOIN f ON o.name = f.name"))
def tag_upsert(spark, d):
    """M2."""
    part = S.table(spark, d, "part")
    old = part.select(F.lower("p_type").alias("name"), F.lit("old").alias("description")).distinct()
    sizes = F.when(F.col("p_size") > 25, F.concat(F.lit("new"), F.col("p_size").cast("string"))).otherwise("")
    new = part.select(F.col("p_type").alias("name"), sizes.alias("description")).union(part.select("p_brand", F.lit("brand")))
    return dml.upsert_tags(old, new)


@register("tag_rename_guard", q("t AS (SELECT DISTINCT p_brand AS name FROM part)", select="SELECT CASE WHEN name = 'Brand#12' THEN 'Renamed' ELSE name END AS name FROM t"))
def tag_rename_guard(spark, d):
    """M3: one name is free, the other taken."""
    tags = S.table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    return dml.rename_tag(dml.rename_tag(tags, "Brand#12", "Renamed"), "Brand#13", "Brand#21")


@register("saved_get_or_create", "SELECT user_id, paper_id, min(src) AS src FROM (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 50 AS paper_id, 'a' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT o_custkey, o_orderkey % 50, 'b' FROM orders WHERE o_orderstatus <> 'F') GROUP BY user_id, paper_id")
def saved_get_or_create(spark, d):
    """M1."""
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("paper_id"), "o_orderstatus")
    make = lambda df, src: df.select("user_id", "paper_id", F.lit(src).alias("src")).distinct()
    return dml.get_or_create(make(o.filter("o_orderstatus = 'F'"), "a"), make(o.filter("o_orderstatus <> 'F'"), "b"), "user_id", "paper_id")


@register("delete_cascade", q(EDGES, select="SELECT source, CASE WHEN matched % 11 = 0 THEN NULL ELSE matched END AS matched, seq FROM e WHERE source % 7 <> 0"))
def delete_cascade(spark, d):
    """M5: sources that go take their edges along, matched ones that go leave a null."""
    e = S.edges(spark, d).select("source", "matched", "seq")
    gone = S.table(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    unmatched = S.papers(spark, d).filter("id % 11 = 0").select("id")
    return dml.set_null(dml.cascade(e, gone, "source"), unmatched, "matched").select("source", "matched", "seq")


@register("embedding_backfill", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN vec_id * 10 ELSE vec_id END AS value FROM embeddings")
def embedding_backfill(spark, d):
    """M9: nulls are filled, the rest stays."""
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    old = e.select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("value"))
    return dml.backfill(old, e.select("id", (F.col("id") * 10).alias("value")), "id", "value")


@register("reindex_papers", "SELECT doc_id AS id, source AS paper_id, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS age FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0")
def reindex_papers(spark, d):
    """M8."""
    c = S.chunks(spark, d).select("id", "paper_id")
    fresh = c.filter("paper_id in ('src1', 'src2') and id % 3 = 0").withColumn("age", F.lit("new"))
    return dml.reindex(c.withColumn("age", F.lit("old")), fresh)


@register("register_toggle_reset", q(PAPERS, select="SELECT id, NOT registered AS registered, CASE WHEN id % 2 = 0 THEN 'complete' ELSE 'pending' END AS status, CAST(NULL AS VARCHAR) AS summary FROM p"))
def register_toggle_reset(spark, d):
    """M4, M6, M11."""
    p = S.papers(spark, d).select("id", "registered", F.lit("pending").alias("status"), F.col("title").alias("summary"))
    done = dml.set_where(dml.toggle(p, F.lit(True), "registered"), F.col("id") % 2 == 0, status=F.lit("complete"))
    return dml.set_where(done, F.lit(True), summary=F.lit(None).cast("string"))


@register("outcome_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders")
def outcome_counts(spark, d):
    """A26."""
    return dml.outcome_counts(S.table(spark, d, "orders"), "o_orderstatus", "F", "O", "P")


@register("extra_rollup", "SELECT p_brand AS college, p_type AS program, count(*) AS n, CAST(grouping(p_brand) + grouping(p_type) AS INTEGER) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)")
def extra_rollup(spark, d):
    """Beyond the inventory: grouping sets."""
    p = S.papers(spark, d)
    return p.rollup("college", "program").agg(F.count("*").alias("n"), (F.grouping("college") + F.grouping("program")).cast("int").alias("level"))
