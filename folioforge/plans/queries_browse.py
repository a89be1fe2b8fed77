"""Scans, filters, joins, sets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import browse, search
from folioforge.operators.page_index import PageIndex
from folioforge.plans.queries_aggregate import EDGES, PAPERS, q
from folioforge.plans.registry import register
from folioforge.sources import files
from folioforge.sources import tables as S
from folioforge.sources.scratch import fresh

SAVED = "s AS (SELECT o_custkey AS user_id, o_orderkey % 200 + 1 AS paper_id, max(o_orderdate) AS saved_at FROM orders GROUP BY 1, 2)"


def saved(spark, d):
    o = S.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 200 + 1).alias("paper_id")).agg(F.max("o_orderdate").alias("saved_at"))


@register("browse_filtered", q(PAPERS, select="SELECT id, title FROM p WHERE year = 7 AND (list_contains(tags, 'small') OR list_contains(tags, 'red'))"))
def browse_filtered(spark, d):
    """F1-F3, S2, S3."""
    return browse.filtered(S.papers(spark, d), browse.Request(year="7", tags=("small", "red"))).select("id", "title")


@register("browse_bad_year_ignored", q(PAPERS, select="SELECT id FROM p WHERE program = (SELECT min(program) FROM p)"))
def browse_bad_year_ignored(spark, d):
    """a year that is no number filters nothing."""
    p = S.papers(spark, d)
    return browse.filtered(p, browse.Request(program=p.agg(F.min("program")).first()[0], year="soon")).select("id")


@register("browse_page", q(PAPERS, select="SELECT id, title, year FROM p ORDER BY year DESC, id LIMIT 20 OFFSET 40"))
def browse_page(spark, d):
    """T8, T1."""
    return browse.page_of(S.papers(spark, d), 3, 20, F.desc("year"), "id").select("id", "title", "year")


@register("browse_page_clamped", q(PAPERS, select="SELECT id FROM p ORDER BY id LIMIT 50 OFFSET (SELECT ((count(*) + 49) // 50 - 1) * 50 FROM p)"))
def browse_page_clamped(spark, d):
    """A page beyond the end is the last one."""
    return browse.page_of(S.papers(spark, d), "9999999", 50, "id").select("id")


@register("browse_look_ahead", q(PAPERS, select="SELECT id, true AS has_next FROM p ORDER BY id LIMIT 20 OFFSET 20"))
def browse_look_ahead(spark, d):
    """T9."""
    return browse.look_ahead(S.papers(spark, d), 2, 20, "id").select("id", "has_next")


LINES = "SELECT l_orderkey AS source, l_linenumber AS seq, l_extendedprice AS score FROM lineitem"


def _line_pages(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("seq"), F.col("l_extendedprice").alias("score"))
    return PageIndex.build(rows, fresh(spark, "pages"), [F.desc("score"), F.asc("source"), F.asc("seq")], rows=5000)


@register("browse_deep_page", LINES + " ORDER BY score DESC, source, seq LIMIT 20 OFFSET 4980")
def browse_deep_page(spark, d):
    """Page 250 of a kept order reads one range."""
    return _line_pages(spark, d).page(250, 20)


@register("browse_deep_look_ahead", f"SELECT *, true AS has_next FROM ({LINES} ORDER BY score DESC, source, seq LIMIT 50 OFFSET 4950)")
def browse_deep_look_ahead(spark, d):
    """T9 from a kept order."""
    return _line_pages(spark, d).look_ahead(100, 50)


@register("filter_tag_contains", q(PAPERS, select="SELECT id FROM p WHERE list_contains(tags, 'small')"))
def filter_tag_contains(spark, d):
    """F4."""
    return browse.with_tag(S.papers(spark, d), "small").select("id")


@register("filter_author", "SELECT DISTINCT l_partkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name = (SELECT min(s_name) FROM supplier) ORDER BY id LIMIT 10")
def filter_author(spark, d):
    """F5, T3."""
    a = S.authorships(spark, d)
    papers = a.groupBy("id").agg(F.collect_set("author").alias("authors"))
    return browse.with_author(papers, a.agg(F.min("author")).first()[0]).select("id")


@register("filter_flags", q(PAPERS, select="SELECT id FROM p WHERE registered AND title IS NOT NULL AND title <> '' AND id <> 6 AND id IN (SELECT l_partkey FROM lineitem)"))
def filter_flags(spark, d):
    """F7, F8, F10, F11."""
    p = S.papers(spark, d).filter("registered and title is not null and title <> '' and id <> 6")
    return p.join(S.edges(spark, d).select(F.col("matched").alias("id")), "id", "left_semi").select("id")


@register("filter_mine", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'")
def filter_mine(spark, d):
    """a user's items that aren't complete."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return S.table(spark, d, "orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("id"), status.alias("status")).filter("status <> 'complete'").orderBy(F.desc("id"))


@register("filter_email_domain", "SELECT c_custkey AS id, ends_with(lower(c_name || CASE WHEN c_custkey % 2 = 0 THEN '@Example.org' ELSE '@example.com' END), '@example.org') AS may FROM customer")
def filter_email_domain(spark, d):
    """F18."""
    c = S.table(spark, d, "customer")
    email = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "@Example.org").otherwise("@example.com"))
    return c.select(F.col("c_custkey").alias("id"), email.alias("email")).select("id", browse.may_see("email", "example.org").alias("may"))


@register("quality_checks", q(PAPERS, select="SELECT id, regexp_matches(CAST(year + 1990 AS VARCHAR), '^[0-9]{4}$') AS year_ok, cites_cached BETWEEN 0 AND 1000 AS cites_ok FROM p"))
def quality_checks(spark, d):
    """F19."""
    return S.papers(spark, d).select("id", (F.col("year") + 1990).cast("string").rlike(r"^\d{4}$").alias("year_ok"), F.col("cites_cached").between(0, 1000).alias("cites_ok"))


@register("facet_distinct_values", q(PAPERS, select="SELECT DISTINCT 'college' AS facet, college AS value FROM p UNION ALL SELECT DISTINCT 'program', program FROM p UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM p"))
def facet_distinct_values(spark, d):
    """A16."""
    return browse.facets(S.papers(spark, d), "college", "program", "year")


@register("point_lookup", q(PAPERS, select="SELECT id, title FROM p WHERE id = 17"))
def point_lookup(spark, d):
    """S4."""
    return S.papers(spark, d).filter("id = 17").select("id", "title").limit(1)


@register("title_lookup", q(PAPERS, select="SELECT id, title FROM p WHERE lower(title) = (SELECT lower(max(title)) FROM p) ORDER BY id LIMIT 1"))
def title_lookup(spark, d):
    """S5."""
    p = S.papers(spark, d)
    wanted = p.agg(F.max("title")).first()[0]
    return p.filter(F.lower("title") == wanted.lower()).orderBy("id").limit(1).select("id", "title")


@register("chunk_with_paper", "SELECT d.doc_id AS id, d.source AS paper_id, n.items FROM documents d LEFT JOIN (SELECT source, count(*) AS items FROM documents WHERE source <> 'src3' GROUP BY source) n ON d.source = n.source")
def chunk_with_paper(spark, d):
    """Left join, chunks without a paper stay."""
    c = S.chunks(spark, d)
    papers = c.filter("paper_id <> 'src3'").groupBy("paper_id").agg(F.count("*").alias("items"))
    return c.select("id", "paper_id").join(papers, "paper_id", "left").select("id", "paper_id", "items")


@register("saved_list", q(SAVED, PAPERS, select="SELECT p.id, p.title, c.c_name AS uploader FROM s JOIN p ON s.paper_id = p.id LEFT JOIN customer c ON c.c_custkey = p.id WHERE s.user_id = 7"))
def saved_list(spark, d):
    """J2."""
    papers = S.papers(spark, d).withColumn("uploader", F.col("id"))
    uploaders = S.table(spark, d, "customer").select(F.col("c_custkey").alias("uploader"), F.col("c_name").alias("uploader_name"))
    return browse.saved_list(saved(spark, d), papers, uploaders, 7).select("id", "title", F.col("uploader_name").alias("uploader"))


@register("saved_flag", q(SAVED, PAPERS, select="SELECT id, id IN (SELECT paper_id FROM s WHERE user_id = 7) AS is_saved FROM p"))
def saved_flag(spark, d):
    """J5."""
    return browse.saved_flag(S.papers(spark, d), saved(spark, d), 7).select("id", "is_saved")


@register("citation_lists", q(EDGES, PAPERS, select="SELECT p.id, count(e.source) AS n, coalesce(string_agg(CAST(e.source AS VARCHAR), ',' ORDER BY e.source, e.seq), '') AS sources FROM p LEFT JOIN e ON e.matched = p.id WHERE p.id <= 50 GROUP BY p.id"))
def citation_lists(spark, d):
    """Edges that come in, as a list of each item."""
    e = S.edges(spark, d).select("source", "seq", F.col("matched").alias("id"))
    lists = e.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("source", "seq"))).alias("l"))
    sources = F.coalesce(F.array_join(F.transform("l", lambda x: x["source"].cast("string")), ","), F.lit(""))
    return S.papers(spark, d).filter("id <= 50").join(lists, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), sources.alias("sources"))


@register("orphan_files_anti", q(PAPERS, select="SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 5 = 0)"))
def orphan_files_anti(spark, d):
    """J7, S24, U3, S21."""
    used = S.edges(spark, d).filter("source % 5 = 0").select(F.col("matched").alias("name"))
    return files.orphans(S.papers(spark, d).select(F.col("id").alias("name")), used)


@register("titles_in_order", q(PAPERS, select="SELECT pos, id, title FROM (SELECT * FROM (VALUES (0, 9), (1, 3), (2, 27), (3, 1)) v(pos, vid)) JOIN p ON id = vid ORDER BY pos"))
def titles_in_order(spark, d):
    """J15."""
    ids = spark.createDataFrame([([9, 3, 27, 1],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "id"))
    return browse.in_order(ids, S.papers(spark, d)).select("pos", "id", "title")


@register("status_counts", "SELECT CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    """A1."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return S.table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("newest_five", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def newest_five(spark, d):
    """T2."""
    return S.table(spark, d, "orders").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("id"))


@register("union_distinct_ids", q(EDGES, select="SELECT source % 100 AS id FROM e UNION SELECT matched FROM e WHERE matched < 100 EXCEPT SELECT id FROM (VALUES (1), (2)) v(id)"))
def union_distinct_ids(spark, d):
    """U1-U3."""
    e = S.edges(spark, d)
    both = e.select((F.col("source") % 100).alias("id")).union(e.filter("matched < 100").select("matched")).distinct()
    return both.subtract(spark.createDataFrame([(1,), (2,)], "id long"))


@register("search_with_fallback", q(PAPERS, select="SELECT id FROM p WHERE list_contains(tags, 'small')"))
def search_with_fallback(spark, d):
    """The first branch is empty, so the second is taken."""
    p = S.papers(spark, d).select("id", "tags")
    return search.with_fallback(p.filter(F.array_contains("tags", "no such tag")), browse.with_tag(p, "small")).select("id")


@register("code_map_referential_check", q(PAPERS, select="SELECT DISTINCT college, program FROM p WHERE year > 25 AND (college, program) NOT IN (SELECT (college, program) FROM p WHERE year <= 25)"))
def code_map_referential_check(spark, d):
    """Programs of a college in papers that the declared pairs lack (section 1.3): those of older papers are declared."""
    pairs = S.papers(spark, d).select("college", "program", "year")
    return browse.undeclared(pairs.filter("year > 25"), pairs.filter("year <= 25"))
