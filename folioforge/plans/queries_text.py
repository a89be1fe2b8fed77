"""Text columns, chunking, page positions, metadata, references and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import chunking
from folioforge.functions import text as T
from folioforge.operators import citations, pages
from folioforge.plans.queries_aggregate import PAPERS, q
from folioforge.plans.registry import register
from folioforge.sources import files
from folioforge.sources import tables as S

#: Lines that queries put before or around the titles of papers, in Spark and in SQL alike.
TITLES = ("Abstract", "Chapter I Introduction", "CHAPTER II", "Review of Related Studies", "chapter iii: Method", "Chapter IV", "Chapter V", "Chapter VI", "List of Figures", "Chapter I Table 3", "Appendix A", " chapter  i ")
CITES = ("Doe, J. (2019). A study of rivers title of. Journal, 3.", "Roe. An unusually long title of a paper. 2003", "Short. (1999) x title of", "No period title of here", "Smith (2020).   Spaces title of kept. Rest.")
NAMES = ("College of Engineering", " college of ARTS and sciences ", "bachelor of science in nursing", "Unknown", "College of Computer Studies")


def values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(quote(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + ")"


def listed(rows) -> str:
    """A list of strings in SQL."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in rows) + "]"


def one_of(rows, key: str = "id"):
    """One of some strings for each row, by its number."""
    return F.array(*(F.lit(x) for x in rows))[(F.col(key) % len(rows)).cast("int")]


def frame(spark, rows, ddl: str):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)


@register("highlight", "SELECT doc_id AS id, md5(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi')) AS html_md5 FROM documents")
def highlight(spark, d):
    """Q8."""
    return S.chunks(spark, d).select("id", F.md5(T.highlight("text", "the")).alias("html_md5"))


@register("escape_highlight", "SELECT doc_id AS id, md5(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '(and)', '<mark>\\1</mark>', 'gi')) AS html_md5 FROM documents")
def escape_highlight(spark, d):
    """Q9."""
    return S.chunks(spark, d).select("id", F.md5(T.escape_highlight("text", "and")).alias("html_md5"))


@register("snippet_first_sentence", "SELECT doc_id AS id, regexp_replace(coalesce(trim(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda p: contains(lower(p), 'the'))[1]), ''), '(the)', '<mark>\\1</mark>', 'gi') AS snippet FROM documents")
def snippet_first_sentence(spark, d):
    """Q10."""
    return S.chunks(spark, d).select("id", T.snippet("text", "the").alias("snippet"))


@register("truncate_display", "SELECT doc_id AS id, CASE WHEN length(text) > 100 THEN left(text, 99) || '…' ELSE text END AS shown FROM documents")
def truncate_display(spark, d):
    """Display functions of 2.10."""
    return S.chunks(spark, d).select("id", T.truncate("text", 100).alias("shown"))


@register("display_formats", q(PAPERS, select="SELECT id, printf('%.3f', CAST(year AS DOUBLE) / 7) AS ratio, array_to_string(tags, ', ') AS tag_list, CASE WHEN year > 6 THEN 'large' WHEN year > 3 THEN 'medium' ELSE 'small' END AS size, CASE WHEN contains(lower(title), 'small') THEN 'small' WHEN contains(lower(title), 'red') THEN 'red' ELSE 'Other' END AS topic FROM p"))
def display_formats(spark, d):
    """Q22, Q23, numbers and lists of 2.10."""
    p = S.papers(spark, d)
    return p.select("id", F.format_string("%.3f", F.col("year").cast("double") / 7).alias("ratio"), F.array_join("tags", ", ").alias("tag_list"), T.cloud_size("year").alias("size"), T.topic("title", ["small", "red"]).alias("topic"))


@register("date_formats", "SELECT event_id, strftime(ts, '%b %d, %Y') AS short, CAST(year(ts) AS INTEGER) AS year FROM events")
def date_formats(spark, d):
    """Dates of 2.10."""
    e = S.table(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "MMM dd, yyyy").alias("short"), F.year("ts").alias("year"))


@register("local_doi", q(PAPERS, select="SELECT id, 'repo/' || CASE WHEN id % 5 = 0 THEN 'None' ELSE college END || '.' || year || '.' || program || '.' || CASE WHEN length(CAST(id AS VARCHAR)) < 5 THEN lpad(CAST(id AS VARCHAR), 5, '0') ELSE CAST(id AS VARCHAR) END AS doi FROM p"))
def local_doi(spark, d):
    """X22."""
    p = S.papers(spark, d).withColumn("college", F.when(F.col("id") % 5 != 0, F.col("college")))
    return p.select("id", T.local_doi("repo", "college", "year", "program", "id").alias("doi"))


@register("chunk_short_filter", "SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 60")
def chunk_short_filter(spark, d):
    """F15 with a bound that documents of the corpus meet, F16."""
    c = S.chunks(spark, d).filter(T.is_short("text", 60) & (T.present("text") | F.col("text").isNotNull()))
    return c.select("id", F.size(T.words("text")).cast("long").alias("words"))


#: What a packer has done and holds, as DuckDB folds it over a list whose items are such structs too.
FOLD = "list_reduce(l, lambda a, x: CASE WHEN {fits} THEN {{'done': a.done, 'now': {longer}, 'n': a.n + x.n}} ELSE {{'done': list_append(a.done, {full}), 'now': {alone}, 'n': x.n}} END, {{'done': CAST([] AS VARCHAR[]), 'now': '', 'n': CAST(0 AS BIGINT)}})"
UNROLL = "SELECT id, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS chunk_id, unnest(chunks) AS text FROM c"


@register(
    "chunk_greedy",
    q(
        "s AS (SELECT doc_id AS id, list_transform(string_split(text, '. '), lambda x: {'done': CAST([] AS VARCHAR[]), 'now': x, 'n': CAST(0 AS BIGINT)}) AS l FROM documents)",
        "f AS (SELECT id, " + FOLD.format(fits="length(a.now) + length(x.now) < 1000", longer="a.now || x.now || '. '", full="trim(a.now)", alone="x.now || '. '") + " AS f FROM s)",
        "c AS (SELECT id, list_filter(list_append(f.done, trim(f.now)), lambda c: c <> '') AS chunks FROM f)",
        select=UNROLL,
    ),
)
def chunk_greedy(spark, d):
    """X4, W5."""
    return S.chunks(spark, d).select("id", F.posexplode(chunking.pack_sentences("text")).alias("chunk_id", "text"))


@register(
    "chunk_wordbudget",
    q(
        "s AS (SELECT doc_id AS id, list_transform(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n'), lambda p: trim(p)), lambda p: p <> ''), lambda x: {'done': CAST([] AS VARCHAR[]), 'now': x, 'n': CAST(len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS BIGINT)}) AS l FROM documents)",
        "f AS (SELECT id, " + FOLD.format(fits="a.n + x.n <= 120 OR a.n = 0", longer="CASE WHEN a.n > 0 THEN a.now || chr(10) || chr(10) || x.now ELSE x.now END", full="a.now", alone="x.now") + " AS f FROM s)",
        "c AS (SELECT id, list_filter(list_append(f.done, f.now), lambda c: c <> '') AS chunks FROM f)",
        select=UNROLL,
    ),
)
def chunk_wordbudget(spark, d):
    """X8."""
    return S.chunks(spark, d).select("id", F.posexplode(chunking.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 120)).alias("chunk_id", "text"))


@register("chunk_recursive")
def chunk_recursive(spark, d):
    """X1; tests hold it against its own rules."""
    return S.chunks(spark, d).select("id", F.posexplode(chunking.recursive_chunks()("text")).alias("chunk_id", "text"))


PAGES = "g AS (SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page, text FROM conversations)"


def paged(spark, d):
    return S.turns(spark, d).select(F.col("paper_id").alias("doc"), F.col("chunk_id").alias("page"), "text")


@register("page_positions", q(PAGES, select="SELECT doc, page, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g"))
def page_positions(spark, d):
    """W6."""
    return pages.positions(paged(spark, d)).select("doc", "page", F.col("start").cast("long").alias("start"))


@register("appendix_cutoff", q(PAGES, "m AS (SELECT doc, page, CASE WHEN page % 4 = 3 THEN 'APPENDIX' || chr(10) || text ELSE text END AS text FROM g)", "s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)", "f AS (SELECT doc, min(page) AS first FROM s WHERE start > 100 AND regexp_matches(text, '(^|\\n)\\s*(APPENDIX|APPENDICES)') GROUP BY doc)", select="SELECT s.doc, s.page FROM s LEFT JOIN f ON s.doc = f.doc WHERE first IS NULL OR page < first"))
def appendix_cutoff(spark, d):
    """X2."""
    marked = paged(spark, d).withColumn("text", F.when(F.col("page") % 4 == 3, F.concat(F.lit("APPENDIX\n"), "text")).otherwise(F.col("text")))
    return pages.without_appendix(marked, 100).select("doc", "page")


@register("last_pages", q(PAGES, select="SELECT doc, page FROM (SELECT *, max(page) OVER (PARTITION BY doc) AS last FROM g) WHERE page > last - 3"))
def last_pages(spark, d):
    """S8, S7."""
    return pages.last_pages(paged(spark, d)).select("doc", "page")


@register(
    "page_attribution",
    q(
        PAGES, "w AS (SELECT doc, string_agg(text, '' ORDER BY page) AS whole FROM g GROUP BY doc)",
        "s AS (SELECT doc, page, coalesce(sum(length(text)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(text) AS n FROM g)",
        "c AS (SELECT doc, CAST(unnest(range(0, (length(whole) + 149) // 150)) AS INTEGER) AS chunk_id, whole FROM w)",
        select="SELECT c.doc, c.chunk_id, s.page, md5(substr(whole, chunk_id * 150 + 1, 200)) AS text_md5 FROM c JOIN s ON s.doc = c.doc AND chunk_id * 150 >= start AND chunk_id * 150 < start + n WHERE length(substr(whole, chunk_id * 150 + 1, 200)) >= 60",
    ),
)
def page_attribution(spark, d):
    """Chunks of 200 characters that overlap by 50 and run over the ends of pages, with the page each begins on."""
    p = paged(spark, d)
    whole = p.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "").alias("whole"))
    cuts = whole.select("doc", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("whole") - 1) / 150).cast("int")))).alias("chunk_id"))
    chunks = cuts.select("doc", "chunk_id", F.substring("whole", F.col("chunk_id") * 150 + 1, F.lit(200)).alias("text")).filter("length(text) >= 60")
    return pages.page_of_chunks(p, chunks).select("doc", "chunk_id", "page", F.md5("text").alias("text_md5"))


@register("section_classify", f"WITH v AS (SELECT p_partkey AS id, {listed(TITLES)}[p_partkey % {len(TITLES)} + 1] || ' ' || p_name AS title FROM part) SELECT id, title, (contains(lower(title), 'abstract') OR starts_with(lower(title), 'chapter i') OR starts_with(lower(title), 'chapter v')) AND NOT regexp_matches(lower(title), 'figure|table|appendix|bibliography|references') AS valid, CASE WHEN contains(lower(title), 'abstract') THEN 'abstract' WHEN regexp_matches(trim(lower(title)), '^chapter\\s*i\\b') THEN 'introduction' WHEN regexp_matches(trim(lower(title)), '^chapter\\s*ii\\b') OR contains(lower(title), 'review of related') OR contains(lower(title), 'related studies') THEN 'rrl' WHEN regexp_matches(trim(lower(title)), '^chapter\\s*iii\\b') THEN 'methodology' WHEN regexp_matches(trim(lower(title)), '^chapter\\s*iv\\b') THEN 'results' WHEN regexp_matches(trim(lower(title)), '^chapter\\s*v\\b') THEN 'conclusion' ELSE 'other' END AS kind FROM v")
def section_classify(spark, d):
    """X6, X7, trap 12: a heading of each kind before the title of each paper."""
    p = S.papers(spark, d).select("id", F.concat(one_of(TITLES), F.lit(" "), "title").alias("title"))
    return p.select("id", "title", T.section_valid("title").alias("valid"), T.section_class("title").alias("kind"))


@register("citation_title_parse", f"WITH v AS (SELECT p_partkey AS id, replace({listed(CITES)}[p_partkey % {len(CITES)} + 1], 'title of', p_name) AS cite FROM part) SELECT id, cite, CASE WHEN regexp_matches(cite, '\\(\\d{{4}}\\)\\.\\s*(.+?)\\.\\s*') THEN trim(regexp_extract(cite, '\\(\\d{{4}}\\)\\.\\s*(.+?)\\.\\s*', 1)) ELSE coalesce(trim(list_filter(string_split(cite, '.'), lambda p: len(list_filter(string_split(p, ' '), lambda w: w <> '')) > 3 AND NOT contains(p, '('))[1]), trim(left(cite, 100))) END AS title FROM v")
def citation_title_parse(spark, d):
    """X11: a reference of each kind for each paper."""
    p = S.papers(spark, d).select("id", F.replace(one_of(CITES), F.lit("title of"), F.col("title")).alias("cite"))
    return p.select("id", "cite", T.citation_title("cite").alias("title"))


@register(
    "reference_line_merge",
    q(
        PAPERS,
        select="SELECT id AS doc, 0 AS entry, CASE WHEN id % 2 = 0 THEN 'Doe, J. (2019). A study of ' || title || '. Journal.' ELSE 'Poe (1845). ' || title || '.' END AS raw FROM p UNION ALL SELECT id, 1, 'Roe, K. (2001). ' || program || '.' FROM p WHERE id % 2 = 0",
    ),
)
def reference_line_merge(spark, d):
    """X9, X10, W7, traps 13: the references of each paper, on its last pages; wrapped, ended by a heading or a numbered line."""
    p = S.papers(spark, d)
    line = lambda page, pos, text: F.struct(F.lit(page).alias("page"), F.lit(pos).alias("pos"), text.alias("line"))
    even = [F.lit("References"), F.lit("(1999) on an early page"), F.lit("Body"), F.lit(" References "), F.lit("Doe, J. (2019). A study of"), F.concat("title", F.lit(". Journal.")), F.lit(""), F.concat(F.lit("Roe, K. (2001). "), "program", F.lit(".")), F.lit("Glossary"), F.lit("Water")]
    uneven = [F.lit("Front"), F.lit("x"), F.lit("Body"), F.lit("BIBLIOGRAPHY"), F.concat(F.lit("Poe (1845). "), "title", F.lit(".")), F.lit("1. Numbered"), F.lit("Late (2000).")]
    pages_of = lambda texts: F.array(*(line(1 if i < 2 else 4 + i // 6, i, t) for i, t in enumerate(texts)))
    lines = p.select(F.col("id").alias("doc"), F.explode(F.when(F.col("id") % 2 == 0, pages_of(even)).otherwise(pages_of(uneven))).alias("l")).select("doc", "l.*")
    return citations.merge_lines(citations.reference_lines(lines)).select("doc", F.col("entry").cast("int").alias("entry"), "raw")


@register("metadata_normalize", f"WITH v AS (SELECT p_partkey AS id, {listed(NAMES)}[p_partkey % {len(NAMES)} + 1] AS name FROM part) SELECT id, name, CASE lower(trim(name)) WHEN 'college of engineering' THEN 'coe' WHEN 'college of arts and sciences' THEN 'cas' WHEN 'college of computer studies' THEN 'ccs' END AS college, CASE lower(trim(name)) WHEN 'bachelor of science in nursing' THEN 'bsn' END AS program FROM v")
def metadata_normalize(spark, d):
    """J16."""
    return S.papers(spark, d).select("id", one_of(NAMES).alias("name")).select("id", "name", T.code_of("name", T.COLLEGE_CODES).alias("college"), T.code_of("name", T.PROGRAM_CODES).alias("program"))


@register("year_extract_all", "SELECT event_id, array_to_string(regexp_extract_all('from 1999 to ' || strftime(ts, '%Y') || ', not 20245', '\\b(20\\d{2})\\b', 1), ',') AS years FROM events")
def year_extract_all(spark, d):
    """X15."""
    text = F.concat(F.lit("from 1999 to "), F.date_format("ts", "yyyy"), F.lit(", not 20245"))
    return S.table(spark, d, "events").select("event_id", F.array_join(T.years(text), ",").alias("years"))


@register("html_title_extract", "SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS title, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def html_title_extract(spark, d):
    """Headings and links by patterns; the parser of S16 runs in html_sections."""
    p = S.table(spark, d, "pages")
    return p.select("page_id", F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"))


@register("html_strip_boilerplate", "SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', '<gone>', 'gs'), '<style\\b[^>]*>.*?</style>', '<gone>', 'gs'), '<nav\\b[^>]*>.*?</nav>', '<gone>', 'gs'), '<footer\\b[^>]*>.*?</footer>', '<gone>', 'gs'), '<aside\\b[^>]*>.*?</aside>', '<gone>', 'gs'), '<header\\b[^>]*>.*?</header>', '<gone>', 'gs'), '<noscript\\b[^>]*>.*?</noscript>', '<gone>', 'gs'), '<template\\b[^>]*>.*?</template>', '<gone>', 'gs'), '<div class=\"ad\">.*?</div>', '<gone>', 'gs'), '<!--.*?-->|<[^>]*>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages")
def html_strip_boilerplate(spark, d):
    """Visible text of pages, beside S15."""
    p = S.table(spark, d, "pages")
    return p.select("page_id", files.visible().alias("text"))


@register("rest_listing", q(PAPERS, select="SELECT id, '{\"id\":' || id || ',\"title\":\"' || title || '\",\"year\":' || year || '}' AS json FROM p"))
def rest_listing(spark, d):
    """Objects beside their keys; S22 itself runs in rest_rows."""
    p = S.papers(spark, d).select("id", "title", "year")
    return p.select("id", F.to_json(F.struct("id", "title", "year")).alias("json"))


@register("url_functions", q(PAPERS, select="SELECT id, lower(regexp_extract('/a/' || title || '.PDF', '(\\.[^./]+)$', 1)) AS ext, replace(lower(title), ' ', '-') AS slug, replace(title, ' ', '+') AS encoded FROM p"))
def url_functions(spark, d):
    """Scalars of 2.10."""
    p = S.papers(spark, d)
    return p.select("id", T.extension(F.concat(F.lit("/a/"), "title", F.lit(".PDF"))).alias("ext"), T.slug("title").alias("slug"), F.url_encode("title").alias("encoded"))
