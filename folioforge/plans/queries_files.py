"""Files, HTML, title pages and forms: sources, sinks and parsers, each over rows that a table of the data makes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import browse
from folioforge.plans.queries_aggregate import PAPERS, q
from folioforge.plans.registry import register
from folioforge.sources import files
from folioforge.sources import tables as S
from folioforge.sources.scratch import fresh, write_files

def concat(*parts):
    """Strings as literals, (name,) as columns."""
    return F.concat(*(F.col(x[0]).cast("string") if isinstance(x, tuple) else F.lit(x) for x in parts))


@register("figure_pages", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id AS INTEGER) + 1 END AS page FROM pages")
def figure_pages(spark, d):
    """S10."""
    p = S.table(spark, d, "pages")
    path = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("media/page"), (F.col("page_id") + 1).cast("string"), F.lit("_img2.png"))).otherwise("media/cover.png")
    return p.select("page_id", T.figure_page(path).alias("page"))


@register("help_archive_paths", q(PAPERS, select="SELECT id, 'Html/' || title || '/page.htm' AS path FROM p"))
def help_archive_paths(spark, d):
    """S12."""
    return S.papers(spark, d).select("id", T.chm_path(concat("hhctrl://Html\\", ("title",), "\\page.htm")).alias("path"))


@register("mended_text", "SELECT doc_id AS id, md5(text) AS text_md5 FROM documents")
def mended_text(spark, d):
    """Texts that were read as Latin-1 are texts again."""
    c = S.chunks(spark, d)
    return c.select("id", F.md5(T.mend_latin1(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))).alias("text_md5"))


def title_pages(spark, d):
    """A title page of each paper; every fifth has no cue, every seventh no college."""
    p = S.dealt(S.papers(spark, d), "id")
    cue = F.when(F.col("id") % 5 != 0, "A Thesis Presented to the Faculty").otherwise("Submitted to")
    college = F.when(F.col("id") % 7 != 0, concat("  College of ", ("college",), " of")).otherwise("  Faculty")
    lines = [F.lit("THE UNIVERSITY 0.F"), F.lit("   "), F.col("title"), F.concat(F.lit(" by 0."), F.col("program"), F.lit(" ")), cue, college, concat("Bachelor of ", ("program",)), concat("June 20", "19 and 1999, 2020")]
    return p.select("id", F.concat_ws("\n", *lines).alias("text"))


@register(
    "title_page_fields",
    q(
        PAPERS,
        select="SELECT id, CASE WHEN id % 5 <> 0 THEN title || ' by 0.' || program END AS title, CASE WHEN id % 7 <> 0 THEN 'College of ' || college END AS college, 'Bachelor of ' || program AS program, '2019,2020' AS years, "
        "'THE UNIVERSITY O.F|' || title || '|by O.' || program || '|' || CASE WHEN id % 5 <> 0 THEN 'A Thesis Presented to the Faculty' ELSE 'Submitted to' END || '|' || CASE WHEN id % 7 <> 0 THEN 'College of ' || college || ' of' ELSE 'Faculty' END || '|Bachelor of ' || program || '|June 2019 and 1999, 2020' AS cleaned FROM p",
    ),
)
def title_page_fields(spark, d):
    """X12, X13, X14, X15, X16."""
    t = title_pages(spark, d)
    return t.select("id", T.page_title("text").alias("title"), T.college_line("text").alias("college"), T.program_line("text").alias("program"), F.array_join(T.years("text"), ",").alias("years"), F.array_join(T.clean_lines("text"), "|").alias("cleaned"))


@register("project_descriptions", q(PAPERS, select="SELECT id, CASE WHEN id % 6 <> 0 THEN title || ' and ' || program END AS description FROM p"))
def project_descriptions(spark, d):
    """X17."""
    head = F.when(F.col("id") % 6 != 0, "  Project Description:  ").otherwise("Nothing here ")
    text = F.concat(F.lit("Front\n"), head, F.col("title"), F.lit("\n and\t "), F.col("program"), F.lit(" \nChapter 1\nProject Description: not this"))
    return S.papers(spark, d).select("id", T.description(F.when(F.col("id") % 6 != 0, text).otherwise(F.concat(F.lit("no heading "), F.col("title")))).alias("description"))


@register("metadata_merge", q(PAPERS, select="SELECT id, CASE WHEN id % 3 = 2 THEN title ELSE 'rule' END AS title, CASE WHEN id % 2 = 0 THEN CAST(year AS VARCHAR) ELSE '2025' END AS year FROM p"))
def metadata_merge(spark, d):
    """The model's value unless it is null or empty, else the rule's."""
    p = S.papers(spark, d)
    said = F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 2, F.col("title"))
    return p.select("id", T.or_default(said, "rule").alias("title"), T.or_default(F.when(F.col("id") % 2 == 0, F.col("year").cast("string")), "2025").alias("year"))


@register("model_replies", q(PAPERS, select="SELECT id, CASE WHEN id % 3 <> 2 THEN title END AS title, CASE WHEN id % 3 <> 2 THEN CAST(year AS INTEGER) END AS year FROM p"))
def model_replies(spark, d):
    """Fenced, bare and broken objects."""
    p = S.papers(spark, d)
    body = concat('{"title": "', ("title",), '", "year": ', ("year",), "}")
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("id") % 3 == 1, body).otherwise(F.concat(F.lit("{no "), body))
    return p.select("id", T.reply_json(reply, "title string, year int").alias("r")).select("id", "r.title", "r.year")


@register("author_forms", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || '|' || c_mktsegment END AS authors, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n FROM customer")
def author_forms(spark, d):
    """X20."""
    form = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("\n "), F.col("c_name"), F.lit(" \n\n"), F.col("c_mktsegment"), F.lit("\n")))
    names = T.author_list(form)
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(names, "|").alias("authors"), F.size(names).alias("n"))


@register(
    "phrase_tags",
    q(PAPERS, select="SELECT id, CASE id % 4 WHEN 0 THEN lower(title) WHEN 1 THEN lower(title) || '|' || lower(program) || ' kind' WHEN 2 THEN '' ELSE lower(title) || ' and x' END AS tags FROM (SELECT id, title, program FROM p) WHERE id % 4 <> 3"),
)
def phrase_tags(spark, d):
    """Articles go, stop tags and long phrases give none, "x y and z w" gives two."""
    p = S.papers(spark, d).filter("id % 4 <> 3")
    phrase = F.when(F.col("id") % 4 == 0, concat(" The  ", ("title",), " ")).when(F.col("id") % 4 == 1, F.concat(F.col("title"), F.lit(" and "), F.col("program"), F.lit(" kind"))).otherwise("this paper")
    parts = F.when(F.col("id") % 4 == 1, F.array(F.concat(F.lit("a "), F.col("title")), F.concat(F.col("program"), F.lit(" kind")))).otherwise(F.array(phrase))
    return p.select("id", F.array_join(F.flatten(F.transform(parts, T.clean_tags)), "|").alias("tags"))


@register("phrase_tags_parted", q(PAPERS, select="SELECT id, CASE id % 3 WHEN 0 THEN lower(title) || '|map ' || id WHEN 1 THEN lower(title) ELSE '' END AS tags FROM p"))
def phrase_tags_parted(spark, d):
    """Phrases that are parted, that lose a part of one word, and that are too long."""
    p = S.papers(spark, d)
    phrase = F.when(F.col("id") % 3 == 0, concat(" An ", ("title",), " and  map ", ("id",))).when(F.col("id") % 3 == 1, concat(("title",), " and cheese")).otherwise(concat("one two three four five six ", ("title",)))
    return p.select("id", F.array_join(T.clean_tags(phrase), "|").alias("tags"))


FORM = "f AS (SELECT id, CASE WHEN id % 2 = 0 THEN college END AS college, CASE WHEN id % 3 <> 0 THEN program ELSE '' END AS program, CASE WHEN id % 5 = 0 THEN CAST(year AS VARCHAR) END AS year, tags[1] AS tag FROM p)"
ACTIVE = "a AS (SELECT id, list_filter([{'name': 'college', 'value': college}, {'name': 'program', 'value': program}, {'name': 'year', 'value': year}, {'name': 'tag', 'value': tag}], lambda x: coalesce(x.value, '') <> '') AS active FROM f)"


@register("filter_chips", q(PAPERS, FORM, ACTIVE, "e AS (SELECT id, active, unnest(active) AS c FROM a)", select="SELECT id, c.name AS name, c.value AS value, array_to_string(list_transform(list_filter(active, lambda x: x <> c), lambda x: x.name || '=' || replace(url_encode(x.value), '%20', '+')), '&') AS remove FROM e"))
def filter_chips(spark, d):
    """the form that each paper would be found by."""
    one = lambda when, value: F.when(when, value)
    forms = S.papers(spark, d).select(
        "id", F.lit("").alias("author"), one(F.col("id") % 2 == 0, F.col("college")).alias("college"), one(F.col("id") % 3 != 0, F.col("program")).otherwise("").alias("program"),
        one(F.col("id") % 5 == 0, F.col("year")).alias("year"), F.slice("tags", 1, 1).alias("tags"),
    )
    return browse.chip_rows(forms)


@register("programs_of_college", q(PAPERS, "c AS (SELECT DISTINCT college, program FROM p UNION SELECT '', program FROM p)", select="SELECT college, string_agg(program, ',' ORDER BY encode(program)) AS programs FROM c GROUP BY college"))
def programs_of_college(spark, d):
    """F21."""
    return browse.programs_by_college(S.papers(spark, d)).select("college", F.array_join("programs", ",").alias("programs"))


@register("help_contents", q(PAPERS, select="SELECT CAST(n AS INTEGER) AS position, CASE n WHEN 0 THEN title ELSE 'Part ' || id END AS name, CASE n WHEN 0 THEN 'a/' || id || '.htm' ELSE 'b.htm' END AS local FROM p, range(0, 2) r(n)"))
def help_contents(spark, d):
    """Entries of tables of contents; those without a page are left out."""
    param = lambda k, *v: F.concat(F.lit(f'<param name="{k}" value="'), concat(*v), F.lit('">'))
    entry = lambda *p: F.concat(F.lit('<li><object type="text/sitemap">'), *p, F.lit("</object>"))
    page = F.concat(
        F.lit("<html><body><ul>"), entry(param("Name", ("title",)), param("Local", "a/", ("id",), ".htm")), entry(param("Name", "No page")),
        F.lit('<object type="other"><param name="Local" value="x"></object>'), entry(param("name", "Part ", ("id",)), param("LOCAL", "b.htm")), F.lit("</ul>"),
    )
    return files.toc(S.dealt(S.papers(spark, d), "id").select(page.alias("html")))


@register("help_pages_by_path", q(PAPERS, select="SELECT path FROM (SELECT CASE WHEN id % 2 = 0 THEN title ELSE upper(title) || '/x' END || id AS path FROM p) ORDER BY length(path), lower(path) LIMIT 20"))
def help_pages_by_path(spark, d):
    """S13 without a table of contents."""
    path = F.concat(F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.concat(F.upper("title"), F.lit("/x"))), F.col("id").cast("string"))
    return files.toc_by_path(S.papers(spark, d).select(path.alias("path"))).limit(20)


@register(
    "html_sections",
    q(
        PAPERS,
        select="SELECT id, CAST(n AS INTEGER) AS position, CASE n WHEN 0 THEN 'Chapter I ' || title ELSE 'Chapter II' END AS title, CASE n WHEN 0 THEN program || ' & more ' || college WHEN 1 THEN 'Last ' || id END AS text FROM p, range(0, 2) r(n)",
    ),
)
def html_sections(spark, d):
    """Sections of pages by their headings; what lies before the first or outside the box is left out."""
    page = concat(
        '<html><body><h2>Outside</h2><div id="content"><p>before</p><h2>Chapter I <b>', ("title",), "</b></h2><p>", ("program",), " &amp; <i>more</i></p><div><p>", ("college",), "</p></div>",
        "<h2>Chapter II</h2>stray<p> Last ", ("id",), " </p></div><p>after</p></body></html>",
    )
    return files.sections(S.dealt(S.papers(spark, d), "id").select("id", page.alias("html")), key="id")


@register(
    "abstract_pages",
    "SELECT c_custkey AS id, c_name AS title, c_mktsegment || '|Second Author' AS authors, CASE WHEN c_custkey % 2 = 0 THEN 'BS Computer Science' ELSE 'BS Nursing' END AS program, CASE WHEN c_custkey % 2 = 0 THEN 'College of Computer Studies' END AS college, CASE WHEN c_custkey % 3 <> 0 THEN CAST(2019 AS INTEGER) END AS year, 'About ' || c_name AS abstract FROM customer",
)
def abstract_pages(spark, d):
    """S17, X5."""
    c = S.dealt(S.table(spark, d, "customer"), "c_custkey").select(
        F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "BS Computer Science").otherwise("BS Nursing").alias("degree"), F.when(F.col("c_custkey") % 3 != 0, "2019").otherwise("MMXIX").alias("y")
    )
    page = concat(
        '<html><body><div class="cont"><p>&nbsp;Title&nbsp;</p><p>:</p><p>', ("c_name",), "</p><p>Researchers</p><p>: ", ("c_mktsegment",), "</p><p>Second Author</p><p>Degree</p><p>&nbsp;:&nbsp;</p><p>", ("degree",),
        "</p><p>Year</p><p>:</p><p>", ("y",), "</p><p>Project Description</p></div><div>skip</div><p> About ", ("c_name",), " </p><p>no</p></body></html>",
    )
    found = files.abstracts(c.select("id", page.alias("html")), key="id")
    return found.select("id", "title", F.array_join("authors", "|").alias("authors"), "program", "college", "year", "abstract")


@register(
    "html_merged",
    "SELECT conv_id AS doc, string_agg('<h2 id=\"section-' || turn || '\" style=\"display:none\"></h2><p>' || role || ' &amp; co</p><img src=\"Images/pic' || turn || '.png\"><div class=\"footer\">kept ' || turn || '</div>', chr(10) ORDER BY turn) AS html FROM conversations GROUP BY conv_id",
)
def html_merged(spark, d):
    """Pages without headers, first footers and logos, images by lower-case name, in order."""
    page = concat(
        '<html><head><title>x</title></head><body><div class="top hd">head</div><p>', ("role",), ' &amp; co</p><img src="..\\Pics\\PIC', ("turn",), '.PNG"><img src="a/LOGO.gif"><div class="footer">first</div><div class="footer">kept ', ("turn",),
        "</div></body></html>",
    )
    pages = S.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("position"), page.alias("html"))
    return files.merged(pages, logos=("logo.gif",))


@register("html_folder_pages", "SELECT 'Page ' || r_regionkey || '.htm' AS name, '<p>é ' || r_name || '</p>' AS html FROM region")
def html_folder_pages(spark, d):
    """Pages of an unpacked folder, half of them in Latin-1, names URL-encoded."""
    rows = S.table(spark, d, "region").select("r_regionkey", "r_name").collect()  # five rows
    pages = {f"sub/Page%20{r[0]}.htm": f"<p>é {r[1]}</p>".encode("latin-1" if r[0] % 2 else "utf-8") for r in rows}
    folder = write_files(spark, fresh(spark, "html"), pages | {"style.css": b"p {}"})
    found = files.html_folder(spark, folder)
    return found.select(F.url_decode(F.substring_index("path", "/", -1)).alias("name"), "html")


@register("file_listing", "SELECT r_name || '.pdf' AS name, r_regionkey % 2 = 0 AS orphan FROM region")
def file_listing(spark, d):
    """Files below a folder, and which of them no item uses."""
    rows = S.table(spark, d, "region").select("r_regionkey", "r_name").collect()  # five rows
    folder = write_files(spark, fresh(spark, "files"), {f"{r[0]}/{r[1].replace(' ', '_')}.pdf": b"x" for r in rows} | {"note.txt": b""})
    listed = files.listing(spark, folder, "*.pdf").select(F.replace("name", F.lit("_"), F.lit(" ")).alias("name"))
    used = S.table(spark, d, "region").filter("r_regionkey % 2 = 1").select(F.concat("r_name", F.lit(".pdf")).alias("name"))
    lost = files.orphans(listed, used).select("name", F.lit(True).alias("orphan"))
    return listed.join(lost, "name", "left").select("name", F.coalesce("orphan", F.lit(False)).alias("orphan"))


@register("tag_bank", q(PAPERS, select="SELECT DISTINCT college AS name, 'papers of ' || college AS description FROM p"))
def tag_bank(spark, d):
    """A JSON file with an array of tags."""
    tags = S.papers(spark, d).select(F.col("college").alias("name"), concat("papers of ", ("college",)).alias("description")).distinct()
    path = fresh(spark, "tags")
    tags.agg(F.to_json(F.collect_list(F.struct("name", "description"))).alias("value")).write.text(path)  # a bank of some dozen tags
    return files.tag_bank(spark, path)


@register("chunk_sinks", q(PAPERS, select="SELECT id AS chunk_id, title, 'other' AS section_type, program || ' – é' AS text, CAST(2 AS BIGINT) AS copies FROM p"))
def chunk_sinks(spark, d):
    """Chunks written as JSON and read again, and appended twice to a table."""
    chunks = S.papers(spark, d).select(F.col("id").alias("chunk_id"), "title", F.lit("other").alias("section_type"), F.concat("program", F.lit(" – é")).alias("text"))
    to, table = fresh(spark, "chunks"), fresh(spark, "chunk-table")
    files.write_chunks(chunks, to)
    back = spark.read.schema(chunks.schema).json(to)
    for _ in range(2):
        files.append_chunks(back, table)
    return spark.read.parquet(table).groupBy("chunk_id", "title", "section_type", "text").agg(F.count("*").alias("copies"))


@register("external_new_rows", "SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 3 <> 0")
def external_new_rows(spark, d):
    """Rows of a search that come twice and are partly known."""
    found = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return files.new_rows(found.union(found), found.filter("id % 3 = 0"), "id").select("id", "title")


@register("rest_rows", q(PAPERS, select="SELECT '{\"id\":' || id || ',\"title\":\"' || title || '\",\"year\":' || year || ',\"registered\":' || registered || '}' AS json FROM p"))
def rest_rows(spark, d):
    """All columns of a row as one object."""
    return files.to_json(S.papers(spark, d).select("id", "title", "year", "registered"))
