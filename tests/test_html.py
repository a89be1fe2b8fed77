from folioforge.functions import html
from folioforge.sources import files

ABSTRACT = """<html><body><div class="cont"><p>Title<br>: A Study<br>of Things</p><p>Researchers</p><p>Ann A.</p><p>Bob B.</p>
<p>Degree</p><p>: BS in Computer Science</p><p>Year</p><p>: 2021</p><p>Project Description</p></div><p>What it is&nbsp;about.</p></body></html>"""


def test_contents():
    page = '<ul><li><object type="text/sitemap"><param name="Name" value="One"><param name="Local" value="a.htm"></object><li><object type="x"></object></ul>'
    assert html.contents(page) == [{"position": 0, "name": "One", "local": "a.htm"}]


def test_sections():
    page = '<div id="content"><p>pre</p><h2>Abstract</h2><p>one</p><ul><li>two</li></ul><h2>Chapter I</h2><p>x</p></div>'
    assert [(s["title"], s["text"]) for s in html.sections(page)] == [("Abstract", "one two"), ("Chapter I", "x")]


def test_abstract_page():
    got = html.abstract_page(ABSTRACT)
    assert got["title"] == "A Study of Things" and got["authors"] == ["Ann A.", "Bob B."] and got["year"] == 2021
    assert got["college"] == "College of Computer Studies" and got["abstract"].startswith("What it is")
    assert html.abstract_page("<p>x</p>")["title"] is None


def test_clean_page():
    page = '<body><div class="hd">h</div><p>t</p><img src="a\\B.PNG"><img src="Logo.gif"><div class="footer">1</div><div class="footer">2</div></body>'
    got = html.clean_page(page, 3, logos=("logo.gif",))
    assert "section-3" in got and ">h<" not in got and "Images/b.png" in got and "gif" not in got and "1" not in got.split("</h2>")[1] and "2" in got


def test_frames(spark):
    pages = spark.createDataFrame([("d", 1, "<p>b</p>"), ("d", 0, "<p>a</p>"), ("e", 0, None)], "doc string, position int, html string")
    got = {r["doc"]: r["html"] for r in files.merged(pages).collect()}
    assert got["d"].index("<p>a") < got["d"].index("<p>b")
    row = files.abstracts(spark.createDataFrame([("p", ABSTRACT)], "path string, html string")).first()
    assert row["year"] == 2021 and row["authors"] == ["Ann A.", "Bob B."]


def test_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"name": "A", "description": "x"}, {"name": "B"}]')
    assert files.tag_bank(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.htm").write_bytes("é".encode("latin-1"))
    assert files.html_folder(spark, str(tmp_path / "h")).first()["html"] == "é"
    assert files.listing(spark, str(tmp_path / "h")).first()["name"] == "a.htm"
    chunks = spark.createDataFrame([(1, "t", "abstract", "x")], "chunk_id int, title string, section_type string, text string")
    files.write_chunks(chunks, str(tmp_path / "c"))
    files.append_chunks(chunks, str(tmp_path / "p"))
    files.append_chunks(chunks, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "c")).count() == 1 and spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_visible_text_as_its_sql_has_it(spark, tmp_path):
    """A reference without its semicolon, unclosed and nested elements, white space and names of other kinds."""
    from oracle import compare

    from folioforge.plans.catalogue import ORACLES, QUERIES

    odd = ["<title>a&amp&amp;&lt</title>x&nbsp;y&#39;", "<nav>n<p>open", "<nav>a<nav>b</nav>c</nav>d", "<navé>e</nav>f", "<SCRIPT>g</SCRIPT>h", "a < b > c", "", None, "i<!-- j\n k -->l<!--m--><!--\r-->", "n\x0b \t o\u00a0", '<div class="ad">p</div><div class="x ad">q</div>', "&amp;lt;&quot;"]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert compare(QUERIES["html_strip_boilerplate"](spark, str(tmp_path)), ORACLES["html_strip_boilerplate"], str(tmp_path)) == ""
