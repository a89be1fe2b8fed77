
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Long names of colleges and programs to their codes.
COLLEGE_CODES = {
    "college of computer studies": "ccs",
    "college of business and accountancy": "cba",
    "college of arts and sciences": "cas",
    "college of engineering": "coe",
    "college of education": "ced",
    "college of nursing": "con",
    "college of international hospitality management": "cihm",
}
PROGRAM_CODES = {
    "bachelor of science in computer science": "bscs",
    "bachelor of science in information technology": "bsit",
    "bachelor of science in business administration": "bsba",
    "bachelor of secondary education": "bse",
    "bachelor of science in accountancy": "bsa",
    "bachelor of science in civil engineering": "bsce",
    "bachelor of science in nursing": "bsn",
    "bachelor of science in hospitality management": "bshm",
}
#: Phrases that follow a title on a title page.
CUES = (
    "a thesis proposal",
    "a case study proposal",
    "a research paper presented",
    "a capstone project",
    "a thesis presented",
    "a research study presented",
    "an undergraduate thesis",
    "a graduate thesis",
    "a dissertation",
    "a final project",
)
#: Lines that end a list of references (X9), and tags that say nothing.
ENDS = ("appendix", "acknowledgements", "about the authors", "glossary")
STOP_TAGS = ("this paper", "our approach", "application", "approach", "paper")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(q: str) -> str:
    """A regex that matches q literally, whatever q holds."""
    return "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_ci(text, q: str) -> Column:
    """Case-insensitive literal containment."""
    return F.contains(F.lower(col(text)), F.lit(q.lower()))


def occurrences(text, q: str) -> Column:
    """Non-overlapping, case-insensitive literal occurrences (Q1); an empty q occurs nowhere."""
    return F.regexp_count(col(text), F.lit("(?iu)" + literal(q))) if q else F.lit(0)


def highlight(text, q: str) -> Column:
    """Every literal occurrence of q in <mark>, its case kept (Q8)."""
    return F.regexp_replace(col(text), "(?iu)" + literal(q), "<mark>$0</mark>") if q else col(text)


def escape_html(text) -> Column:
    """HTML-escaped; null becomes the empty string."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(col(text), F.lit("")))


def escape_highlight(text, q: str) -> Column:
    """Escaped, then highlighted (Q9); the query itself isn't escaped."""
    return highlight(escape_html(text), q)


def snippet(text, q: str) -> Column:
    """The first sentence or paragraph with q, stripped and highlighted; '' if there is none (Q10)."""
    parts = F.split(col(text), r"(?<=[.!?])\s+|\n+")
    hit = F.filter(parts, lambda p: F.contains(F.lower(p), F.lit(q.lower())))
    return highlight(F.trim(F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(""))), q)


def words(text) -> Column:
    """Whitespace-separated words; none for null."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def is_short(text, least: int = 5) -> Column:
    """Fewer than `least` words."""
    return F.size(words(text)) < least


def present(text) -> Column:
    """Not null and not blank (F16)."""
    return F.coalesce(F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "") != "", F.lit(False))


def truncate(text, n: int) -> Column:
    """At most n characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(col(text)) > n, F.concat(F.left(col(text), F.lit(n - 1)), F.lit("…"))).otherwise(col(text))


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^\w\s-]", ""), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def or_default(c, default) -> Column:
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def section_valid(title) -> Column:
    """Whether a heading begins a section worth chunking."""
    t = F.lower(col(title))
    starts = reduce(lambda a, b: a | b, (t.startswith(f"chapter {n}") for n in ("i", "v")))
    skip = reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in ("figure", "table", "appendix", "bibliography", "references")))
    return (F.contains(t, F.lit("abstract")) | starts) & ~skip


def section_class(title) -> Column:
    """Kind of a section; the first that applies."""
    t = F.trim(F.lower(col(title)))
    chapter = lambda n: t.rlike(rf"^chapter\s*{n}\b")
    related = F.contains(t, F.lit("review of related")) | F.contains(t, F.lit("related studies"))
    return (
        F.when(F.contains(t, F.lit("abstract")), "abstract").when(chapter("i"), "introduction").when(chapter("ii") | related, "rrl")
        .when(chapter("iii"), "methodology").when(chapter("iv"), "results").when(chapter("v"), "conclusion").otherwise("other")
    )


def clean_lines(text) -> Column:
    """Stripped lines without blank ones, with the OCR slip " 0." mended."""
    lines = F.split(F.replace(col(text), F.lit(" 0."), F.lit(" O.")), r"\R")
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _first_line(text, *prefixes: str) -> Column:
    starts = lambda x: reduce(lambda a, b: a | b, (F.lower(x).startswith(p) for p in prefixes))
    return F.try_element_at(F.filter(F.transform(F.split(col(text), r"\R"), strip), starts), F.lit(1))


def college_line(text) -> Column:
    """The first line that begins with "college", without a trailing "of" (X13)."""
    return F.regexp_replace(_first_line(text, "college"), r"(?i)\s+of$", "")


def program_line(text) -> Column:
    """The first line that begins with "bachelor" or "degree" (X14)."""
    return _first_line(text, "bachelor", "degree")


def years(text) -> Column:
    """All years 20xx."""
    return F.regexp_extract_all(col(text), F.lit(r"\b(20\d{2})\b"), F.lit(1))


def page_title(text) -> Column:
    """The run of lines above the first line with a cue phrase, joined; null without a cue."""

    def title(lines: Column, at: Column) -> Column:
        above = F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))
        return F.when(at > 0, once(above, lambda a: F.array_join(once(F.array_position(F.reverse(a), F.lit("")), lambda blank: below(a, blank)), " ")))

    def below(above: Column, blank: Column) -> Column:
        return F.when(blank == 0, above).otherwise(F.slice(above, (F.size(above) - blank + 2).cast("int"), (blank - 1).cast("int")))

    def place(lines: Column) -> Column:
        lower = F.transform(lines, lambda x: F.lower(x))
        return F.array_position(F.transform(lower, lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(c)) for c in CUES))), F.lit(True))

    return once(F.transform(F.split(strip(col(text)), r"\R"), strip), lambda lines: once(place(lines), lambda at: title(lines, at)))


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), where x is worked out once, however often it is used there."""
    return F.element_at(F.transform(F.array(x), of), 1)


def description(text) -> Column:
    """From "project description:" to the next line "chapter n", white space collapsed; null without."""
    found = F.regexp_extract(col(text), r"(?ism)^\s*project description\s*:(.*?)(?=^\s*chapter\s+\d+|\z)", 1)
    return F.nullif(strip(F.regexp_replace(found, r"(?U)\s+", " ")), F.lit(""))


def code_of(name, codes: dict[str, str]) -> Column:
    """Code of a long name, whatever its case; null if it has none."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(col(name))))


def citation_title(cite) -> Column:
    """Title of a reference: after the year, else the first part of over three words, else 100 characters (X11)."""
    c = col(cite)
    after = F.regexp_extract(c, r"\(\d{4}\)\.\s*(.+?)\.\s*", 1)
    parts = F.filter(F.split(c, r"\."), lambda p: (F.size(words(p)) > 3) & ~F.contains(p, F.lit("(")))
    return F.when(c.rlike(r"\(\d{4}\)\.\s*(.+?)\.\s*"), strip(after)).otherwise(F.coalesce(strip(F.try_element_at(parts, F.lit(1))), strip(F.left(c, F.lit(100)))))


def local_doi(prefix: str, college, year, program, key) -> Column:
    """prefix/college.year.program.00001; what is null reads None."""
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit("None"))
    n = text(key)
    padded = F.when(F.length(n) < 5, F.lpad(n, 5, "0")).otherwise(n)
    return F.concat(F.lit(f"{prefix}/"), text(college), F.lit("."), text(year), F.lit("."), text(program), F.lit("."), padded)


def author_list(form) -> Column:
    """Names of a form, one a line; an empty list fails the form."""
    return F.filter(F.transform(F.split(F.coalesce(col(form), F.lit("")), r"\R"), strip), lambda x: x != "")


def clean_tags(phrase) -> Column:
    """Tags of a noun phrase: lower case, article dropped, stop tags and long ones left out, "x y and z w" parted."""
    t = F.lower(F.regexp_replace(strip(col(phrase)), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"^(the|a|an)\s+", "")
    fine = (F.length(t) > 2) & ~t.isin(*STOP_TAGS) & (F.size(words(t)) <= 6)
    parts = F.filter(F.transform(F.split(t, " and "), strip), lambda p: F.size(words(p)) > 1)
    return F.when(~F.coalesce(fine, F.lit(False)), F.array().cast("array<string>")).when(F.contains(t, F.lit(" and ")), parts).otherwise(F.array(t))


def reply_json(reply, ddl: str) -> Column:
    """The object in a model's reply, fenced or bare, by a DDL; null if it isn't valid."""
    fenced = F.nullif(F.regexp_extract(col(reply), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.from_json(F.coalesce(fenced, col(reply)), ddl)


def topic(tag, topics: list[str]) -> Column:
    """The first topic that the tag contains, else Other (Q22)."""
    t = F.lower(col(tag))
    found = F.filter(F.array(*(F.lit(x) for x in topics)).cast("array<string>"), lambda k: F.contains(t, k))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("Other"))


def cloud_size(count) -> Column:
    """Size of a tag in a cloud (Q23)."""
    return F.when(col(count) > 6, "large").when(col(count) > 3, "medium").otherwise("small")


def tokens(text) -> Column:
    """Search terms: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def mend_latin1(text) -> Column:
    """Text that was read as Latin-1 though it is UTF-8; left as it is if it isn't."""
    c = col(text)
    return F.when(c.rlike(r"^[\x00-\xff]*$"), F.coalesce(F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")), c)).otherwise(c)


def chm_path(path) -> Column:
    """A path of an unpacked help archive: forward slashes, without the control's prefix."""
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"(?i)hhctrl://", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))


def figure_page(path) -> Column:
    """Page of an extracted figure by its file name; null without."""
    return F.nullif(F.regexp_extract(col(path), r"page(\d+)_img", 1), F.lit("")).cast("int")
