"""Browsing: optional filters, facets, flags, pages and the filter chips. Everything is lazy; filters reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlencode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Request:
    """What a search form asks for; an empty value asks for nothing."""

    q: str = ""
    author: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)
    college: str = ""
    program: str = ""
    year: str = ""
    page: str = "1"


def filtered(papers: DataFrame, r: Request) -> DataFrame:
    """College and program equal (F1), year equal unless it is no number (F2), any of the tags."""
    if r.college:
        papers = papers.filter(F.col("college") == r.college)
    if r.program:
        papers = papers.filter(F.col("program") == r.program)
    if r.year.strip().lstrip("+-").isdigit():
        papers = papers.filter(F.col("year") == int(r.year))
    if r.tags:
        papers = papers.filter(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in r.tags))))
    return papers


def with_tag(papers: DataFrame, tag: str) -> DataFrame:
    return papers.filter(F.array_contains("tags", tag))


def with_author(papers: DataFrame, author: str, n: int = 10) -> DataFrame:
    """The first n items of an author, exact and case-sensitive; other filters don't apply."""
    return papers.filter(F.array_contains("authors", author)).orderBy("id").limit(n)


def facets(papers: DataFrame, *columns: str) -> DataFrame:
    """Distinct values (facet, value) of each column, nulls kept."""
    parts = [papers.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_of(df: DataFrame, number: str | int, size: int, *order) -> DataFrame:
    """A page with its row numbers; a bad number means the first page, one beyond the end the last.

    A top-k of `number * size` rows is enough if the page exists, so the whole table is only counted, not sorted.
    """
    try:
        n = int(number)
    except ValueError:
        n = 1
    pages = max(1, -(-df.count() // size))
    n = pages if n > pages or n < 1 else n
    return df.orderBy(*order).offset((n - 1) * size).limit(size)


def look_ahead(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page with `has_next`, from one row more than it shows."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    w = Window.orderBy(*order)  # size + 1 rows
    return rows.withColumn("row", F.row_number().over(w)).withColumn("has_next", F.count("*").over(Window.partitionBy()) > size).filter(F.col("row") <= size).drop("row")


def chips(r: Request) -> list[tuple[str, str, str]]:
    """(name, value, query string without it) of each active filter."""
    pairs = [(k, getattr(r, k)) for k in ("q", "author", "college", "program", "year") if getattr(r, k)] + [("tag", t) for t in r.tags]
    return [(k, v, urlencode([p for p in pairs if p != (k, v)])) for k, v in pairs if k != "q"]


def chip_rows(requests: DataFrame) -> DataFrame:
    """(id, name, value, remove) of each active filter of requests(id, author, college, program, year, tags).

    `remove` is the query string of the request without that filter. Empty and null values ask for nothing.
    """
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    single = F.array(*(pair(c, F.col(c)) for c in ("author", "college", "program", "year")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: pair("tag", t))
    active = F.filter(F.concat(single, tags), lambda p: p["value"].isNotNull() & (p["value"] != ""))
    each = requests.select("id", active.alias("active")).select("id", "active", F.explode("active").alias("chip"))
    rest = F.filter("active", lambda p: p != F.col("chip"))
    remove = F.array_join(F.transform(rest, lambda p: F.concat(p["name"], F.lit("="), F.url_encode(p["value"]))), "&")
    return each.select("id", "chip.name", "chip.value", remove.alias("remove"))


def programs_by_college(papers: DataFrame) -> DataFrame:
    """(college, programs) to choose from: each college's, and under the empty name, for no choice, all."""
    pairs = papers.filter("college is not null and program is not null").select("college", "program").distinct()
    every = pairs.select(F.lit("").alias("college"), "program").distinct()
    return pairs.unionByName(every).groupBy("college").agg(F.array_sort(F.collect_list("program")).alias("programs"))


def undeclared(pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """Distinct (college, program) of pairs that aren't declared."""
    return pairs.select("college", "program").distinct().join(declared.select("college", "program").distinct(), ["college", "program"], "left_anti")


def saved_flag(papers: DataFrame, saved: DataFrame, user: int) -> DataFrame:
    """papers with `is_saved` for a user."""
    mine = saved.filter(F.col("user_id") == user).select(F.col("paper_id").alias("id"), F.lit(True).alias("is_saved")).distinct()
    return papers.join(mine, "id", "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def saved_list(saved: DataFrame, papers: DataFrame, uploaders: DataFrame, user: int) -> DataFrame:
    """A user's saved items with their uploaders, newest first."""
    mine = saved.filter(F.col("user_id") == user)
    return mine.join(papers, mine.paper_id == papers.id).join(uploaders, "uploader", "left").orderBy(F.desc("saved_at"), "id")


def programs_of(college: str, mapping: dict[str, tuple[str, ...]], programs: tuple[str, ...]) -> list[str]:
    """Programs to choose from for a college; all if none is chosen."""
    return [p for p in programs if not college or p in mapping.get(college, ())]


def in_order(ids: DataFrame, titles: DataFrame, position: str = "pos") -> DataFrame:
    """Titles of a list of ids in the list's order."""
    return ids.join(titles, "id").orderBy(position)


def may_see(email: str, domain: str):
    """Whether a column of addresses is of a domain."""
    return F.coalesce(F.lower(F.col(email)).endswith("@" + domain), F.lit(False))
