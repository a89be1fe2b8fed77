"""Branches of the operators that the queries don't reach."""

import pytest
from conftest import SF

from folioforge.config import SearchSettings
from folioforge.operators import browse, citations, rag, search
from folioforge.schema import COLLEGE_PROGRAMS, PROGRAMS, TABLES
from folioforge.sources import tables as S


def test_settings():
    assert SearchSettings().candidates == 20 and SearchSettings(top_k=15).candidates == 30
    with pytest.raises(ValueError):
        SearchSettings(min_score=2)


def test_schemas_parse(spark):
    assert all(spark.createDataFrame([], ddl).columns for ddl in TABLES.values())


def test_chips_and_programs():
    r = browse.Request(q="x", tags=("a", "b"), college="ccs")
    assert browse.chips(r) == [("college", "ccs", "q=x&tag=a&tag=b"), ("tag", "a", "q=x&college=ccs&tag=b"), ("tag", "b", "q=x&college=ccs&tag=a")]
    assert browse.programs_of("cba", COLLEGE_PROGRAMS, PROGRAMS) == ["bsba", "bsa"] and len(browse.programs_of("", COLLEGE_PROGRAMS, PROGRAMS)) == 7


def test_empty_queries(spark):
    c = S.chunks(spark, SF)
    assert search.keyword(c, " ").count() == 0 and search.bm25(c, "...").count() == 0


def test_keyword_scan_limit(spark):
    c = S.chunks(spark, SF)
    assert search.keyword(c, "the", 50, most=3).count() <= 3


def test_page_zero_brings_the_whole_paper(spark):
    c = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (3, 8, 1)], "id long, paper_id long, page int")
    assert {r["id"] for r in rag.expand(c.filter("id = 1"), c).collect()} == {1, 2}


def test_variants_and_prompt(spark):
    assert rag.query_variants("q", "1. a\nx\n2. b\n3. c") == ["q", "a", "b"]
    got = rag.prompt(spark.createDataFrame([("c",)], "context string"), "why?").first()["prompt"]
    assert "c" in got and "why?" in got


def test_upsert_keeps_the_first_of_equal_scores(spark):
    ddl = "source long, matched long, raw string, score double, seq long"
    old = spark.createDataFrame([(1, 2, "old", 0.5, 0)], ddl)
    new = spark.createDataFrame([(1, 2, "same", 0.5, 1), (3, 4, "late", 0.7, 3), (3, 4, "early", 0.7, 2)], ddl)
    assert {r["raw"] for r in citations.upsert(old, new).collect()} == {"old", "early"}


def test_answer_context(spark):
    chunks = spark.createDataFrame([(i, 1, i // 2 + 1, i, f"t{i}", [float(i), 1.0]) for i in range(8)], "id long, paper_id long, page int, chunk_id int, text string, vec array<float>")
    got = rag.answer_context(chunks, 1, "t0", [0.0, 1.0], k=1).first()
    assert got["chunks"] == 4 and got["pages"] == 2 and got["context"].count("PAGE") == 2


def test_best_per_row_like_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(search, "BLOCK", 7)
    rng = random.Random(2)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(120)] + [(500, None), (501, [0.0] * 4), (502, [1.0, 2.0]), (503, [])]
    right = spark.createDataFrame(vectors, "id long, vec array<float>").repartition(3)
    left = right.filter("id % 5 = 0 or id >= 500").selectExpr("id as qid", "vec as qvec").repartition(2)

    def cosine(x, y):
        n = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        return sum(a * b for a, b in zip(x, y)) / n if n else None

    for unlike in (None, "qid"):
        want = {}
        for i, x in vectors:
            if (i % 5 and i < 500) or not x:
                continue
            near = [(-c, j) for j, y in vectors if y and len(y) == len(x) and (j != i or not unlike) and (c := cosine(x, y)) is not None]
            for rank, (c, j) in enumerate(sorted((round(c, 9), j) for c, j in near)[:3], 1):
                want[i, rank] = (j, -c)
        got = {(r["qid"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in search.best_per_row(left, right, 3, unlike=unlike).collect()}
        assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})
        assert sum(got[k][0] == want[k][0] for k in want) >= len(want) - 3  # the last digit may break a tie otherwise


def test_fallback_wants_whole_terms(spark):
    c = spark.createDataFrame([(1, 1, "riverbank", [1.0, 0.0]), (2, 2, "lake", [0.0, 1.0])], "id long, paper_id long, text string, vec array<float>")
    assert [r["id"] for r in search.semantic(c, "river", [0.0, 1.0], SearchSettings(min_score=0.2)).collect()] == [2]
    assert [r["id"] for r in search.semantic(c, "riverbank", [0.0, 1.0], SearchSettings(min_score=0.2)).collect()] == [1]


CHIPS = (
    (0, "author", "Doe", "q=rivers&college=ccs&year=2019&tag=red&tag=deep+blue"),
    (0, "college", "ccs", "q=rivers&author=Doe&year=2019&tag=red&tag=deep+blue"),
    (0, "year", "2019", "q=rivers&author=Doe&college=ccs&tag=red&tag=deep+blue"),
    (0, "tag", "red", "q=rivers&author=Doe&college=ccs&year=2019&tag=deep+blue"),
    (0, "tag", "deep blue", "q=rivers&author=Doe&college=ccs&year=2019&tag=red"),
    (2, "college", "coe", "program=bsce&year=x%26y"),
    (2, "program", "bsce", "college=coe&year=x%26y"),
    (2, "year", "x&y", "college=coe&program=bsce"),
    (3, "tag", "a", "tag=a+b"),
    (3, "tag", "a b", "tag=a"),
)


def test_chips_of_one_request_and_of_rows(spark):
    requests = (
        browse.Request(q="rivers", author="Doe", tags=("red", "deep blue"), college="ccs", program="", year="2019"),
        browse.Request(),
        browse.Request(college="coe", program="bsce", year="x&y"),
        browse.Request(tags=("a", "a b")),
    )
    assert [(i, *chip) for i, r in enumerate(requests) for chip in browse.chips(r)] == list(CHIPS)
    rows = [(i, r.author, r.college, r.program or None, r.year, list(r.tags) or None) for i, r in enumerate(requests)]
    got = browse.chip_rows(spark.createDataFrame(rows, "id int, author string, college string, program string, year string, tags array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted((i, name, value, rest.removeprefix("q=rivers&")) for i, name, value, rest in CHIPS)


def test_programs_and_undeclared_pairs(spark):
    pairs = spark.createDataFrame([("ccs", "b"), ("ccs", "a"), ("ccs", "a"), ("coe", "c"), (None, "d")], "college string, program string")
    assert {r["college"]: r["programs"] for r in browse.programs_by_college(pairs).collect()} == {"ccs": ["a", "b"], "coe": ["c"], "": ["a", "b", "c"]}
    assert [tuple(r) for r in browse.undeclared(pairs, pairs.filter("program <> 'b'")).dropna().collect()] == [("ccs", "b")]
