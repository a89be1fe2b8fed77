"""Stems by the published samples; kept indexes against scans of the texts."""

import random
import re

import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from folioforge.functions import stemming
from folioforge.operators import search, text_index
from folioforge.operators import text_index
from folioforge.operators.text_index import TextIndex, TrigramIndex
from folioforge.sources import tables as S

#: Words with their stems, from the algorithm's published vocabulary.
SAMPLES = """consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolation consol
consolatory consolatori console consol consolingly consol consonant conson conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspire conspir constable constabl constancy constanc constant constant knackeries knackeri knaves knave knavish knavish
kneaded knead kneel kneel knees knee knife knife knightly knight knitted knit knitting knit knives knive knocker knocker generate generat
general general generously generous hopping hop hoping hope relational relat conditional condit rational ration vietnamization vietnam
operator oper feudalism feudal decisiveness decis hopefulness hope sensibility sensibl triplicate triplic formative format electricity electr
goodness good allowance allow inference infer adjustable adjust replacement replac adoption adopt effective effect rate rate cease ceas
controll control roll roll ties tie cries cri gas gas this this agreed agre feed feed happy happi say say by by inning inning skies sky
dying die communication communic arsenal arsenal flying fli bees bee abilities abil""".split()


def test_stems():
    pairs = list(zip(SAMPLES[::2], SAMPLES[1::2], strict=True))
    assert [(w, stemming.stem(w)) for w, _ in pairs] == pairs
    assert all(stemming.stem(w) for w in ("", "a", "y", "ing", "eed", "''", "ée", "sss") if w) and stemming.english("the") == ""


def test_terms_have_places():
    assert stemming.terms("The Gardens, of gardening_ii", "english") == ([("garden", 1), ("garden", 3), ("ii", 4)], 5)
    assert stemming.terms(None, "simple") == ([], 0) and stemming.terms("A-b", "simple") == ([("a", 0), ("b", 1)], 2)


ROWS = [(1, "the river and the bank"), (2, "River"), (3, ""), (4, None), (5, "the riverbank, the bank: THE bank"), (6, "bank river x-river"), (7, "Banks of rivers; banking")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    chunks = spark.createDataFrame(ROWS, "id long, text string")
    return chunks, {a: TextIndex.build(chunks, str(tmp_path_factory.mktemp("index")), a) for a in ("simple", "english")}


def test_ranks_like_a_scan(small):
    chunks, index = small
    for q in ("river bank", "the", "nothing", "x river", "a.b", ""):
        want = {r["id"]: round(r["rank"], 9) for r in search.bm25(chunks.fillna("", "text"), q).collect()}
        assert {r["id"]: round(r["rank"], 9) for r in index["simple"].ranked(q).collect()} == want
        best = [r["id"] for r in index["simple"].best(q, 2).collect()]
        assert best == [i for i, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2]]


def test_stems_and_phrases(small):
    _, index = small
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(index["english"].ranked("the rivers of banking")) == [1, 6, 7] and ids(index["english"].ranked("the of")) == []
    assert ids(index["simple"].ranked("the bank", phrase=True)) == [1, 5] and ids(index["simple"].ranked("bank the", phrase=True)) == [5]
    assert ids(index["english"].ranked("bank river", phrase=True)) == [6] and ids(index["english"].ranked("banks of rivers", phrase=True)) == [7]
    assert ids(index["english"].ranked("river and the bank", phrase=True)) == [1]
    assert ids(index["simple"].ranked("river x river", phrase=True)) == [6] or ids(index["simple"].ranked("river x river", phrase=True)) == [6]
    assert [r["id"] for r in index["simple"].best("the bank", 1, phrase=True).collect()] == [5]


def test_best_by_blocks_like_all_hits(spark, tmp_path, monkeypatch):
    """Many small ranges, a frequent and a rare term: pruning leaves the best, and their order."""
    rng = random.Random(3)
    monkeypatch.setattr(text_index, "RANGE", 16)
    words = ["winter", "garden", "letter", "river"]
    rows = [(k, " ".join(rng.choices(words, [8, 4, 2, 1], k=rng.randint(1, 30)))) for k in range(900)]
    index = TextIndex.build(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), "simple")
    assert index.postings.agg(F.max("range")).first()[0] > 40
    for q in ("river", "river winter", "winter garden letter river"):
        every = sorted(((-r["rank"], r["id"]) for r in index.ranked(q).collect()))
        for k in (1, 7, 5000):
            assert [(-r["rank"], r["id"]) for r in index.best(q, k).collect()] == every[:k]
    monkeypatch.setattr(text_index, "NAMED", 3)
    assert [r["id"] for r in index.best("winter", 5).collect()] == [i for _, i in sorted((-r["rank"], r["id"]) for r in index.ranked("winter").collect())[:5]]


def test_only_the_terms_folders_and_columns_are_read(spark, tmp_path):
    index = TextIndex.build(S.chunks(spark, SF), str(tmp_path / "i"), "simple")
    plan = index.ranked("the")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+L? = \d+", plan), plan
    assert "EqualTo(term,the)" in plan and plan.count("Scan parquet") == 1
    bounds = index.postings.groupBy("term").agg(F.sum("n"))
    assert "docs" not in bounds._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_substrings_like_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE", 32)
    rng = random.Random(8)
    rows = [(k, "".join(rng.choices("abcÀé 🙂.", k=rng.randint(0, 60)))) for k in range(300)] + [(900, None), (901, "ab"), (902, "xaBCabc")]
    chunks = spark.createDataFrame(rows, "id long, text string")
    index = TrigramIndex.build(chunks, str(tmp_path / "t"))
    for q in ("abc", "ABC", "aà", "b", "cabca", "é 🙂", "zzz", "abcabc"):
        want = sorted(k for k, t in rows if t is not None and q.lower() in t.lower())
        assert sorted(r["id"] for r in index.containing(chunks, q).collect()) == want
        assert (index.candidates(q) is None) == (len(q) < 3)


def test_few_places_are_held_at_a_time(spark, tmp_path, monkeypatch):
    """Many texts in one batch leave Python in pieces; put together, they are one block for each term and range."""
    monkeypatch.setattr(text_index, "HELD", 100)
    rows = [(k, " ".join(f"w{k % 7} b{j % 5}" for j in range(k % 40))) for k in range(500)]
    one = pa.RecordBatch.from_pylist([{"id": k, "text": t, "range": k // 250} for k, t in rows])
    pieces = list(text_index.partial_blocks(iter([one]), "simple", 40.0))
    assert len(pieces) > 50 and max(len(p["docs"].values.field("at").values) for p in pieces) < 200
    want = sorted((k, t, text.split().count(t), len(text.split()), [i for i, w in enumerate(text.split()) if w == t]) for k, text in rows for t in set(text.split()))
    assert sorted((d["id"], b["term"], d["tf"], d["length"], d["at"]) for p in pieces for b in p.to_pylist() for d in b["docs"]) == want
    monkeypatch.setattr(text_index, "RANGE", 64)
    index = TextIndex.build(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), "simple")
    assert index.postings.groupBy("term", "range").count().filter("count > 1").isEmpty()
    found = index.postings.select("term", "n", F.explode("docs").alias("d"), F.size("docs").alias("size"))
    assert found.filter("n <> size").isEmpty()
    assert sorted((r["d"]["id"], r["term"], r["d"]["tf"], r["d"]["length"], r["d"]["at"]) for r in found.collect()) == want


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = TextIndex.build(none, str(tmp_path / "i"))
    assert index.ranked("a river").count() == 0 and index.best("a river", 3).count() == 0
    assert TrigramIndex.build(none, str(tmp_path / "t")).containing(none, "abc").count() == 0


def test_trigram_blocks_of_long_and_many_texts(spark, tmp_path, monkeypatch):
    """Blocks come in several pieces where a task may hold little; every text is found all the same, and none twice."""
    monkeypatch.setattr(text_index, "GRAMS", 40)
    monkeypatch.setattr(text_index, "PIECE", 7)
    texts = ["the Naïve ΣΊΣΥΦΟΣ 😀🎉x and İstanbul", "aaaa", "ab", "", None, "the the the", *(f"text {k} of some words" for k in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = TrigramIndex.build(rows, str(tmp_path / "g"))
    for q in ("the", "😀🎉x", "naïve", "aaa", "of some", "xt 7 ", "nothing"):
        want = sorted(k for k, t in enumerate(texts) if t and q in t.lower())
        found = sorted(r["id"] for r in index.candidates(q).collect())
        assert set(want) <= set(found) and len(found) == len(set(found)), q
        assert sorted(r["id"] for r in index.containing(rows, q).collect()) == want, q
    assert text_index.grams("abcdefghijabcdefghij").tolist() == sorted(ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in {("abcdefghij" * 2)[k : k + 3] for k in range(10)})


def test_trigrams_are_not_exploded(spark, tmp_path):
    """A range's blocks are made where its texts are; before, a row of every text and trigram was sorted in the JVM."""
    seen = []
    rows = spark.createDataFrame([(k, f"words of text {k}") for k in range(50)], "id long, text string")
    made = text_index.partial_grams(rows.selectExpr("id", "text", "0 as range").toArrow().to_batches())
    seen.extend(made)
    assert len(seen) == 1 and seen[0].num_rows < 200 and max(len(x) for x in seen[0].column(2).to_pylist()) == 50
