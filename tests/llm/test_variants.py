"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import odd
import numpy as np
import pytest
from oracle import compare

from folioforge.llm import q12_variants, variants


def edits(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, times=5):
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and edits(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= times * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted((w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items())


def vocabulary(docs, every=199, shortest=6, least=5):
    total = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= least}


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_like_duckdb(spark):
    assert compare(q12_variants.query(spark, "/root/testdata/sf0.001"), q12_variants.ORACLE_SQL, "/root/testdata/sf0.001") == ""


def test_query_like_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = rows(q12_variants.query(spark, "/root/testdata/sf0.001"))
    assert got == brute(vocabulary(docs)) and any(r[1] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_random_words_like_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abà"), n)): int(5 ** rng.integers(1, 6)) + int(rng.integers(0, 2)) for n in rng.integers(1, 6, 150)}
    found = variants.forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert rows(variants.rooted(found)) == brute(words)


def test_a_way_of_many_steps_ends_at_its_root(spark):
    words = {"aaaaaaaaaaaa"[:k] + "b" * (12 - k): 5 ** (k + 1) for k in range(13)}
    found = variants.forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    got = rows(variants.rooted(found))
    assert got == brute(words) and {r[2] for r in got} == {"a" * 12}


def test_ties_go_to_the_smallest_word(spark):
    words = {"garden": 5, "gardem": 50, "gardeé": 50, "gardens": 50, "arden": 50}
    found = variants.forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r[0]: r[1] for r in rows(variants.rooted(found))}["garden"] == "arden"


def test_letters_case_and_noise(spark):
    docs = [(k, "ÉCOLES écoles Straße×x it's gardens' GARDENS naïve_forests") for k in range(40)] + [(None, "forests forests"), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in variants.counts(df, every=3).filter("n >= 5").collect()}
    assert got == vocabulary(docs, every=3)
    plain = {r["word"]: r["n"] for r in variants.counts(df).filter("n >= 5").collect()}
    assert plain == vocabulary(docs, every=0) and plain["Écoles"] == 40 and plain["gardens"] == 80 and "straße×x" in plain


def test_counts_handed_on_early(spark, monkeypatch):
    docs = [(k, f"common{'abcdefg'[k % 7]}{'xyz' * (k % 5)} commonest") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, variants.counts(df).collect()))
    find = variants.HELD
    try:
        variants.HELD = 2
        assert sorted(map(tuple, variants.counts(df).collect())) == whole
    finally:
        variants.HELD = find


def test_odd_tables(spark):
    docs = odd.documents(spark, [(k, "gardening gardenning Gardening " * 3) for k in range(9)])
    got = rows(variants.variants(docs))
    assert got == brute(vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()], every=0))
    assert rows(variants.variants(odd.empty(spark))) == []


def test_no_pairs_in_the_plan(spark):
    words = spark.createDataFrame([("garden", 9)], "word string, n long")
    plan = variants.forms(words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
