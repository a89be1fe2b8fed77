"""Water-filling against rounds by hand; the sample near its targets."""

import odd
import pytest
from conftest import SF

from folioforge.llm import mixing
from folioforge.llm.common import table


def filled(sizes, weights, budget, cap):
    target, free, left = {}, set(sizes), budget
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def checked(rows):
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    taken: dict = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return taken, want, {s: max(r["size"] for r in rows if r["source"] == s) for s in sizes}


def test_corpus(spark):
    rows = mixing.mix(table(spark, SF, "documents")).collect()
    taken, want, largest = checked(rows)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(table(spark, SF, "documents").repartition(5)).collect()))


def test_odd(spark):
    docs = odd.documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and None in checked(rows)[1]
    assert mixing.mix(odd.empty(spark)).count() == 0
    nothing = mixing.mix(docs.filter("text is null")).collect()
    assert all(r["size"] == r["taken"] == 0 and r["target"] == 0 for r in nothing)


def test_sample_takes_what_the_mix_says(spark):
    docs = table(spark, SF, "documents")
    mixed = mixing.mix(docs)
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    assert out.agg(mixing.F.sum(mixing.words())).first()[0] == mixed.agg(mixing.F.sum("taken")).first()[0]
    assert mixing.sample(odd.documents(spark)).columns == odd.documents(spark).columns


def by_source(rows):
    out: dict = {}
    for s, n in rows:
        out[s] = out.get(s, 0) + n
    return out


def test_taken_is_near_its_target_with_null_repeated_and_equal_rows(spark):
    ten = "a b c d e f g h i j"
    cases = {
        "null ids": [(None, f"{k} {ten}") for k in range(50)] + [(k, f"{k} {ten}") for k in range(50)],
        "one id": [(7, f"{k} {ten}") for k in range(100)],
        "equal rows": [(7, ten)] * 100,
        "null ids of equal rows": [(None, ten)] * 60 + [(1, ten)] * 40,
    }
    for name, rows in cases.items():
        docs = spark.createDataFrame([(i, t, s, "x", k) for s in ("a", "b", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, row string, mix_times int").repartition(3)
        mixed = mixing.mix(docs).collect()
        taken, want, largest = checked(mixed)
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in want), (name, taken, want)
        again = mixing.mix(docs.repartition(5)).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, mixed))
        out = mixing.sample(docs)
        assert out.columns == docs.columns
        got = by_source((r["source"], len(r["text"].split())) for r in out.collect())
        assert got == taken, name


def test_threshold_weighs_the_next_document_behind_empty_bins(spark):
    shift = mixing.HASH_BITS - mixing.RADIX
    rows = [(s, n, k << shift) for s in ("a", None) for n, k in ((10, 100), (10, 500), (100, 900))]
    rows = spark.createDataFrame(rows, "mix_source string, size long, hash long")
    for want, taken in ((80.0, 120), (60.0, 20), (5.0, 10), (3.0, 0), (120.0, 120)):
        targets = spark.createDataFrame([(s, 120, want, 0, want) for s in ("a", None)], "mix_source string, source_size long, target double, whole long, extra double")
        got = {r["src"]: r["threshold"] for r in mixing._thresholds(rows, targets).collect()}
        assert {s: sum(r["size"] for r in rows.collect() if r["mix_source"] == s and r["hash"] < t) for s, t in got.items()} == {"a": taken, None: taken}


def test_ranks(spark):
    names = ["b", None, "é", "a", "Z", "aa"]
    got = {r["x"]: r["rank"] for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "x string"), "x").collect()}
    assert got == {"Z": 0, "a": 1, "aa": 2, "b": 3, "é": 4, None: 5}
