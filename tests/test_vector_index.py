"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import citations, search
from folioforge.operators.vector_index import VectorIndex

K = 10


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    """6,000 vectors around 60 centres, one of which has a third of all."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 24))
    of = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 60, 6000))
    vectors = centres[of] + 0.15 * rng.normal(size=(6000, 24))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vec array<double>")
    return vectors, rows, VectorIndex.build(rows, str(tmp_path_factory.mktemp("index")), lists=80)


def exact(vectors, q, k, without=None):
    s = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
    if without is not None:
        s[without] = -9
    return np.argsort(-s, kind="stable")[:k].tolist()


def test_recall_of_probes(clusters):
    vectors, _, index = clusters
    hits = 0
    for q in range(0, 6000, 300):
        got = {r["id"] for r in index.nearest(vectors[q].tolist(), K, probes=20).collect()}
        hits += len(got & set(exact(vectors, vectors[q], K)))
    assert hits >= 0.95 * 20 * K


def test_only_lists_that_are_asked_for_are_read(clusters):
    vectors, _, index = clusters
    asked = index.nearest(vectors[5].tolist(), K, probes=2)
    asked.collect()
    execution = asked._jdf.queryExecution()
    nearest = sorted(np.argsort(index.angles(vectors[5:6])[0])[:2].tolist())
    assert f"PartitionFilters: [list#" in execution.executedPlan().toString() and f"IN ({nearest[0]},{nearest[1]})" in execution.executedPlan().toString()
    assert index.n[nearest].sum() < 0.2 * index.n.sum()


def test_exact_like_the_scan(clusters):
    vectors, rows, index = clusters
    for q in (0, 17, 4242):
        for least in (None, 0.9):
            want = search.nearest(rows, vectors[q].tolist(), K, least).select("id", "similarity").collect()
            assert index.nearest(vectors[q].tolist(), K, least).select("id", "similarity").collect() == want
    far = (-vectors[3]).tolist()
    assert [r["id"] for r in index.nearest(far, 3).collect()] == exact(vectors, -vectors[3], 3)


def test_join_compares_less_than_a_tenth(clusters, spark):
    vectors, rows, index = clusters
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    compared = spark.sparkContext.accumulator(0)
    got = {}
    for r in index.best_per_row(asked, 3, unlike="qid", compared=compared).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    assert len(got) == 120
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == exact(vectors, vectors[q], 3, q)
    few = rows.filter("id % 50 = 0 and id not in (0)")
    assert few.count() == 119 and 0 < compared.value
    spread = [q for q in range(0, 6000, 50)]
    assert compared.value < 0.25 * len(spread) * 6000  # the list of the crowded cluster alone is a third of all rows


def test_join_on_even_clusters_compares_less_than_a_tenth(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(100, 16)), 40, axis=0) + 0.1 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vec array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "even"), lists=100)
    compared = spark.sparkContext.accumulator(0)
    cites = rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("id").alias("source"), F.lit("a long enough title").alias("title"), F.col("vec").alias("qvec"))
    best = index.best_per_row(cites, 1, unlike="source", least=0.15, compared=compared)
    assert {r["qid"]: r["id"] for r in best.collect()} == {q: exact(vectors, vectors[q], 1, q)[0] for q in range(0, 4000, 50)}
    assert 0 < compared.value < 0.1 * 80 * 4000
    assert {(r["qid"], r["id"]) for r in citations.best_match(cites, index).collect()} == {(q, exact(vectors, vectors[q], 1, q)[0]) for q in range(0, 4000, 50)}


def test_join_by_probes_has_recall(clusters):
    vectors, rows, index = clusters
    asked = rows.filter("id % 60 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    found = index.best_per_row(asked, K, unlike="qid", probes=20).collect()
    hits = sum(r["id"] in exact(vectors, vectors[r["qid"]], K, r["qid"]) for r in found)
    assert hits >= 0.95 * 100 * K


def test_no_cross_join(clusters):
    _, rows, index = clusters
    asked = rows.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    plan = index.best_per_row(asked, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [-1.0, 0.0])], "id long, vec array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "odd"), lists=9)
    for query in ([1.0, 0.1], [1.0, 2.0, 2.0], [0.0, 0.0], [5.0]):
        assert index.nearest(query, 9).select("id", "similarity").collect() == search.nearest(rows, query, 9).select("id", "similarity").collect()
    asked = rows.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    got = sorted((r["qid"], r["rank"], r["id"]) for r in index.best_per_row(asked, 2).collect())
    assert got == sorted((r["qid"], r["rank"], r["id"]) for r in search.best_per_row(asked, rows, 2).collect())


def test_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, vec array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "none"))
    assert index.nearest([1.0], 3).count() == 0
    assert index.best_per_row(rows.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 1).count() == 0


def test_a_vector_is_sent_once_to_each_group_of_lists(clusters):
    _, rows, index = clusters
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("key"), F.col("id").alias("unlike"), "vec", F.lit(-1.0).alias("reached"))
    sent = index._requests(asked, ["bigint", "bigint", "bigint"])
    assert sent.count() == 120 == sent.select("key", "group").distinct().count()  # 80 lists, but one group
    assert {len(r["lists"]) for r in sent.select("lists").collect()} == {int((index.n > 0).sum())}


@pytest.mark.parametrize("group, asking", [(50, 32), (700, 10_000)])
def test_join_over_many_groups_and_parts(clusters, monkeypatch, group, asking):
    monkeypatch.setattr("folioforge.operators.vector_index.GROUP", group)
    monkeypatch.setattr("folioforge.operators.vector_index.ASKED", asking)
    vectors, rows, index = clusters
    got = {}
    for r in index.best_per_row(rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 3, unlike="qid").collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    assert {q: [i for _, i in sorted(found)] for q, found in got.items()} == {q: exact(vectors, vectors[q], 3, q) for q in range(0, 6000, 50)}


def test_copies_are_not_paired_with_each_other(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(4, 8)), [3000, 5, 1, 1], axis=0)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vec array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "copies"), lists=3)
    asked = rows.filter("id % 50 = 0 or id > 2995").select(F.col("id").alias("key"), F.col("id").alias("unlike"), "vec", F.lit(-1.0).alias("reached"))
    met = index._met(index._requests(asked, ["bigint"] * 3), 3, ["bigint"] * 3, True, 1, None)
    assert met.count() == 3 * asked.count()
    got = {(r["qid"], r["rank"]): r["id"] for r in index.best_per_row(asked.select(F.col("key").alias("qid"), F.col("vec").alias("qvec")), 3, unlike="qid").collect()}
    assert [got[2950, n] for n in (1, 2, 3)] == [0, 1, 2] and [got[0, n] for n in (1, 2, 3)] == [1, 2, 3] and [got[3001, n] for n in (1, 2, 3)] == [3000, 3002, 3003]
