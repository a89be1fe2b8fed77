"""Kept tables: rules, several writers, crashes, buckets; pages of a kept order."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import browse, page_index
from folioforge.operators import kept as kept_module
from folioforge.operators.kept import KeptTable, pair_counts
from folioforge.operators.page_index import PageIndex

DDL = "k long, name string, v long"


class Crash(Exception):
    pass


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, DDL)


@pytest.fixture
def table(spark, tmp_path):
    return lambda rule="last", buckets=4: KeptTable.create(spark, str(tmp_path / rule.replace(":", "-")), DDL, ["k", "name"], rule, buckets)


CHANGES = [[(1, "a", 5), (2, None, 7), (None, "x", 1)], [(1, "a", 3), (3, "c", 0)], [(2, None, 9), (1, "a", 5), (3, "c", -4)], []]


@pytest.mark.parametrize("rule", ["last", "first", "best:v", "sum:v"])
def test_rules_like_a_dict(spark, table, rule):
    kept, want = table(rule), {}
    for number, change in enumerate(CHANGES):
        kept.upsert(frame(spark, change))
        for k, name, v in change:
            old = want.get((k, name))
            want[k, name] = {"last": v, "first": v if old is None else old, "best:v": max(v, v if old is None else old), "sum:v": (old or 0) + v}[rule]
        if number == 1:
            assert kept.compact() and not kept.compact() and len(kept.snapshot()["deltas"]) == 1
        expected = {k: v for k, v in want.items() if v or rule != "sum:v"}
        assert {(r["k"], r["name"]): r["v"] for r in kept.read().collect()} == expected


def test_deletes_and_lookups(spark, table):
    kept = table(buckets=16)
    kept.upsert(frame(spark, [(k, "n", k) for k in range(200)]))
    kept.delete(frame(spark, [(3, "n", 0), (900, "n", 0)]))
    kept.upsert(frame(spark, [(4, "n", 44)]))
    assert kept.read().count() == 199
    found = kept.lookup(frame(spark, [(3, "n", 0), (4, "n", 0), (5, "other", 0), (6, "n", 0)]))
    assert rows(found) == [(4, "n", 44), (6, "n", 6)]
    assert len(found.inputFiles()) < len(kept.read().inputFiles())
    with pytest.raises(ValueError, match="deleted"):
        table("sum:v").delete(frame(spark, []))


def test_a_change_writes_its_buckets_only(spark, table):
    kept = table(buckets=16)
    kept.upsert(frame(spark, [(k, "n", k) for k in range(400)]))
    kept.upsert(frame(spark, [(7, "n", 70)]))
    first, second = kept.snapshot()["deltas"]
    assert len(first["buckets"]) == 16 and len(second["buckets"]) == 1
    assert kept.read().filter("k = 7").first()["v"] == 70 and kept.read().count() == 400


def test_two_writers_and_a_batch_that_comes_twice(spark, table, monkeypatch):
    kept = table("sum:v")
    other = KeptTable(spark, kept.folder)
    create, calls = KeptTable._create, []

    def late(self, state):  # another writer takes the number that this one is about to take
        if not calls:
            calls.append(1)
            assert other.upsert(frame(spark, [(1, "a", 10)]), stream=("s", 0))
        return create(self, state)

    monkeypatch.setattr(KeptTable, "_create", late)
    assert kept.upsert(frame(spark, [(1, "a", 1)]), stream=("t", 0))
    monkeypatch.undo()
    assert rows(kept.read()) == [(1, "a", 11)] and kept.snapshot()["number"] == 2
    assert not kept.upsert(frame(spark, [(1, "a", 1)]), stream=("t", 0)) and not other.upsert(frame(spark, [(1, "a", 1)]), stream=("s", 0))
    assert kept.upsert(frame(spark, [(1, "a", -11)]), stream=("t", 1)) and rows(kept.read()) == []


@pytest.mark.parametrize("step", ["_written", "_create", "draft"])
def test_a_crash_between_any_two_steps(spark, table, monkeypatch, step):
    kept = table()
    kept.upsert(frame(spark, [(1, "a", 1), (2, "b", 2)]))
    kept.upsert(frame(spark, [(1, "a", 3)]))
    before = rows(kept.read())

    def crash(*a, **k):
        raise Crash

    for change in (lambda: kept.upsert(frame(spark, [(9, "z", 9)])), kept.compact, lambda: kept.delete(frame(spark, [(2, "b", 0)]))):
        with monkeypatch.context() as m:
            if step == "draft":  # the delta is written, the draft of the snapshot isn't
                m.setattr(kept_module, "write_files", crash)
            else:
                m.setattr(KeptTable, step, crash)
            with pytest.raises(Crash):
                change()
        assert rows(kept.read()) == before
    assert kept.upsert(frame(spark, [(9, "z", 9)])) and len(rows(kept.read())) == 3
    assert kept.clean(grace=0) > 0 and len(rows(kept.read())) == 3


def test_a_change_during_a_compaction_stays_and_two_compactions_exclude_each_other(spark, table, monkeypatch):
    kept = table()
    for k in range(3):
        kept.upsert(frame(spark, [(k, "a", k), (0, "a", k)]))
    written, calls = KeptTable._written, []

    def late(self, df):
        out = written(self, df)
        if not calls:
            calls.append(1)
            assert self.upsert(frame(spark, [(0, "a", 77)])) and self.compact()
        return out

    monkeypatch.setattr(KeptTable, "_written", late)
    assert not kept.compact()  # the one that came in between took its deltas
    monkeypatch.undo()
    assert rows(kept.read()) == [(0, "a", 77), (1, "a", 1), (2, "a", 2)]
    kept.clean(grace=0)
    assert rows(kept.read()) == [(0, "a", 77), (1, "a", 1), (2, "a", 2)] and kept.clean(grace=0) == 0


def test_many_changes_are_compacted(spark, table, monkeypatch):
    monkeypatch.setattr(kept_module, "DELTAS", 2)
    kept = table()
    for k in range(5):
        kept.upsert(frame(spark, [(k, "a", k), (0, "a", k)]))
        assert len(kept.snapshot()["deltas"]) <= 2
    assert rows(kept.read()) == [(0, "a", 4), *((k, "a", k) for k in range(1, 5))]


def test_distinct_pairs(spark, tmp_path):
    kept = KeptTable.create(spark, str(tmp_path / "p"), "source long, matched long, n long", ["matched", "source"], "sum:n")
    make = lambda data: spark.createDataFrame(data, "source long, matched long, n long")
    kept.upsert(make([(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, None, 1), (4, 6, 1)]))
    kept.upsert(make([(1, 5, -1), (2, 5, -1), (4, 6, -1)]))
    assert {tuple(r) for r in pair_counts(kept).collect()} == {(5, 1)}


def test_pages_like_a_sort(spark, tmp_path):
    rng = random.Random(1)
    data = [(k, "n", rng.randrange(40)) for k in range(997)]
    order = [F.desc("v"), F.asc("k")]
    index = PageIndex.build(frame(spark, data), str(tmp_path / "pages"), order, rows=50)
    want = sorted(data, key=lambda r: (-r[2], r[0]))
    for number, size in ((1, 20), (7, 20), (50, 20), (51, 20), ("x", 20), (0, 7), (3, 333), (2, 990)):
        assert [tuple(r) for r in index.page(number, size).collect()] == [tuple(r) for r in browse.page_of(frame(spark, data), number, size, *order).collect()]
    page = index.look_ahead(50, 20).collect()
    assert [tuple(r)[:3] for r in page] == want[980:1000] and not page[0]["has_next"] and index.look_ahead(49, 20).first()["has_next"]
    deep = index.page(40, 20)
    assert deep.inputFiles() and len({f.split("range=")[1].split("/")[0] for f in deep.inputFiles()}) <= 20
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range#" in plan.split("PartitionFilters")[1]


def test_pages_of_nothing(spark, tmp_path):
    assert PageIndex.build(frame(spark, []), str(tmp_path / "none"), ["k"]).page(3, 20).count() == 0


def test_a_page_sorts_its_own_rows_only(spark, tmp_path):
    """Neither rows before a page nor a sample that grows with the table come to the driver."""
    data = [(k, k % 7) for k in range(1000)]
    index = PageIndex.build(spark.createDataFrame(data, "k long, v long"), str(tmp_path / "pages"), [F.desc("v"), F.asc("k")], rows=300)
    want = sorted(data, key=lambda r: (-r[1], r[0]))
    for start in (0, 295, 299, 750, 990):
        assert [tuple(r) for r in index.slice(start, 20).collect()] == want[start : start + 20]
    assert "offset=" not in index.slice(750, 20)._jdf.queryExecution().executedPlan().toString().lower()
    assert page_index.MOST <= 1000


def test_what_a_task_puts_together_is_bounded(spark, table, monkeypatch):
    """Many rows are dealt by their keys before they are reduced, and buckets to several tasks, as they are written."""
    monkeypatch.setattr(kept_module, "ROWS", 50)
    kept = table("sum:v", buckets=2)
    one = frame(spark, [(k % 400, "a", 1) for k in range(800)]).coalesce(1)
    assert kept.upsert(one) and kept.upsert(frame(spark, [(k, "a", -2) for k in range(100)]))
    assert rows(kept.read()) == [(k, "a", 2) for k in range(100, 400)]
    assert [d["rows"] for d in kept.snapshot()["deltas"]] == [800, 100]
    sizes = [r["count"] for r in kept.read().groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 60  # of 300, where 4 tasks had about 75
    first = kept.snapshot()["deltas"][0]["name"]
    files = spark.read.parquet(f"{kept.folder}/data/{first}").groupBy(F.input_file_name()).count()
    assert files.count() > 2 and files.agg(F.max("count")).first()[0] < 150
