"""Totals after signed batches against a direct count; batches count once."""

from collections import Counter

import odd
import public_tokenizers as P
import tiktoken

from folioforge.llm import q06_rollups
from folioforge.llm.bpe import load_ranks
from folioforge.llm.rollups import Rollup

DDL = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long"


def test_query(spark, monkeypatch):
    docs = odd.documents(spark)
    monkeypatch.setattr(q06_rollups, "table", lambda *a: docs)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want: Counter = Counter()
    for r in docs.collect():
        for version, n in (("byte_bpe_50k", len(own.encode_ordinary(r["text"] or ""))), ("words", len((r["text"] or "").split()))):
            if n:
                want[r["source"], r["lang"], version, "d"] += 1
                want[r["source"], r["lang"], version, "t"] += n
    got = {}
    for r in q06_rollups.query(spark, "").collect():
        got[r["source"], r["lang"], r["tokenizer"], "d"], got[r["source"], r["lang"], r["tokenizer"], "t"] = r["documents"], r["tokens"]
    assert got == dict(want)


def test_batches_count_once_and_compact(spark, tmp_path):
    r = Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", None, "v", None, 5), ("insert", "a", None, "v", None, 7), ("insert", None, "en", "v", None, None)], DDL)
    then = spark.createDataFrame([("revise", "a", None, "v", 5, 6), ("delete", "a", None, "v", 7, None)], DDL)
    assert [r.commit("1", first), r.commit("1", first), r.commit("2", then), r.commit("2", then), r.commit("3", first.limit(0))] == [True, False, True, False, True]
    want = {("a", None, "v", 1, 6), (None, "en", "v", 1, 0)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit("2", then)
    assert r.commit("4/~ 4", then.limit(1)) and not r.commit("4/~ 4", then) and {tuple(x) for x in r.totals().collect()} == {("a", None, "v", 1, 7), (None, "en", "v", 1, 0)}
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == {("a", None, "v", 1, 7), (None, "en", "v", 1, 0)}


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    import pytest

    r = Rollup(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="unknown change"):
        r.commit("1", spark.createDataFrame([("odd", "a", "b", "v", 1, 1)], DDL))
    assert not r.committed("1") and r.totals().count() == 0


class Crash(Exception):
    pass


def crash(*a, **k):
    raise Crash


def test_a_crash_between_any_two_steps_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    import pytest

    r = Rollup(spark, str(tmp_path / "r"))
    first = spark.createDataFrame([("insert", "a", "en", "v", None, 5)], DDL)
    then = spark.createDataFrame([("insert", "b", "en", "v", None, 3)], DDL)
    one, both = {("a", "en", "v", 1, 5)}, {("a", "en", "v", 1, 5), ("b", "en", "v", 1, 3)}
    totals = lambda: {tuple(x) for x in r.totals().collect()}
    with monkeypatch.context() as m:  # the sums are written, the commit isn't
        m.setattr(Rollup, "_mark", crash)
        with pytest.raises(Crash):
            r.commit("1", first)
    assert not r.committed("1") and totals() == set()
    assert r.commit("1", first) and totals() == one
    with monkeypatch.context() as m:  # the same of a compaction
        m.setattr(Rollup, "_mark", crash)
        with pytest.raises(Crash):
            r.compact()
    assert totals() == one
    mark = Rollup._mark
    with monkeypatch.context() as m:  # a batch arrives between what a compaction reads and what it commits

        def late(self, kind, name):
            m.setattr(Rollup, "_mark", mark)
            assert r.commit("2", then)
            mark(self, kind, name)

        m.setattr(Rollup, "_mark", late)
        r.compact()
    assert totals() == both
    with monkeypatch.context() as m:  # two writers pass the first look, and both come through
        m.setattr(Rollup, "committed", lambda *a: False)
        assert r.commit("2", then) and r.commit("3", then) and r.commit("3", then)
    assert totals() == {("a", "en", "v", 1, 5), ("b", "en", "v", 2, 6)}
    r.compact()
    assert totals() == {("a", "en", "v", 1, 5), ("b", "en", "v", 2, 6)}


def test_clean_up_keeps_totals_and_bounds_what_is_listed(spark, tmp_path):
    """After 40 batches in rounds of compaction and clean-up a commit lists no more than it did at first."""
    import os

    folder = str(tmp_path / "r")
    r = Rollup(spark, folder)
    r.SEGMENTS = 2
    one = spark.createDataFrame([("insert", "a", "en", "v", None, 5)], DDL).cache()
    listed = []
    for k in range(5):
        for m in range(4):
            assert r.commit(f"{k}-{m}", one)
        r.compact()
        assert r.clean(grace=3600) == 0  # nothing is old enough
        assert r.clean(grace=0) > 0
        listed.append((len(r._commits()), len(r._listed("compactions")), len(r._listed("data"))))
        assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "v", 4 * (k + 1), 20 * (k + 1))}
    assert set(listed) == {(0, 1, 1)} and len(os.listdir(f"{folder}/segments")) <= 3
    assert not any(r.commit(f"{k}-{m}", one) for k in range(5) for m in range(4))
    assert r.clean(grace=0) == 0


def test_clean_up_of_crashed_and_doubled_attempts(spark, tmp_path, monkeypatch):
    import pytest

    r = Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", "a", "en", "v", None, 5)], DDL)
    with monkeypatch.context() as m:
        m.setattr(Rollup, "_mark", crash)
        with pytest.raises(Crash):
            r.commit("1", one)
    with monkeypatch.context() as m:
        m.setattr(Rollup, "committed", lambda *a: False)
        assert r.commit("2", one) and r.commit("2", one)
    assert len(r._listed("data")) == 3 and r.clean(grace=0) >= 2
    assert len(r._listed("data")) == 1 and {tuple(x) for x in r.totals().collect()} == {("a", "en", "v", 1, 5)}
    r.compact()
    with monkeypatch.context() as m:  # a clean-up that stops after its first removal
        drop, calls = Rollup._drop, []

        def once(self, kind, name):
            if calls:
                raise Crash
            calls.append(1)
            drop(self, kind, name)

        m.setattr(Rollup, "_drop", once)
        with pytest.raises(Crash):
            r.clean(grace=0)
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "v", 1, 5)} and not r.commit("2", one)
    assert r.clean(grace=0) > 0 and {tuple(x) for x in r.totals().collect()} == {("a", "en", "v", 1, 5)}


def test_two_compactions_at_once_and_long_names(spark, tmp_path, monkeypatch):
    r = Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", "a", "en", "v", None, 5)], DDL)
    long = "name/" * 200
    assert r.commit(long, one) and not r.commit(long, one)
    state = r._last()
    r.compact()
    with monkeypatch.context() as m:  # the other compaction began before the first one ended
        m.setattr(Rollup, "_last", lambda self: state)
        assert r.commit("late", one)
        r.compact()
    want = {("a", "en", "v", 2, 10)}
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit(long, one) and not r.commit("late", one)
    r.compact()
    r.clean(grace=0)
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit(long, one) and not r.commit("late", one)
