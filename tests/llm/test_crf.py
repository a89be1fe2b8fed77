"""The CRF's marginals against enumeration of all paths; accuracy on the held-out fold."""

import itertools

import numpy as np
import odd

from folioforge.llm import crf, q04_language
from folioforge.llm.common import table


def test_marginals_like_enumeration():
    rng = np.random.default_rng(0)
    for k, sizes in ((2, [1, 5]), (3, [6, 1, 4])):
        model = crf.Model([str(i) for i in range(k)], None, rng.normal(size=(k, k)), rng.normal(size=k))
        pot = np.exp(rng.normal(size=(sum(sizes), k)))
        got, at = crf.marginals(model, pot, np.array(sizes)), 0
        for n in sizes:
            want = np.zeros((n, k))
            for path in itertools.product(range(k), repeat=n):
                w = np.exp(model.start[path[0]] + sum(model.moves[a, b] for a, b in itertools.pairwise(path))) * np.prod([pot[at + i, y] for i, y in enumerate(path)])
                for i, y in enumerate(path):
                    want[i, y] += w
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
            at += n


def test_blocks_join_like_one_run():
    rng = np.random.default_rng(1)
    model = crf.Model(["a", "b", "c"], None, rng.normal(size=(3, 3)), rng.normal(size=3))
    pot = np.exp(rng.normal(size=(300, 3)))
    alpha, beta = [np.exp(model.start) * pot[0]], [np.ones(3)]
    for t in range(1, 300):
        a = alpha[-1] @ np.exp(model.moves) * pot[t]
        alpha.append(a / a.sum())
        b = np.exp(model.moves) @ (pot[300 - t] * beta[-1])
        beta.append(b / b.sum())
    want = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(crf.marginals(model, pot, np.array([300])), want / want.sum(axis=1, keepdims=True))


def test_expected_counts_like_enumeration():
    rng = np.random.default_rng(2)
    k, size = 3, 4
    emit, moves, start = rng.normal(size=(2, size, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    mask = np.array([[True] * size, [True] * 3 + [False]])
    gold = rng.integers(0, k, (2, size))
    (hot, gold_pairs, gold_first), (node, pairs, first) = crf._expected(emit, moves, start, mask, gold)
    want_pairs, want_first = np.zeros((k, k)), np.zeros(k)
    for s in range(2):
        n, total, want = int(mask[s].sum()), 0.0, np.zeros((size, k))
        seq_pairs, seq_first = np.zeros((k, k)), np.zeros(k)
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(start[path[0]] + sum(emit[s, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            seq_first[path[0]] += w
            for i, y in enumerate(path):
                want[i, y] += w
            for a, b in itertools.pairwise(path):
                seq_pairs[a, b] += w
        assert np.allclose(node[s, :n], want[:n] / total)
        want_pairs, want_first = want_pairs + seq_pairs / total, want_first + seq_first / total
    assert np.allclose(pairs, want_pairs) and np.allclose(first, want_first)
    assert gold_pairs.sum() == 5 and gold_first.sum() == 2 and np.allclose(hot.sum(axis=2), 1)


def test_long_texts_part_by_part_like_whole(monkeypatch):
    model, rng = small(), np.random.default_rng(3)
    words = "the river und der fluss garden 12 -- stadt village berg " .split()
    texts = ["  " + " ".join(rng.choice(words, n)) + " " * 200 + " ".join(rng.choice(words, n)) + "\n" for n in (1, 40, 200, 333)] + ["the", "x" * 90, " " * 99 + "der"]
    want = crf.Labeller(model).documents(texts)
    for part in (1, 7, 60, 700):
        monkeypatch.setattr(crf, "PART", part)
        got = crf.Labeller(model).documents(texts)
        assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_a_long_text_takes_little_memory():
    import tracemalloc

    model = small()
    text = " ".join(np.random.default_rng(4).choice("the river und der fluss garden".split(), 2_500_000))
    tracemalloc.start()
    langs, _ = crf.Labeller(model).documents([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert langs[0] in ("en", "de") and len(text) > 12_000_000 and most < 300_000_000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = table(spark, sf, "documents").select("doc_id", "lang")
    rows = q04_language.query(spark, sf).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def small():
    en, de = "the river and the garden of this village".split(), "der fluss und die stadt auf dem berg".split()
    return crf.train([("en", en * 8), ("de", de * 8)] * 6)


def test_code_switched_runs(spark):
    text = "the garden of the village und der berg auf dem fluss"
    got = crf.runs(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string"), small()).collect()
    assert [(r["lang"], r["words"]) for r in got[0]["runs"]] == [("en", 5), ("de", 6)] and got[1]["runs"] == [] == got[2]["runs"]


def test_odd(spark):
    docs = odd.documents(spark, [(30, "der fluss und die stadt"), (31, "　"), (32, "٣٤ 12")])
    got = {r["doc_id"]: r for r in crf.predict(docs, small()).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == got[31]["lang_pred"] == got[32]["lang_pred"] == "und"
    assert got[30]["lang_pred"] == "de" and got[30]["score"] > 0.8 and got[4]["lang_pred"] in ("en", "de")
    kept = crf.accept(docs, small())
    assert kept.columns == docs.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    nothing = crf.fit(odd.empty(spark))
    assert nothing.langs == [] and {r["lang_pred"] for r in crf.predict(docs, nothing).collect()} == {"und"}
    assert crf.predict(odd.empty(spark), small()).count() == 0
