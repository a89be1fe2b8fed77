"""SimHash: fingerprints by definition, links and components by brute force."""

import random

import numpy as np
import odd
import xxhash
from conftest import SF

from folioforge.llm import components, simhash
from folioforge.llm.common import table


def plain(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps, ids):
    f, comp = np.array(fps, dtype=np.uint64), np.array([10**9 if i is None else i for i in ids])
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(f))])
        if (new == comp).all():
            return [None if c == 10**9 else int(c) for c in comp]
        comp = new


def held(rows, key="doc_id"):
    want = grouped([r["fp"] & (1 << 64) - 1 for r in rows], [r[key] for r in rows])
    assert [r["component_id"] for r in rows] == want


def test_fingerprints():
    for t in (None, "", " \n", "One", "one TWO", "É a b c", "a b a b a b a b c", "x " * 50_000):
        assert simhash.fingerprint(t) == plain(t)


def test_blocks_lose_no_shingle(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 9)
    for t in ("", "one", "one two", "a b c d e f g h i j k l m n", "  lead and   trail  ", "x" * 50 + " y z " + "w" * 30):
        assert simhash.fingerprint(t) == plain(t)


def test_corpus(spark):
    held(simhash.near_duplicates(table(spark, SF, "documents")).collect())


def test_odd(spark):
    held(simhash.near_duplicates(odd.documents(spark)).collect())
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0


def fingerprints_near(n):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    out = set(base)
    for b in base:
        for _ in range(n):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64 if rng.random() < 0.3 else 20)
            out.add(x)
    return sorted(out)


def test_links_with_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    fps = fingerprints_near(60)
    signed = [simhash._signed(x) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(nodes).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and want


def test_keep_one(spark):
    docs = odd.documents(spark, [(20, "this is one text of some words"), (21, "this is one text of some words"), (22, "quite another one with other words in it")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {20, 22} <= set(ids) and 21 not in ids and ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(6) == 1
    assert ids.count(None) == 1  # "a b c d"; the null text goes with document 1
    assert simhash.keep_one(odd.empty(spark)).count() == 0


def test_keep_one_tells_rows_with_one_key_apart(spark):
    rng = random.Random(8)
    a, b, c, d, e, f, g = (" ".join(str(rng.random()) for _ in range(30)) for _ in range(7))
    rows = [(3, a), (7, a), (7, b), (9, c), (9, d), (5, e), (5, e), (None, f), (None, f), (None, g), (4, g)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    for again in (docs, docs.repartition(5)):
        kept = simhash.keep_one(again)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, a), (7, b), (9, c), (9, d), (5, e), (None, f), (4, g)], key=repr)


def test_texts_are_shuffled_alike_whatever_the_size(spark):
    plans = []
    for n in (5, 20_000):
        docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id, ' of ', id * 7, ' words ', id * 31) as text")
        plans.append(simhash.keep_one(docs)._jdf.queryExecution().optimizedPlan().toString())
    assert all("strategy=shuffle_hash" in p for p in plans)


def test_components_of_a_hub(spark):
    rng = random.Random(6)
    names = rng.sample(range(10**6), 4000)
    hub, chain = names[0], names[3000:]
    edges = [(hub, x) if rng.random() < 0.5 else (x, hub) for x in names[1:3000]] + list(zip(chain, chain[1:], strict=False))
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: min(names[:3000]) for x in names[:3000]} | {x: min(chain) for x in chain}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(5, 5), (-3, 7), (None, 2)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
