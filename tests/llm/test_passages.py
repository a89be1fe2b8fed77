"""Compact windows by definition; passages against brute force over all pairs."""

import random

import numpy as np
import odd
import pytest
from conftest import SF

from folioforge.llm import passages as P
from folioforge.llm import q10_passages
from folioforge.llm.common import table


def test_windows_cover_every_subsequence_once():
    s = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    for least in (1, 7):
        for j in range(P.HASHES):
            h = P._mix(s ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            mine = [(a, c, b) for f, a, c, b in P.windows(s, least) if f == j]
            for i in range(60):
                for k in range(i + least - 1, 60):
                    hits = [c for a, c, b in mine if a <= i <= c <= k <= b]
                    assert hits == [i + int(h[i : k + 1].argmin())]


def brute(texts, least=P.LEAST):
    """Classes of texts that share a run of `least` shingles."""
    runs, up = {}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in texts.items():
        w = (t or "").lower().split()
        for k in range(len(w) - least - 3):
            j = runs.setdefault(tuple(w[k : k + least + 4]), i)
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return {i: find(i) for i in texts}


def test_corpus_loses_no_shared_run(spark):
    docs = table(spark, SF, "documents")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: r["class_id"] for r in q10_passages.query(spark, SF).collect()}
    assert all(got[i] == got[want[i]] for i in want)


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, near = text(60), text(120)
    edited = [w if i not in (30, 90) else "edited" for i, w in enumerate(near)]
    rows = [(100 + i, text(rng.randint(0, 80)) + shared + text(80)) for i in range(6)]
    rows += [(200, text(40) + near + text(9)), (201, text(5) + edited + text(70)), (300, text(200)), (301, text(150) + shared[:40] + text(50)), (302, shared[:49])]
    copy = text(70)
    rows += [(400, copy), (401, copy), (402, text(20)), (403, text(20))]
    return [(i, " ".join(w)) for i, w in rows]


def test_planted(spark):
    docs = odd.documents(spark, planted())
    rows = {r["doc_id"]: r for r in P.classes(docs).collect()}
    assert P.classes(docs).count() == docs.count()
    assert all(rows[100 + i]["class_id"] == 100 and rows[100 + i]["n_links"] > 0 for i in range(6))
    assert rows[201]["class_id"] == 200 and rows[401]["class_id"] == 400
    for i in (300, 301, 302, 402, 403):
        assert rows[i]["class_id"] == i and rows[i]["n_links"] == 0 and rows[i]["spans"] == []
    for r in rows.values():
        spans = [(s["from"], s["to"]) for s in r["spans"]]
        assert spans == sorted(spans) and all(x[1] < y[1] and x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    at = [(s["from"], s["to"]) for s in rows[200]["spans"]]
    assert at and all(abs(a - 40) < 6 and abs(b - 159) < 6 for a, b in at)


def test_verify_wants_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    b = a.copy()
    assert P.verify(a, b, [(50, 50)]) == [(0, 99, 0, 99)]
    b[::3] = rng.integers(0, 2**63, len(b[::3])).astype(np.uint64)
    assert P.verify(a, b, [(50, 50)]) == []


def test_runs_are_told_apart_by_their_words():
    words = [str(k % 7) for k in range(60)]
    runs, at = P.Runs(P._words(" ".join(words))), np.arange(40)
    for size in (1, 9, 16):
        got = runs(at, size).tolist()
        want = [tuple(words[k : k + size + 4]) for k in at]
        assert all((x == y) == (u == v) for x, u in zip(got, want) for y, v in zip(got, want))


def test_overlapping_excerpts_stay_linked(spark):
    rng = random.Random(11)
    rows = []
    for k in range(1000, 2200, 3):
        source = [str(rng.random()) for _ in range(90)]
        rows += [(k, " ".join(source[:60])), (k + 1, " ".join(source)), (k + 2, " ".join(source[30:]))]
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    assert [got[i] for i in range(1000, 2200)] == [i - (i - 1000) % 3 for i in range(1000, 2200)]


def test_passages_around_a_frequent_line(spark):
    rng = random.Random(12)
    text = lambda n: [str(rng.random()) for _ in range(n)]
    line, rows = text(40), []
    for k in range(1000, 1060, 3):
        shared = text(5) + line + text(5)
        rows += [(k + m, " ".join(text(20) + shared + text(20))) for m in range(3)]
    rows += [(2000 + k, " ".join(text(30) + line + text(30))) for k in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    assert [got[i] for i in range(1000, 1060)] == [i - (i - 1000) % 3 for i in range(1000, 1060)]
    assert all(got[2000 + k] == 2000 + k for k in range(60))


def near(a, b, i, j, least=P.LEAST, similarity=P.SIMILARITY):
    """Whether any two stretches of a and b, equally far around i and j, are near-duplicates."""
    for p in range(min(i, j) + 1):
        for q in range(min(len(a) - i, len(b) - j)):
            x, y = set(a[i - p : i + q + 1].tolist()), set(b[j - p : j + q + 1].tolist())
            if p + q + 1 >= least and len(x & y) >= similarity * len(x | y):
                return True
    return False


def test_verify_like_brute_force_on_short_near_duplicates():
    rng = random.Random(7)
    found = 0
    for n in (50, 54, 60, 75, 84, 89, 100):
        for edits in (1, 1, 1, 2, 3):
            words = [str(rng.random()) for _ in range(n)]
            other = list(words)
            for k in rng.sample(range(n), edits):
                other[k] = "edited"
            a, b = P.shingles(" ".join(words)), P.shingles(" ".join(other))
            seeds = np.flatnonzero(a == b)[::9].tolist()
            around = [near(a, b, i, i) for i in seeds]
            for i, here in zip(seeds, around, strict=True):  # all passages on the chain of runs through i, so also those beside it
                got = P.verify(a, b, [(i, i)])
                assert any(around) or not got, (n, edits, i)
                assert any(p <= i <= q for p, q, _, _ in got) or not here, (n, edits, i)
                assert all(min(q - p, v - u) + 1 >= P.LEAST and P._similar(a[p : q + 1], b[u : v + 1], P.SIMILARITY) for p, q, u, v in got)
                found += bool(got)
    assert found > 50


def test_verify_crosses_an_edit_between_two_short_runs():
    words = [f"w{i}" for i in range(60)]
    a, b = P.shingles(" ".join(words)), P.shingles(" ".join(words[:29] + ["x"] + words[30:]))
    assert P.verify(a, b, [(10, 10)]) == P.verify(a, b, [(40, 40)]) == [(0, 55, 0, 55)]
    b = P.shingles(" ".join(words[:30] + ["put", "in"] + words[30:]))
    assert P.verify(a, b, [(10, 10)]) == [(0, 55, 0, 57)]


def test_words_in_blocks_like_one(monkeypatch):
    texts = [None, "", "  ", "one", "A b\tc\nd  e " * 9, " lead " + "x" * 40 + " tail\n"]
    want = [P._words(t).tolist() for t in texts]
    for size in (1, 7, 30):
        monkeypatch.setattr(P, "BLOCK", size)
        assert [P._words(t).tolist() for t in texts] == want


def test_a_long_text_takes_little_memory():
    import tracemalloc

    text = " ".join(map(str, np.random.default_rng(0).integers(0, 200_000, 3_000_000).tolist()))
    assert len(text) > 19_000_000
    tracemalloc.start()
    runs, _, found = P._found(text, P.LEAST)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(runs.sums) == 3_000_001 and found.shape[1] > 300_000 and most < 400_000_000


def test_both_ways_to_follow_runs_agree():
    rng = random.Random(3)
    for _ in range(60):
        words = [str(rng.random()) for _ in range(rng.randint(60, 300))]
        other = list(words)
        for _ in range(rng.randint(0, 9)):
            at, n = rng.randrange(len(other)), rng.randint(0, 12)
            other[at : at + n] = [str(rng.random()) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.3:  # a block that moves
            other = other[40:] + other[:40]
        a, b = P._Text(P.shingles(" ".join(words))), P._Text(P.shingles(" ".join(other)))
        assert a.once and b.once
        quick, slow = P._Alike(a, b), P._Repeating(a, b)
        for i, j in list(zip(quick.in_a.tolist(), quick.in_b.tolist(), strict=True))[::7]:
            for most in (4.0, 15.0, 60.0):
                assert quick.chain(i, j, most).tolist() == slow.chain(i, j, most).tolist()


def repeated(word, n):
    return [word] * n


def test_a_run_of_one_word_makes_one_window():
    s = P.shingles(" ".join(repeated("the", 500) + [str(k) for k in range(60)] + repeated("of", 300)))
    assert len(P.windows(s)) < 40


def test_passages_of_repeated_words_are_found(spark):
    rng = random.Random(17)
    text = lambda n: [str(rng.random()) for _ in range(n)]
    rows, k = [], 1000
    for _ in range(12):
        tail = text(40)
        w = text(1)[0]
        cases = [(repeated(w, 80), repeated(w, 55)), (repeated(w, 100) + tail, repeated(w, 12) + tail), (tail + repeated(w, 90), tail + repeated(w, 11)), (repeated(w, 30) + tail, repeated(w, 200) + tail)]
        for k, (x, y) in enumerate(cases, k):
            v = f"{k}"
            rows += [(2 * k, " ".join(text(20) + [v if q == w else q + v for q in x] + text(20))), (2 * k + 1, " ".join(text(9) + [v if q == w else q + v for q in y] + text(30)))]
        k += 1
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    assert all(got[i] == i - i % 2 for i, _ in rows)


def shingled(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_of_near_duplicates(spark):
    """Planted passages of 50 to 400 words with words replaced, put in or left out at all places, from 0.8 on."""
    rng = random.Random(23)
    text = lambda n: [str(rng.random())[2:9] for _ in range(n)]
    rows, kinds = [], {}
    while len(kinds) < 600:
        words = text(rng.choice((50, 55, 60, 80, 110, 160, 200, 300, 400)))
        other, kind = list(words), rng.choice(("replaced", "put in", "left out"))
        edits = sorted(rng.sample(range(len(words)), rng.randint(1, 8)), reverse=True)
        if rng.random() < 0.3:  # evenly spread edits leave the shortest runs
            edits = [round(len(words) * (m + 1) / (len(edits) + 1)) for m in range(len(edits))][::-1]
        for at in edits:
            other[at : at + (kind != "put in")] = [] if kind == "left out" else text(1)
        x, y = shingled(words), shingled(other)
        if min(len(words), len(other)) < 50 or len(x & y) < 0.8 * len(x | y):
            continue
        k = 1000 + 2 * len(kinds)
        kinds[k] = (kind, len(words), len(edits))
        around = (0, 0, 0, 0) if rng.random() < 0.3 else [rng.randint(0, 60) for _ in range(4)]
        rows += [(k, " ".join(text(around[0]) + words + text(around[1]))), (k + 1, " ".join(text(around[2]) + other + text(around[3])))]
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    lost = [v for k, v in kinds.items() if got[k + 1] != k]
    assert len(lost) <= 0.03 * len(kinds), lost
    assert all(got[k] == k for k in kinds)


def any_near(x, y, least=P.LEAST):
    """Whether any two stretches of two lists of shingles are near-duplicates: all of them are compared."""
    stretches = lambda z: [set(z[i:j]) for i in range(len(z)) for j in range(i + least, len(z) + 1)]
    ys = stretches(y)
    return any(len(a & b) >= P.SIMILARITY * len(a | b) for a in stretches(x) for b in ys)


def test_classes_like_brute_force_over_all_pairs(spark):
    rng = random.Random(29)
    text = lambda n: [str(rng.random())[2:9] for _ in range(n)]
    texts = {}
    for k in range(10):
        words = text(rng.randint(50, 62))
        for m in range(4):
            other = list(words)
            for _ in range(m and rng.randint(1, 3)):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 1)] = text(rng.randint(0, 1))
            texts[1000 + 10 * k + m] = other
    grams = {k: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for k, w in texts.items()}
    common = lambda a, b: len(set(grams[a]) & set(grams[b])) >= P.SIMILARITY * P.LEAST
    linked = [(a, b) for a in texts for b in texts if a < b and common(a, b) and any_near(grams[a], grams[b])]
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, [(k, " ".join(w)) for k, w in texts.items()])).collect()}
    assert all(find(got[k]) == find(k) for k in texts)  # no class joins what brute force doesn't
    lost = [(a, b) for a, b in linked if got[a] != got[b]]
    assert len(linked) > 20 and len(linked) < 55 and len(lost) <= 0.03 * len(linked), (len(linked), lost)


def test_exact_repeats_around_a_common_template(spark):
    """Passages around a line that all texts have; the line alone is too short to make two of them near-duplicates."""
    rng = random.Random(31)
    text = lambda n: [str(rng.random())[2:9] for _ in range(n)]
    template, rows = text(40), []
    for k in range(1000, 1300, 2):
        head, tail = text(rng.randint(5, 6)), text(rng.randint(5, 6))
        rows += [(k + m, " ".join(text(20 * m) + head + template + tail + text(20 * m))) for m in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    assert sum(got[k + 1] == got[k] for k in range(1000, 1300, 2)) == 150
    assert len({got[k] for k in range(1000, 1300, 2)}) == 150


@pytest.mark.parametrize("edit", ["line", "own"])
def test_edited_passages_in_groups_of_hundreds(spark, edit):
    """100 pairs around a line of all 200 texts, one word of the line or of the words beside it replaced: recall, and no pair joins another."""
    rng = random.Random(37)
    text = lambda n: [str(rng.random())[2:9] for _ in range(n)]
    template, rows = text(40), []
    for k in range(1000, 1200, 2):
        words = text(12) + template + text(12)
        other = list(words)
        other[rng.randrange(12, 52) if edit == "line" else rng.choice([*range(4, 12), *range(52, 60)])] = text(1)[0]
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    assert sum(got[k + 1] == got[k] for k in range(1000, 1200, 2)) >= 97
    assert all(got[k + m] in (k, k + 1) for k in range(1000, 1200, 2) for m in range(2))


def test_edited_passages_between_frequent_contexts(spark):
    """100 pairs around a line of all 200 texts with a word in its middle replaced: no shingle near that is far enough from
    the edit for a context of 39, and most contexts of nine are the line's."""
    rng = random.Random(41)
    text = lambda n: [str(rng.random())[2:9] for _ in range(n)]
    template, rows = text(40), []
    for k in range(1000, 1200, 2):
        words = text(5) + template + text(5)
        other = list(words)
        other[rng.randrange(22, 28)] = text(1)[0]
        x, y = shingled(words), shingled(other)
        assert len(x & y) >= 0.8 * len(x | y)
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    got = {r["doc_id"]: r["class_id"] for r in P.classes(odd.documents(spark, rows)).collect()}
    assert sum(got[k + 1] == got[k] for k in range(1000, 1200, 2)) >= 98  # three functions agree on none for one of a hundred
    assert all(got[k + m] in (k, k + 1) for k in range(1000, 1200, 2) for m in range(2))


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    docs = odd.documents(spark, planted())
    want = sorted(map(tuple, P.classes(docs).select("doc_id", "class_id").collect()), key=repr)
    real, calls = P.F.xxhash64, []

    def narrow(*c):
        if len(c) == 1 and isinstance(c[0], str):
            calls.append(c)
            return real(*c) % 7
        return real(*c)

    monkeypatch.setattr(P.F, "xxhash64", narrow)
    assert sorted(map(tuple, P.classes(docs).select("doc_id", "class_id").collect()), key=repr) == want and calls


def test_empty(spark):
    assert P.classes(odd.empty(spark)).count() == 0


def test_only_texts_outside_the_largest_component_meet_a_whole_group(spark):
    """A group of 300 rows of one component and a few others: pairs with the few, each once, never its square."""
    rows = [(1, d, 90 << 24 | 60 << 12 | 60, 0 if d < 300 else d) for d in range(304)]
    groups = spark.createDataFrame(rows, "key long, digest long, at long, root long")
    for part in (1024, 7):
        P.PART, before = part, P.PART
        try:
            got = sorted((r["a"], r["b"]) for r in P._every_pair(groups, P.LEAST).collect())
        finally:
            P.PART = before
        assert got == [(a, b) for a in range(304) for b in range(max(a + 1, 300), 304)]


def test_seeds_tried_before_are_taken_off_row_by_row(spark):
    """Two texts that share a repeated line meet at thousands of places; comparing their lists with each other took minutes."""
    pairs = spark.sql("select 1L a, 2L b, transform(sequence(0, 11999), k -> struct(int(k) as i, int(k % 7) as j)) seeds")
    tried = spark.sql("select 1L a, 2L b, transform(sequence(0, 11997), k -> struct(int(k) as i, int(k % 7) as j)) seeds")
    plan = P._new(pairs, tried)
    assert sorted(map(tuple, plan.first()["seeds"])) == [(11998, 0), (11999, 1)]
    assert "array_except" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert P._new(tried, pairs).isEmpty()


def test_pairs_without_enough_in_common_are_not_verified(spark):
    def near(digest, keys, common=41):
        return digest, 5, len(keys), common, keys, [k % 65536 - 32768 for k in keys]

    rows = [near(1, list(range(91))), near(2, list(range(50, 141))), near(3, list(range(51, 142))), near(4, list(range(91)), 91), near(5, [k + 65536 for k in range(91)])]
    table = spark.createDataFrame(rows, "digest long, at long, n int, common int, keys array<long>, marks array<short>")
    pairs = spark.createDataFrame([(1, k, 5, 5) for k in (2, 2, 3, 4, 5)], "a long, b long, a_at long, b_at long")
    got = sorted((r["a"], r["b"]) for r in P._alike(pairs, table).collect())
    assert got == [(1, 2), (1, 4), (1, 5)]  # 41 in common, 40, all; marks that are equal by chance only add pairs
