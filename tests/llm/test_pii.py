"""Personal data against Python's engine; disclosing terms on a planted corpus."""

import hashlib
import random
import re

import numpy as np
import odd
from conftest import SF

from folioforge.llm import pii, q03_pii
from folioforge.llm.common import table


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def fuzz(n):
    rng = random.Random(3)
    parts = ["a", "b", "@", ".", "-", "1", "25", "256", "+", "(", ")", " ", "4111111111111111", "x@y.z", "1.2.3.4", "é", "😀", "_", "%", "@m.co", "+1 (555) 123-4567", "00000000000000000000000000000.1.1.1"]
    return [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def held(spark, docs, monkeypatch):
    monkeypatch.setattr(q03_pii, "table", lambda *a: docs)
    key = lambda n, h: (*n, h)
    got = sorted(key([r[f"n_{k}"] for k in pii.KINDS], r["base_sha256"]) for r in q03_pii.query(spark, "").collect())
    want = []
    for r in docs.select("text").collect():
        b = base(r["text"])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append(key([sum(x[1] == k for x in b) for k in range(4)], hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want)


def test_fuzz_and_odd(spark, monkeypatch):
    held(spark, odd.documents(spark, [*fuzz(800), (50, "9" * 20_000), (51, "1 " * 20_000), (52, "a" * 50_000 + "@"), (53, "+1" + " " * 20_000)]), monkeypatch)


def test_corpus(spark, monkeypatch):
    held(spark, table(spark, SF, "documents"), monkeypatch)


def planted(spark):
    rng = random.Random(9)
    words = ["river", "mountain", "winter", "garden", "letter", "summer", "village", "harbour"]
    text = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, f"{text()} Zephyrine jane@doe.example {text()}") for i in range(4)]
    rows += [(200, f"{text()} zephyrine {text()}")]
    return odd.documents(spark, rows)


def test_disclosing_terms(spark):
    docs = planted(spark)
    found = {r["doc_id"]: r["s"] for r in pii.find(docs).select("doc_id", pii.listed(pii.F.col("spans")).alias("s")).collect()}
    assert all("term:" in found[i] and "email:" in found[i] for i in range(100, 104)) and found[200].startswith("term:")
    assert not any(found[i] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("[EMAIL]" in clean[i] and "ephyrine" not in clean[i] for i in range(100, 104)) and "[TERM]" in clean[200]
    low = lambda d: sorted((r["doc_id"], str(r["text"])) for r in d.filter("doc_id < 60").collect())
    assert low(pii.sanitise(docs)) == low(docs)


def brute_terms(rows, alpha=0.9, support=3):
    """term -> removed or generalised, by counts over distinct texts."""
    texts = {t or "" for t in rows}
    near, contexts, having = {}, {}, {}
    word = re.compile(r"[^\W\d_]{4,}")
    for t in texts:
        for s, k, e in base(t):
            v = t[s:e].lower() if k == 0 else t[s:e] if k == 1 else re.sub("[^0-9]", "", t[s:e])
            before, after = t[max(0, s - pii.REACH) : s], t[e : e + pii.REACH]
            before = re.sub(r"^[^\W\d_]+", "", before) if s > pii.REACH else before
            after = re.sub(r"[^\W\d_]+$", "", after) if len(after) == pii.REACH else after
            having.setdefault((k, v), set()).add(t)
            for x in {w.lower() for w in word.findall(before + "\n" + after)}:
                near.setdefault(((k, v), x), set()).add(t)
                contexts.setdefault(((k, v), x), set()).add((before + "\n" + after).lower())
    words = {t: {w.lower() for w in word.findall(t)} for t in texts}
    out = {}
    for (c, x), with_both in near.items():
        if len(contexts[c, x]) < support:
            continue
        n_t = sum(x in w for w in words.values())
        pmi, ic = np.log2(len(texts) * len(with_both) / (len(having[c]) * n_t)), -np.log2(len(having[c]) / len(texts))
        if ic > 0 and pmi >= alpha * ic - 1e-9:
            out[x] = out.get(x, False) or pmi >= ic - 1e-9
    return out


def held_terms(docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute_terms([r["text"] for r in rows])
    got = {}
    for r in pii.find(docs).join(docs.select("doc_id", "text"), "doc_id").select("text", "spans").collect():
        for s in r["spans"]:
            if s["kind"] >= len(pii.KINDS):
                assert r["text"][s["start"] : s["end"]] == s["value"]
                got.setdefault((r["text"], s["value"].lower()), s["kind"] == len(pii.KINDS) + 1)
    texts = {r["text"] or "" for r in rows}
    assert got == {(t, x): full for x, full in want.items() for t in texts if x in {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)}}
    return want


def test_terms_like_brute_force(spark):
    rng = random.Random(21)
    vocabulary = ["river", "mountain", "winter", "garden", "letter", "summer", "village", "harbour", *(f"rare{chr(97 + k)}" for k in range(8))]
    text = lambda n: " ".join(rng.choice(vocabulary[:8]) for _ in range(n))
    rows = [(i, text(60)) for i in range(150)]
    for k, mail in enumerate(("a@b.example", "c@d.example", "10.0.0.7", "+1 555 010 9999")):
        rows += [(1000 + 10 * k + m, " ".join(f"{text(30)} {vocabulary[8 + k]} {mail} {vocabulary[12 + m % 3]} {text(30)}" for _ in range(1 + m % 3))) for m in range(6)]
    rows += [(2000 + m, f"{text(30)} {vocabulary[8 + m % 3]} {text(30)}") for m in (0, 2, 3, 5, 8, 11)] + [(3000 + m, rows[155][1]) for m in range(5)]
    found = held_terms(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert (found[vocabulary[8]], found[vocabulary[9]], found[vocabulary[11]]) == (False, True, True) and vocabulary[10] not in found


def test_a_term_that_is_common_elsewhere_is_kept(spark):
    rng = random.Random(5)
    text = lambda: " ".join(str(rng.random()) for _ in range(30))
    rows = [(i, text()) for i in range(90)] + [(100 + i, f"{text()} orchard {text()}") for i in range(7)]
    rows += [(200 + i, " ".join(f"{text()} orchard jane@doe.example {text()}" for _ in range(5))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert "orchard" not in held_terms(docs)


def test_corpus_terms_like_brute_force(spark):
    held_terms(table(spark, SF, "documents").dropDuplicates(["doc_id"]))


def test_many_matches_take_time_in_proportion(spark):
    import time

    took = []
    for n in (2_000, 40_000):
        docs = spark.createDataFrame([(1, " ".join(f"word{k} u{k}@mail{k}.example" for k in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = pii.sanitise(docs).collect()
        took.append(time.perf_counter() - start)
        assert row["text"] == " ".join(f"word{k} [EMAIL]" for k in range(n))
    assert took[1] < took[0] * 20 + 20


def named(k):
    """Words of letters only, all different."""
    return "".join("bcdfghjklm"[int(d)] + "aeiouaeiou"[int(d)] for d in f"{k:05}")


def test_many_terms_take_time_in_proportion(spark):
    """Four texts with so many disclosing terms each; sixteen times the terms and texts take far less than 24 times as long."""
    import time

    took = []
    for many in (600, 2_400, 9_600):
        rng = random.Random(many)
        rows = [(k, " ".join(rng.choice(["river", "mountain", "winter", "garden"]) for _ in range(40)) + f" {k}") for k in range(60)]
        for m in range(4):
            order = list(range(many))
            rng.shuffle(order)
            rows.append((100 + m, " ".join(f"{named(k)} jane@doe.example {rng.randrange(10**9)}{'.' * 130}" for k in order)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        start = time.perf_counter()
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
        took.append(time.perf_counter() - start)
        assert all("doe" not in clean[100 + m] and named(0) not in clean[100 + m] and named(many - 1) not in clean[100 + m] for m in range(4))
        assert all(clean[k] == t for k, t in rows[:60])
    assert took[2] < 6 * took[1] + 10, took


def test_words_whose_lower_case_has_other_letters(spark):
    """A term is found wherever it was counted, also if lower case makes more of a letter."""
    rows = [(k, f"river mountain {k}") for k in range(60)] + [(100 + k, f"winter{'.' * 130} {k} İstanbulite jane@doe.example {'.' * 130}") for k in range(4)] + [(200, "İSTANBULİTE and stanbulite")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("stanbul" not in clean[100 + k] for k in range(4)) and clean[0] == rows[0][1]
    assert clean[200] == "İSTANBULİTE and stanbulite" or "İSTANBULİTE" not in clean[200]


def test_terms_that_never_occur_alone_are_removed(spark):
    docs = planted(spark).filter("doc_id <> 200")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("ephyrine" not in clean[i] and "[TERM]" not in clean[i] for i in range(100, 104))


def test_shape(spark):
    docs = odd.documents(spark, [(60, "+1 555 123 4567 and 4111 1111 1111 1111")])
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.filter("doc_id = 60").first()["text"] == "[PHONE] and [CARD]"
    assert clean.filter("doc_id = 1").first()["text"] is None
    assert pii.sanitise(odd.empty(spark)).count() == 0 and pii.find(odd.empty(spark)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = pii.sanitise(planted(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
