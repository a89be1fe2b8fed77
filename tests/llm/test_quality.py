"""Rule statistics by definition; forest, classifier and calibration against plain forms and held-out labels."""

import re

import numpy as np
import odd
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import q05_rules, q09_classifier, quality_classifier, quality_rules, textstats
from folioforge.llm.common import table

SF1 = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and re.search(r"[^\x20\x09-\x0D]", line) is not None
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #|é\n\t\x1c\x85 　"), max_size=60))
def test_counts(text):
    assert textstats.count(text)[:5] == plain(text)


def test_counts_of_the_corpus(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()
    assert all(textstats.count(r["text"])[:5] == plain(r["text"]) for r in rows[:60]) and textstats.count(None)[:5] == (0,) * 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#|", "é", "\n", "\t ", "\x1c", "\x85", "　", "word" * 6, " "]), max_size=60).map(" ".join))
def test_long_texts_part_by_part_like_whole(text):
    whole, most = textstats.count(text), textstats.PART
    try:
        for textstats.PART in (0, 5, 17):
            assert textstats.count(text) == whole
    finally:
        textstats.PART = most


def test_classes_of_characters_at_any_number_of_kinds():
    for n in (10, 255, 256, 257, 400):
        text = "一二三ⅧⒶ" * 3 + "Ab9" + "".join(map(chr, range(0x5000, 0x5000 + n - 8)))
        assert len(set(text)) == n
        at = textstats.COUNTS.index("n_upper")
        assert textstats.count(text)[at : at + 3] == tuple(len(regex.findall(p, text)) for p in (r"\p{Lu}", r"\p{L}", r"\p{N}"))


def test_a_long_text_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    text = "\n".join(" ".join(map(str, rng.integers(0, 200_000, 12))) for _ in range(240_000))
    tracemalloc.start()
    assert textstats.count(text)[0] == 2_880_000 and len(text) > 18_000_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300_000_000


def test_verdicts(spark):
    labels = table(spark, SF1, "labels")
    rows = q05_rules.query(spark, SF1).join(labels, "doc_id").collect()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    passed = [r for r in rows if not r["base_failed"]]
    good, bad = [r["kept"] for r in passed if r["quality"]], [r["kept"] for r in passed if not r["quality"]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def walked(tree, row):
    """A row's path length in a tree, by walking down from the root."""
    feature, at, right, path = tree
    node = 0
    while feature[node] >= 0:
        node = node + 1 if row[feature[node]] <= at[node] else right[node]
    return path[node]


def test_verdicts_like_plain_walks(spark):
    Q = quality_rules
    docs, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    found = Q.judge(docs, labels).withColumn("place", Q.F.pmod(Q.F.xxhash64(Q.F.lit(Q.SEED), "doc_id"), Q.F.lit(1 << 30))).withColumn("held", Q.held_out()).collect()
    counts = {r["doc_id"]: [r[c] for c in textstats.COUNTS] for r in found}
    passed = sorted((r["place"], counts[r["doc_id"]], r["doc_id"]) for r in found if not r["base_failed"])
    assert len(passed) < Q.SAMPLE
    forest = Q.Forest(Q.rules(np.array([c for _, c, _ in passed], dtype=np.int64)))
    n = forest.size
    usual = 2 * (np.log(n - 1) + Q.EULER) - 2 * (n - 1) / n
    score = {}
    for r in found[::7]:
        row = Q.rules(np.array([counts[r["doc_id"]]], dtype=np.int64))[0]
        score[r["doc_id"]] = 2 ** -(np.mean([walked(t, row) for t in forest.trees]) / usual)
        assert abs(score[r["doc_id"]] - r["anomaly"]) < 1e-9
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learned = [(r["anomaly"], truth[r["doc_id"]]) for r in found if r["doc_id"] in truth and not r["held"] and not r["base_failed"]]
    best = (0.0, float("inf"))
    for k in range(Q.BINS + 1):
        good, bad = ([int(a * Q.BINS) < k for a, q in learned if q == want] for want in (1, 0))
        if np.mean(good) >= Q.KEEP and np.mean(good) - np.mean(bad) > best[0] + 1e-12:
            best = (np.mean(good) - np.mean(bad), k / Q.BINS)
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly"] < best[1]) for r in found) and best[1] < 1


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    score = quality_rules.Forest(rows).score(rows)
    assert score.argmax() == 500 and score[:500].mean() < 0.55
    assert (quality_rules.Forest(rows[:1]).score(rows) == 0).all()


def test_without_labels(spark):
    docs = odd.documents(spark, [(40, " ".join(f"w{i}" for i in range(60)))])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, none).collect()}
    assert got[40] and not got[1] and not got[4]
    assert {r["score"] for r in quality_classifier.classify(docs, none).collect()} == {0.0}
    assert quality_rules.judge(odd.empty(spark), none).count() == 0 and quality_classifier.classify(odd.empty(spark), none).count() == 0


def test_isotonic():
    got = quality_classifier.isotonic(np.array([1, 0, 2, 1, 3.0]), np.array([1, 1, 4, 4, 3.0]))
    assert np.all(np.diff(got) >= 0) and np.allclose(got, [0.4, 0.4, 0.4, 0.4, 1.0])


def test_normal_equations_like_least_squares(spark):
    stats = textstats.statistics(table(spark, SF1, "documents"))
    labels = table(spark, SF1, "labels")
    model = quality_classifier.fit(stats, labels)
    rows = stats.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 <> 0").select(*textstats.COUNTS, "quality").toPandas()
    z, y = model.features(rows[list(textstats.COUNTS)].to_numpy()), rows["quality"].to_numpy(float)
    m = z.shape[1]
    want = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * len(y) / m * np.eye(m), z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)


def test_classifier_on_the_held_out_fold(spark):
    rows = q09_classifier.query(spark, SF1).join(table(spark, SF1, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
