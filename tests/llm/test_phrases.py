"""Phrases against brute force over all positions."""

import re
from collections import Counter, defaultdict

import numpy as np
import odd
import pyarrow.parquet as pq
import pytest
from oracle import compare

from folioforge.llm import phrases, q13_phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(docs, top=2000, least=10, longest=3, percent=50):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * inside[lang, p] >= percent * a:
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def corpus(seed, n=250):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "winter", "garden", "é", "ünter", "A", "B.", "c,", "\t", "x\x1cy", "d\n", "e!?"]
    weights = np.arange(len(words), 0, -1) / sum(range(len(words) + 1))
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=weights)) for _ in range(n)]
    return [(["en", "fr", None][k % 3 if k % 5 else 0], t) for k, t in enumerate(texts)]


def frame(spark, docs):
    return spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string").repartition(3)


def test_query_like_duckdb(spark):
    assert compare(q13_phrases.query(spark, "/root/testdata/sf0.001"), q13_phrases.ORACLE_SQL, "/root/testdata/sf0.001") == ""


def test_query_like_brute_force(spark):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = rows(q13_phrases.query(spark, "/root/testdata/sf0.001"))
    assert got == brute(docs) and len(got) > 100


@pytest.mark.parametrize(("seed", "longest", "top"), [(1, 3, 2000), (2, 2, 2000), (3, 5, 7)])
def test_random_texts_like_brute_force(spark, seed, longest, top):
    docs = corpus(seed)
    got = rows(phrases.mined(frame(spark, docs), top=top, longest=longest))
    assert got == brute(docs, top=top, longest=longest) and got


def test_many_shards_ranges_and_parts(spark, monkeypatch):
    """The same rows from tiny shards, runs, ranges of keys and parts of a text."""
    docs = [*corpus(4), ("en", "the winter garden of the winter garden " * 300)]
    want = brute(docs)
    small = {"SHARD": 200, "RUN": 16, "RANGE": 64, "PART": 50}
    for name, value in small.items():
        monkeypatch.setattr(phrases, name, value)
    assert rows(phrases.mined(frame(spark, docs), top=2000)) == want


def test_shards_are_read_and_written_one_at_a_time(spark, monkeypatch):
    """However many shards a task makes, neither Parquet's writer nor its reader holds more than one."""
    monkeypatch.setattr(phrases, "SHARD", 200)
    kept = []
    monkeypatch.setattr(phrases, "cut", lambda df, name, *a, f=phrases.cut, **b: kept.append((name, out := f(df, name, *a, **b))) or out)
    monkeypatch.setattr(phrases, "release", lambda *tables: None)
    docs = corpus(7)
    assert rows(phrases.mined(frame(spark, docs).coalesce(1), top=2000)) == brute(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in dict(kept)["phrase-shards"].inputFiles()]
    assert sum(f.num_rows for f in files) > 10
    assert all(f.row_group(k).num_rows == 1 for f in files for k in range(f.num_row_groups))


def test_shard_and_its_row():
    docs = [(lang or "und", t) for lang, t in corpus(5)]
    every, known, runs = [(-1, phrases.MARK)], {}, []
    for lang, text in docs:
        ids = known.get(lang) or known.setdefault(lang, phrases.Ids(len(known), every))
        runs += phrases.numbers(text, ids)
    ids = np.concatenate(runs)
    packed = phrases.packed(3, list(known), every, ids)
    row, shard = packed.to_pylist()[0], phrases.Shard.of(packed, 0)
    want = phrases.Bitmaps.of(ids)
    assert (shard.maps.owner + 1 == want.owner).all() and (shard.maps.block == want.block).all() and (shard.maps.bits == want.bits).all()
    assert shard.maps.counts(len(row["words"])).tolist() == row["n"] == np.bincount(ids, minlength=len(every)).tolist()[1:]
    keys, n = shard.pairs()
    pairs = np.column_stack([ids[:-1], ids[1:]])
    pairs = pairs[(pairs > 0).all(axis=1)]
    assert n.sum() == len(pairs) and len(keys) == len(np.unique(pairs, axis=0))


def test_keys_that_coincide_change_no_count(spark, monkeypatch):
    docs = corpus(6, 120)
    monkeypatch.setattr(phrases.Shard, "keys", lambda self, a, b: (np.asarray(a) * 0 + np.asarray(b) * 0).astype(np.uint64))
    shards = list(_shards(docs))
    whole = Counter()
    for shard in shards:
        for heads, n in shard.phrases(np.zeros(1, np.uint64), 3):
            for h, k in zip(heads.tolist(), n.tolist(), strict=True):
                whole[shard.langs[shard.lang[h[0]]], " ".join(shard.words[i].as_py() for i in h)] += k
    want = {(r[0], r[2]): r[3] for r in brute(docs, least=1, percent=1 << 40)}
    assert whole == want


def _shards(docs):
    for k in range(0, len(docs), 40):
        every, known, runs = [(-1, phrases.MARK)], {}, []
        for lang, text in docs[k : k + 40]:
            ids = known.get(lang or "und") or known.setdefault(lang or "und", phrases.Ids(len(known), every))
            runs += phrases.numbers(text, ids)
        yield phrases.Shard.of(phrases.packed(k, list(known), every, np.concatenate(runs)), 0)


def test_scores_beyond_64_bits(spark):
    known = spark.createDataFrame([("en", "a b", 2, 900_000_000_000_000), ("en", "a", 1, 999_999_999_999_999), ("en", "b", 1, 900_000_000_000_001)], "lang string, phrase string, size int, n long")
    got = phrases.scored(known.filter("size > 1"), known).first()
    assert got["score"] == 10**6 * 900_000_000_000_000**2 // (999_999_999_999_999 * 900_000_000_000_001)


def test_odd_tables(spark):
    docs = odd.documents(spark, [(k, "Alpha beta gamma. Alpha, beta") for k in range(20)])
    assert rows(phrases.mined(docs, top=9)) == brute([(r["lang"], r["text"]) for r in docs.collect()], top=9)
    assert rows(phrases.mined(odd.empty(spark), top=9)) == []
