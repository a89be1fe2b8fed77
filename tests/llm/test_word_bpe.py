"""BPE with word ends against the tokenizer library."""

import hashlib

import numpy as np
import odd
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioforge.llm import q11_word_bpe, word_bpe

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(text):
    own = word_bpe.vocabulary(PATH)
    ids = own.encode(text)
    assert ids == library(text)
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aeinorsthTE .,é'sΣςİßÅ̧̊́e\n\t\x1c\x85\xa0 日ยำ한가🙂1²½-=_<|>\x00Ᲊ꟎\U00016ea0"), max_size=80))
def test_ids_like_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(text):
    check(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a" * 5000, "ab" * 999, "-" * 3001 + "=-" * 500, "ha" * 333 + "hah" * 77, " <|endoftext|>x<|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "don't I'LL 've '''s", "x" * 100_000 + " y" * 9, "word " * 90_000, "1234567 3.14 ⅷ", "Σίσυφος ΟΔΟΣ"],
)
def test_odd_texts(text):
    check(text)


def test_every_code_point_like_the_library():
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x1F000), *range(0x1F000, 0x110000, 61)]]
    for k in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c}Z " for c in points[k : k + 4096])
        check(text)


def greedy(own, symbols):
    """Longest match by definition."""
    out, at = [], 0
    while at < len(symbols):
        stops = range(len(symbols), at, -1)
        token, at = next((own.proposable[t], stop) for stop in stops if (t := symbols[at:stop] + (own.end if stop == len(symbols) else "")) in own.proposable)
        out.append(token)
    return tuple(out)


def test_exact_merging_of_failing_words_only():
    """Words that greedy matching gets wrong are found by the pair check, and no others are merged."""
    own = word_bpe.vocabulary(PATH)
    rng = np.random.default_rng(7)
    words = sorted({"".join(rng.choice(list("aeinorsthl"), n)) for n in rng.integers(1, 20, 5000)})
    symbols = [own.symbols(w) for w in words]
    flat, starts = own.propose(symbols)
    assert [tuple(flat[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)] == [greedy(own, s) for s in symbols]
    wrong = [greedy(own, s) != own.merge(s) for s in symbols]
    assert own.merge_all(symbols) == [own.merge(s) for s in symbols]
    coded, merged = own.encode_words(words)
    assert coded == [own.merge(s) for s in symbols] and 0 < merged == sum(wrong) < len(words)


def test_pairs_are_compatible_just_if_encoding_gives_them_back():
    own = word_bpe.vocabulary(PATH)
    rng = np.random.default_rng(3)
    inner = [i for t, i in own.proposable.items() if not t.endswith("</w>")]
    ends = [i for t, i in own.proposable.items() if t.endswith("</w>")]
    a, b = rng.choice(inner, 4000), rng.choice(ends, 4000)
    want = [own.merge(own.text[x] + own.text[y][: -len(own.end)]) == (x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert own.compatible(a, b).tolist() == want and 0 < sum(want) < 4000


def test_tokens_that_are_their_own_encoding_are_proposed():
    own = word_bpe.vocabulary(PATH)
    ends = {t: i for t, i in own.vocab.items() if t.endswith("</w>")}
    for t, i in list(ends.items())[::23]:
        assert (t in own.proposable) == (own.merge(t[: -len(own.end)]) == (i,))


def test_query(spark, monkeypatch):
    docs = odd.documents(spark, [(8, "Ça <|endoftext|> va"), (9, "An ordinary, mended text: don't " * 40)])
    monkeypatch.setattr(q11_word_bpe, "table", lambda *a: docs)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q11_word_bpe.query(spark, "").collect())

    def want(t):
        ids = library(t)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted((r["doc_id"] or -1, *want(r["text"] or "")) for r in docs.collect())


def test_whole_table_like_the_library(spark):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in q11_word_bpe.query(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_columns(spark):
    docs = odd.documents(spark)
    coded = word_bpe.encode_documents(docs, PATH)
    assert set(coded.columns) == {*docs.columns}
    assert all(r["ids"] == library(r["text"] or "") for r in coded.collect())
    back = word_bpe.decode_documents(coded, PATH)
    assert sorted(r["text"] for r in back.collect()) == sorted(LIBRARY.decode(library(r["text"] or ""), skip_special_tokens=False) for r in docs.collect())
    assert word_bpe.encode_documents(odd.empty(spark), PATH).count() == 0
