"""Byte-level BPE against the tokenizer library, and exact round trips."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import bpe, q01_bpe
import odd

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    b = bpe.vocabulary(PATH, P.PATTERN)
    return b, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeinorsthTE .,é'\n\t\x1c\x85 　日🙂1²-=_<|>"), max_size=80))
def test_ids_like_the_library(text):
    b = bpe.vocabulary(PATH, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    ids = b.encode(text)
    assert ids == own.encode_ordinary(text) and b.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 999, "-" * 3001 + "=-" * 500, "ha" * 333 + "hah" * 77, "<|endoftext|>", " " * 999, "\n \n" * 50, "don't I'LL 've", "x" * 300_000 + " y" * 9])
def test_windows_that_grow(both, text):
    b, own = both
    assert b.encode(text) == own.encode_ordinary(text)


def test_a_join_is_the_encoding_of_both(both):
    b, _ = both
    for word in ("internationalisation", "aaaaaaaaaaaaaaaaa", "thshthstndonering", "ééééàà"):
        piece = word.encode()
        for k in range(len(piece) + 1):
            assert b.join(b.piece(piece[:k]) if k else (), b.piece(piece[k:]) if k < len(piece) else ()) == b.window(piece)


def test_every_token_is_its_own_encoding(both):
    b, _ = both
    assert all(b.window(t) == (r,) for t, r in list(b.ranks.items())[::97])


def test_query(spark, both, monkeypatch):
    b, own = both
    docs = odd.documents(spark)
    monkeypatch.setattr(q01_bpe, "table", lambda *a: docs)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q01_bpe.query(spark, "").collect())

    def want(t):
        ids = own.encode_ordinary(t)
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    assert got == sorted(want(r["text"] or "") for r in docs.collect())


def test_columns(spark):
    docs = odd.documents(spark)
    coded = bpe.encode_documents(docs, PATH, P.PATTERN)
    assert set(coded.columns) == {*docs.columns, "lossless"} and coded.filter("not lossless").count() == 0
    back = bpe.decode_documents(coded, PATH, P.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert bpe.encode_documents(odd.empty(spark), PATH, P.PATTERN).count() == 0
