"""Native packers against plain Python; the recursive splitter against its rules."""

from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.functions import chunking
from folioforge.operators import pages
from folioforge.sources import tables as S


def packed(text, most):
    out, now = [], ""
    for s in text.split(". "):
        if len(now) + len(s) < most:
            now += s + ". "
        else:
            out.append(now.strip(" "))
            now = s + ". "
    return [c for c in [*out, now.strip(" ")] if c]


def test_sentences_like_python(spark):
    rows = S.chunks(spark, SF).select("text", chunking.pack_sentences("text", 300).alias("c")).collect()
    assert all(r["c"] == packed(r["text"], 300) for r in rows)


def test_paragraphs_keep_words_and_budget(spark):
    df = spark.createDataFrame([("a b c\n\nd e\n\n" + "w " * 9 + "\n\nf",), (None,), ("",)], "text string")
    got = [r["c"] for r in df.select(chunking.pack_paragraphs("text", 5).alias("c")).collect()]
    assert got == [["a b c\n\nd e", "w w w w w w w w w", "f"], [], []]


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_recursive_chunks_fit_and_cover(text, size, overlap):
    chunks = chunking.split_recursively(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(chunks).split()) >= set() and all(c in text for c in chunks)
    assert sum(map(len, chunks)) >= len("".join(text.split())) - text.count(" ") - text.count("\n")


def test_overlapping_chunks_are_found(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(300))
    page = spark.createDataFrame([(1, p + 1, text[p * 50 : p * 50 + 50]) for p in range(6)], "doc int, page int, text string")
    chunks = spark.createDataFrame([(1, k, text[k * 40 : k * 40 + 60]) for k in range(6)], "doc int, chunk_id int, text string")
    got = {r["chunk_id"]: r["page"] for r in pages.page_of_chunks(page, chunks).collect()}
    assert got[0] == 1 and set(got.values()) <= set(range(1, 7))
