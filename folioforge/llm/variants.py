"""Spelling variants by wildcard groups, without pairs.

Two words of equal length differ in one code point exactly if they share the group (position, prefix, suffix) of that
position. A group keeps its size and its two most frequent words; so each member knows how many others there are and
which of them is the most frequent, and no pair is made. A group has one word for each letter at most, whatever the
corpus. One code point more or less: the deletions of all words join the vocabulary. A word counts its deletions
that are words, and a word that is a deletion of others gets their number and the most frequent one of them, summed up
before the join. What the groups say about a word is added up in the end.

A word's form is its most frequent near word (ties: the smallest in code-point order) if that is `times` as frequent as
the word or more. So frequencies rise along forms at least by that factor, which bounds the way to the last one, the
root; it is found by doubling.

Counting: words of a text are counted in the workers, by blocks of bounded size, and summed up by a shuffle of words
with their counts; so a word that is everywhere is one row a block. Null text has no words; a null id is the empty text
in the seed of the noise. Repeated rows count each. Empty tables have no words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import cut, workers

#: Letters of words, as a class of code points.
LETTERS = "A-Za-zÀ-ÿ"
#: Stands for the letter that is left open; it is no letter.
OPEN = "*"
#: Distinct words that a worker counts before it hands the counts on.
HELD = 300_000
#: Characters of a text whose words are listed at once.
PART = 1 << 20


def noisy(word: str, seed: int, every: int) -> str:
    """The word, or where its checksum (from `seed` on) is a multiple of `every`, the word without one letter."""
    h = zlib.crc32(word.encode(), seed)
    if every and h % every == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, every: int = 0) -> DataFrame:
    """(word, n): how often each word of `shortest` letters or more occurs; only A-Z are lower-cased.

    `every` takes a letter out of about one in so many distinct words of a document, by a checksum of its key and the
    word: seeded noise, for measuring. 0: none.
    """
    workers(docs.sparkSession)
    find = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = (body.as_py() or "").encode().lower().decode()
                found = Counter(find.findall(body) if len(body) < PART else (m[0] for m in find.finditer(body)))
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in found.items():
                    word = noisy(word, seed, every)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > HELD:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    parts = docs.select(key, text).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _without(word: Column, at: Column, instead: str = "") -> Column:
    """A word without the letter at a place (from 1)."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.lit(instead), F.substring(word, at + 1, F.length(word)))


def _places(word: Column) -> Column:
    return F.sequence(F.lit(1), F.length(word))


def _order() -> Column:
    """Orders words by frequency, ties by code points: the least comes first."""
    return F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the words that differ from `word` in one letter, their number and the first in order."""
    groups = words.select("word", "n", F.explode(F.transform(_places(F.col("word")), lambda at: _without(F.col("word"), at, OPEN))).alias("group"))
    group = Window.partitionBy("group")
    whole = group.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = groups.withColumn("order", _order()).select(
        "word",
        (F.count("*").over(whole) - 1).alias("n_near"),
        F.first("order").over(whole).alias("top"),
        F.nth_value("order", 2).over(whole).alias("second"),
    )
    return kept.filter("n_near > 0").select("word", "n_near", F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top")).alias("best"))


def resized(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words with one letter less, and of those with one more, than `word`."""
    word = F.col("word")
    gone = words.select("word", "n", F.explode(F.array_distinct(F.transform(_places(word), lambda at: _without(word, at)))).alias("rest"))
    shorter = words.select(word.alias("rest"), _order().alias("order"))
    less = gone.join(shorter, "rest").groupBy("word").agg(F.count("*").alias("n_near"), F.min("order").alias("best"))
    more = gone.groupBy("rest").agg(F.count("*").alias("n_near"), F.min(_order()).alias("best"))
    more = more.join(words.select(word.alias("rest")), "rest").select(F.col("rest").alias("word"), "n_near", "best")
    return less.union(more)


def forms(words: DataFrame, times: int = 5) -> DataFrame:
    """words(word, n) with form, form_n and n_near of each; words are distinct, and null or empty ones have no near ones."""
    near = replaced(words).union(resized(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    found = words.join(near, "word", "left")
    better = -F.col("best.less") >= times * F.col("n")
    return found.select(
        "word",
        "n",
        F.when(better, F.col("best.word")).alias("form"),
        F.when(better, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def rooted(found: DataFrame, times: int = 5) -> DataFrame:
    """The rows of `forms` with `root`: the last word on the way along forms, the word itself if it has none.

    A way of k steps takes frequencies of times^k at least, so its length is bounded by the largest one, and the
    number of joins by that length's logarithm.
    """
    most = found.agg(F.max("n")).first()[0] or 0  # one number
    steps = max(1, math.ceil(math.log(max(most, 2), max(times, 2))))
    up = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        up = cut(up.alias("a").join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, times: int = 5, every: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `shortest` letters that occurs `least` times or more."""
    words = cut(counts(docs, key, text, shortest, every).filter(F.col("n") >= least), "variant-words")
    found = cut(forms(words, times), "variant-forms")
    return rooted(found, times).select("word", "form", "root", "n", "n_near", "form_n")
