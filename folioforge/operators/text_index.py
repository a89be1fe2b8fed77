"""A kept index of texts that is read in part (Q4, F14, T4, Q2; F6, Q1, Q12).

Postings are rows of blocks: a term, a range of documents, how many of them have it, the highest score it gives one of
them, and the documents with their counts and positions. Documents are dealt to ranges by a hash of their id, so a
block is bounded however frequent the term is. Rows are sorted by term and dealt to folders by its hash; a query reads
the folders of its terms, and of those the row groups with the terms. What it needs of the corpus (how many texts, how
long on average) is one row, kept beside.

Text ranking is BM25, as `search.bm25`, over stems and without stop words (`english`) or plain words (`simple`); a text
has to have all terms, and for a phrase has to have them next to each other. The best k are found by block pruning: the
ranges whose highest scores add up to most give a first k-th best score, and only ranges that can reach it are read.

Substring search goes by the same kind of blocks over trigrams of the lower-case text: a text with the query has all of
the query's trigrams, so their documents are intersected, and what is left is checked literally. Queries of less than
three characters have no trigram; they scan the texts.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import stemming
from folioforge.functions import text as T
from folioforge.operators.search import K1, B
from folioforge.sources.package import importable

#: Documents of a range, folders that terms are dealt to, and parts of a folder.
RANGE, BUCKETS, PARTS = 4096, 32, 4
#: Ranges that are read first, and how many are named one by one in a filter rather than joined.
FIRST, NAMED = 4, 1000
#: The most tasks that ranges are dealt to.
TASKS = 4096
#: Places that a task holds in Python before it passes them on; trigrams of texts; characters that are looked at at once.
HELD, GRAMS, PIECE = 1 << 20, 1 << 22, 1 << 20


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write(blocks: DataFrame, folder: str, *merged: Column) -> None:
    """Blocks (term, range, ...) by folders of terms, sorted; a frequent term's blocks go to several files. What a block
    comes in is put together by `merged`."""
    dealt = blocks.withColumn("bucket", _bucket(F.col("term"))).withColumn("part", F.pmod("range", F.lit(PARTS))).repartition("bucket", "part")
    whole = dealt.groupBy("bucket", "part", "term", "range").agg(*merged).drop("part")
    whole.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(folder)


def _by_range(rows: DataFrame, ranges: int, key: str = "id") -> DataFrame:
    """rows with their `range`, and a range's rows in one task: its blocks are made there, and nothing but blocks moves on."""
    return rows.withColumn("range", F.pmod(F.xxhash64(F.col(key)), F.lit(ranges)).cast("int")).repartition(min(ranges, TASKS), "range")


def _of_terms(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """The blocks of some terms; Spark reads their folders only."""
    buckets = [_bucket(F.lit(t)) for t in terms]
    return blocks.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)) if terms else blocks.filter(F.lit(False))


class TextIndex:
    """Positional postings of texts in a folder: `postings`, `stats`."""

    POSTINGS = "term string, range int, n int, top double, docs array<struct<id: {id}, tf: int, length: int, at: array<int>>>, bucket int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.stats = spark.read.schema("docs long, mean double, analyzer string, id string").parquet(f"{folder}/stats").first()
        self.analyzer = self.stats["analyzer"]
        self.postings = spark.read.schema(self.POSTINGS.format(id=self.stats["id"])).parquet(f"{folder}/postings")

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, analyzer: str = "english") -> TextIndex:
        """Indexes chunks(id, text) in a folder. Null texts have no terms, but count as texts."""
        spark, kind = chunks.sparkSession, chunks.schema["id"].dataType.simpleString()
        found = lengths(chunks).agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
        docs, mean = found["docs"], found["mean"] or 0.0
        ranges = max(1, -(-docs // RANGE))
        dealt = _by_range(chunks.select("id", "text"), ranges).sortWithinPartitions("range").select("id", "text", "range")
        entry = f"struct<id: {kind}, tf: int, length: int, at: array<int>>"
        blocks = dealt.mapInArrow(partial(partial_blocks, analyzer=analyzer, mean=mean), f"term string, range int, n int, top double, docs array<{entry}>")
        _write(blocks, f"{folder}/postings", F.sum("n").cast("int").alias("n"), F.max("top").alias("top"), F.flatten(F.collect_list("docs")).alias("docs"))
        spark.createDataFrame([(docs, mean, analyzer, kind)], "docs long, mean double, analyzer string, id string").coalesce(1).write.parquet(f"{folder}/stats")
        return cls(spark, folder)

    def terms(self, q: str) -> list[str]:
        """The distinct terms of a query, in the order of their first places."""
        return list(dict.fromkeys(t for t, _ in stemming.terms(q, self.analyzer)[0]))

    def ranked(self, q: str, phrase: bool = False) -> DataFrame:
        """(id, rank) of all texts with every term of q, or with q as a phrase. No terms, no rows."""
        terms = self.terms(q)
        return self._scored(_of_terms(self.postings, terms), terms, self._idf(terms), q if phrase else None)

    def best(self, q: str, k: int, phrase: bool = False) -> DataFrame:
        """The first k rows of `ranked` by rank and id. Two small jobs find the ranges that can have one of them."""
        terms = self.terms(q)
        idf, asked = self._idf(terms), _of_terms(self.postings, terms)
        order = F.desc("rank"), F.col("id")
        if not idf:
            return self._scored(asked, terms, idf, None).limit(0)
        weight = F.create_map(*(x for t in terms for x in (F.lit(t), F.lit(idf[t]))))[F.col("term")]
        bounds = asked.groupBy("range").agg(F.count("*").alias("m"), F.sum(weight * F.col("top")).alias("bound")).filter(F.col("m") == len(terms))
        some = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(FIRST).collect()]
        first = self._scored(asked.filter(F.col("range").isin(some)), terms, idf, q if phrase else None).orderBy(*order).limit(k).agg(F.min("rank").alias("least"), F.count("*").alias("n")).first()
        if first["n"] < k:
            return self._scored(asked, terms, idf, q if phrase else None).orderBy(*order).limit(k)
        able = bounds.filter(F.col("bound") >= first["least"] - 1e-9).select("range")
        named = [r["range"] for r in able.limit(NAMED + 1).collect()]
        asked = asked.filter(F.col("range").isin(named)) if len(named) <= NAMED else asked.join(able, "range", "left_semi")
        return self._scored(asked, terms, idf, q if phrase else None).orderBy(*order).limit(k)

    def _idf(self, terms: list[str]) -> dict[str, float]:
        """The weight of each term, from the sizes of its blocks; empty if one of them is nowhere."""
        found = _of_terms(self.postings, terms).groupBy("term").agg(F.sum("n").alias("df"))
        rows = found.select("term", F.log(1 + (F.lit(self.stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).collect()  # a row a term
        return {r["term"]: r["idf"] for r in rows} if len(rows) == len(terms) else {}

    def _scored(self, asked: DataFrame, terms: list[str], idf: dict[str, float], phrase: str | None) -> DataFrame:
        """(id, rank) of the documents in some blocks that have all terms, and the phrase if one is given."""
        if not idf:
            return asked.select(F.explode("docs").alias("d")).select("d.id", F.lit(0.0).alias("rank")).limit(0)
        each = asked.select("term", F.explode("docs").alias("d")).select("term", "d.*")
        of = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
        found = each.groupBy("id").agg(F.count("*").alias("m"), F.max("length").alias("length"), *(of(t, "tf").alias(f"tf{i}") for i, t in enumerate(terms)), *(of(t, "at").alias(f"at{i}") for i, t in enumerate(terms) if phrase))
        found = found.filter(F.col("m") == len(terms))
        if phrase:
            places = [(terms.index(t), at) for t, at in stemming.terms(phrase, self.analyzer)[0]]
            starts = [F.transform(F.col(f"at{i}"), partial(_less, at)) for i, at in places]
            found = found.filter(F.size(reduce(F.array_intersect, starts)) > 0)
        rank = F.lit(0.0)
        for i in sorted(range(len(terms)), key=terms.__getitem__):
            tf = F.col(f"tf{i}").cast("double")
            rank = rank + F.lit(idf[terms[i]]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(self.stats["mean"])))
        return found.select("id", rank.alias("rank"))


def _less(by: int, x: Column) -> Column:
    return x - by


def lengths(chunks: DataFrame) -> DataFrame:
    """(length) of each text: its number of words."""
    importable(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([stemming.length(t.as_py()) for t in batch.column(0)], pa.int32())], ["length"])

    return chunks.select("text").mapInArrow(run, "length int")


def partial_blocks(batches: Iterator[pa.RecordBatch], analyzer: str, mean: float) -> Iterator[pa.RecordBatch]:
    """(term, range, n, top, docs) of batches of (id, text, range), in the order of ranges: a range's blocks, or HELD
    places of it at a time."""
    held, now = _Held(), None
    for batch in batches:
        for key, text, number in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if held.at and (number != now or len(held.at) >= HELD):
                yield held.blocks(batch.schema.field(0).type, now, mean)
                held = _Held()
            now = number
            held.add(key.as_py(), *stemming.terms(text.as_py(), analyzer))
    if held.at:
        yield held.blocks(batch.schema.field(0).type, now, mean)


class _Held:
    """The terms of some texts: for each entry its term, its text and how many places it has; and the places."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.ids, self.lengths = [], array("i")
        self.code, self.text, self.tf, self.at = (array("i") for _ in range(4))

    def add(self, key, found: list[tuple[str, int]], length: int) -> None:
        places = defaultdict(list)
        for term, place in found:
            places[term].append(place)
        for term, some in places.items():
            self.code.append(self.codes.setdefault(term, len(self.codes)))
            self.text.append(len(self.ids))
            self.tf.append(len(some))
            self.at.extend(some)
        self.ids.append(key)
        self.lengths.append(length)

    def blocks(self, kind: pa.DataType, number: int, mean: float) -> pa.RecordBatch:
        code, text, tf, at, lengths = (np.array(x, np.int32) for x in (self.code, self.text, self.tf, self.at, self.lengths))
        places = pa.ListArray.from_arrays(_offsets(tf), pa.array(at))
        order = np.argsort(code, kind="stable")
        text, tf = text[order], tf[order]
        n = np.bincount(code, minlength=len(self.codes))
        score = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[text] / mean))
        entries = pa.StructArray.from_arrays([pa.array(self.ids, kind).take(pa.array(text)), pa.array(tf), pa.array(lengths[text]), places.take(pa.array(order))], ["id", "tf", "length", "at"])
        starts = _offsets(n)
        top = np.maximum.reduceat(score, np.asarray(starts)[:-1])
        columns = [pa.array(list(self.codes), pa.string()), pa.array(np.full(len(n), number, np.int32)), pa.array(n.astype(np.int32)), pa.array(top), pa.ListArray.from_arrays(starts, entries)]
        return pa.RecordBatch.from_arrays(columns, ["term", "range", "n", "top", "docs"])


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


def grams(text: str) -> np.ndarray:
    """The distinct runs of three characters of a text as numbers, 21 bits a character."""
    found = [np.zeros(0, np.int64)]
    for start in range(0, len(text) - 2, PIECE):
        c = np.frombuffer(text[start : start + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    return found[-1] if len(found) < 3 else np.unique(np.concatenate(found))


def partial_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, range, ids) of batches of (id, text in lower case, range), in the order of ranges: a range's blocks, or
    GRAMS trigrams of texts of it at a time."""
    ids, found, size, now, kind = [], [], 0, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, text, number in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if found and (number != now or size >= GRAMS):
                yield _gram_blocks(ids, found, now, kind)
                ids, found, size = [], [], 0
            now = number
            some = grams(text.as_py() or "")
            if len(some):
                ids.append(key.as_py())
                found.append(some)
                size += len(some)
    if found:
        yield _gram_blocks(ids, found, now, kind)


def _gram_blocks(ids: list, found: list[np.ndarray], number: int, kind: pa.DataType) -> pa.RecordBatch:
    which = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in found])
    every = np.concatenate(found)
    order = np.argsort(every, kind="stable")
    terms, n = np.unique(every, return_counts=True)
    chars = np.stack([terms >> 42, terms >> 21 & 0x1FFFFF, terms & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(_offsets(n), pa.array(ids, kind).take(pa.array(which[order])))
    return pa.RecordBatch.from_arrays([pa.array([chars[k : k + 3] for k in range(0, len(chars), 3)], pa.string()), pa.array(np.full(len(n), number, np.int32)), lists], ["term", "range", "ids"])


class TrigramIndex:
    """Which texts have which trigrams, in a folder; the texts themselves stay where they are."""

    BLOCKS = "term string, range int, ids array<{id}>, bucket int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.id = spark.read.schema("id string").parquet(f"{folder}/stats").first()["id"]
        self.blocks = spark.read.schema(self.BLOCKS.format(id=self.id)).parquet(f"{folder}/blocks")

    @classmethod
    def build(cls, rows: DataFrame, folder: str, text: str = "text", key: str = "id") -> TrigramIndex:
        """Indexes the column `text` of rows in a folder."""
        spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
        ranges = max(1, -(-rows.count() // RANGE))
        dealt = _by_range(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), ranges)
        blocks = dealt.sortWithinPartitions("range").select("id", F.lower("text").alias("text"), "range").mapInArrow(partial_grams, f"term string, range int, ids array<{kind}>")
        part = F.pmod("range", F.lit(max(PARTS, ranges // 64)))
        dealt = blocks.withColumn("bucket", _bucket(F.col("term"))).repartition(min(ranges, TASKS), "bucket", part)
        dealt.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{folder}/blocks")
        spark.createDataFrame([(kind,)], "id string").coalesce(1).write.parquet(f"{folder}/stats")
        return cls(spark, folder)

    def candidates(self, q: str) -> DataFrame | None:
        """(id) of the texts that have every trigram of q; None if q has none."""
        body = q.lower()
        grams = sorted({body[k : k + 3] for k in range(len(body) - 2)})
        if not grams:
            return None
        whole = _of_terms(self.blocks, grams).groupBy("range", "term").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        met = whole.groupBy("range").agg(F.collect_list("ids").alias("ids")).filter(F.size("ids") == len(grams))
        both = F.aggregate(F.slice("ids", 2, len(grams)), F.col("ids")[0], F.array_intersect) if len(grams) > 1 else F.col("ids")[0]
        return met.select(F.explode(both).alias("id"))

    def containing(self, rows: DataFrame, q: str, text: str = "text", key: str = "id") -> DataFrame:
        """The rows whose text has q, whatever its case: of the candidates, or of all rows where q is shorter than three."""
        some = self.candidates(q)
        asked = rows if some is None else rows.join(some.withColumnRenamed("id", key), key, "left_semi")
        return asked.filter(T.contains_ci(text, q))
