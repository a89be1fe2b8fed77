"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: words of the text (A-Z lower-cased), shingles of three words, XXH64 of each (seed 42), and the majority
of each bit. Two fingerprints link if at most `budget` bits differ.

Pigeonring principle: cut the 64 bits into m segments on a ring. If at most `budget` bits differ in all, there is a
segment from which every chain of l consecutive segments differs in at most l * budget / m bits, for each l up to m.
The first segments of such a chain have a quota below one, so they agree exactly: they are the join key. The later
chains prune what the key brings together, before the full Hamming check. With two bits and five segments the key
has 25 or more bits, so random fingerprints hardly ever meet.

Copies share a fingerprint and are one node. Most keys are met by one node only and go first. Nodes of a crowded key
are dealt anew by the longest chain whose quota is one: its bits with one of them masked. Such a key leaves twelve
or thirteen bits open, so it holds a bounded number of distinct fingerprints, however many documents there are.
Components then grow over the links (see components.py).

Null and empty texts have fingerprint zero and link like any other. Documents without an id keep a null id; a
component's id is the smallest id that isn't null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, release, whole_row, workers
from folioforge.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 64
#: Bytes of a text that are parted into words at once, and where a block may end.
BLOCK, SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Nodes of a bucket whose pairs are compared straight away; larger buckets are dealt anew by longer chains.
BUCKET = 64


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks; each begins with the last words of the one before, so no shingle is lost."""
    at, carry = 0, []
    while at < len(data):
        found = SPACE.search(data, at + BLOCK)
        end = found.start() if found else len(data)
        words = carry + data[at:end].split()
        yield words
        at, carry = end, words[-(SHINGLE - 1) :]


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text."""
    ones, n, words = np.zeros(BITS, dtype=np.int64), 0, []
    for words in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), dtype=np.uint8).reshape(-1, 8)
        n += len(hashes)
        for i in range(0, len(hashes), CHUNK):
            ones += np.unpackbits(hashes[i : i + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed 64-bit integer."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, mask) of the m segments, the widest first."""
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    out, at = [], 0
    for w in widths:
        out.append((at, ((1 << w) - 1) << at))
        at += w
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lit(bits: int) -> F.Column:
    return F.lit(_signed(bits)).cast("long")


def _union(masks: Iterable[int]) -> int:
    return reduce(or_, masks, 0)


def _keys(m: int, budget: int, length: int) -> list:
    """The join keys of chains of `length` segments: their bits, or, where the quota is one, these with one bit masked."""
    seg, out = segments(m), []
    for i in range(m):
        chain = _union(seg[(i + k) % m][1] for k in range(length))
        masked = [1 << j for j in range(BITS) if chain >> j & 1] if length * budget // m else [0]
        out += [F.struct(F.lit(i * BITS + x.bit_length()).alias("slot"), F.col("fp").bitwiseAND(_lit(chain & ~x)).alias("key")) for x in masked]
    return out


def links(nodes: DataFrame, budget: int = 2, m: int = 5) -> DataFrame:
    """Pairs (a, b), a < b as signed integers, of the distinct fingerprints in column fp that differ in 1 to budget bits.

    A pair may come from several segments, so it can repeat.
    """
    exact = max(k for k in range(1, m) if k * budget // m == 0)
    almost = max(k for k in range(1, m) if k * budget // m <= 1)
    keyed = nodes.select("fp", F.explode(F.array(*_keys(m, budget, exact))).alias("k")).select("fp", "k.slot", "k.key")
    buckets = keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = cut(keyed.join(buckets, ["slot", "key"]), "simhash-keys")
    crowded = keyed.filter(F.col("n") > BUCKET).select("fp").distinct()
    longer = crowded.select("fp", F.explode(F.array(*_keys(m, budget, almost))).alias("k")).select("fp", "k.slot", "k.key")
    return _pairs(keyed.filter(F.col("n") <= BUCKET), budget, m).union(_pairs(longer, budget, m))


def _pairs(keyed: DataFrame, budget: int, m: int) -> DataFrame:
    a, b = (keyed.select("slot", "key", F.col("fp").alias(x)) for x in "ab")
    return a.join(b, ["slot", "key"]).filter((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b"), budget, m)).select("a", "b")


def near(a: F.Column, b: F.Column, budget: int, m: int) -> F.Column:
    """Whether some segment's chains all stay within their quotas, and then the whole within the budget."""
    seg, x = segments(m), a.bitwiseXOR(b)
    rings = F.lit(False)
    for i in range(m):
        within = F.lit(True)
        for length in range(1, m):
            chain = _lit(_union(seg[(i + k) % m][1] for k in range(length)))
            within = within & (F.bit_count(x.bitwiseAND(chain)) <= length * budget // m)
        rings = rings | within
    return rings & (F.bit_count(x) <= budget)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2) -> DataFrame:
    """Per document (key, fp, root, component_id): its fingerprint and its component's smallest key."""
    fps = cut(fingerprints(docs, key, text), "simhash-fps")
    nodes = cut(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    roots = components(cut(links(nodes, budget), "simhash-links"))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    groups = named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    found = fps.join(groups, "fp", "left")
    alone = F.col("root").isNull()
    return found.select(key, "fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2) -> DataFrame:
    """The documents without near-copies: of each component, the row with the smallest key stays, null ones last.

    Of several rows with that key the one stays whose text has the least hash; of rows with equal key and text any one,
    so one row of each component stays, whatever its key. The rows are written once with a number beside them, and
    shuffled once, by that number.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("at"), whole_row(docs)), "simhash-rows")
    body, order = F.col("row")[text], F.struct(F.col("row")[key].isNull().alias("nameless"), F.col("row")[key].alias("key"), F.xxhash64(F.col("row")[text]).alias("hash"), "at")
    fps = cut(fingerprints(rows.select(order.alias("order"), body.alias("body")), "order", "body"), "simhash-fps")
    nodes = cut(fps.groupBy("fp").agg(F.min("order").alias("least")), "simhash-nodes")
    linked = cut(links(nodes, budget), "simhash-links")
    roots = components(linked)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = cut(named.groupBy("root").agg(F.min("least").alias("least")).select("least.at"), "simhash-first")
    release(fps, nodes, linked)
    return rows.join(first.hint("shuffle_hash"), "at", "left_semi").select("row.*")
