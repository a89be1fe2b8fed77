"""Phrases (collocations) by position bitmaps, in the manner of SPAM.

Texts are dealt into *shards* of a bounded number of positions. A shard keeps for each word the bitmap of its positions,
compressed: only blocks of eight positions that hold the word, with their bits. The position after a piece (what
stands between marks or line ends) and after a text belongs to no word. So a phrase's bitmap, shifted by one and
ANDed with a word's, is that of the longer phrase, never reaches over a piece, and its popcount is the number of
occurrences. Phrases grow depth-first, a bounded run of first words at a time, so only its bitmaps are held.

Counts are sums of popcounts over shards. To spare what can't be frequent, shards first sum up two-word phrases by a
64-bit key: a phrase whose key stays below `least` everywhere is rare, as are all longer ones around it, and each shard
gets back those of its keys that don't. It then counts phrases whose every two neighbours have such a key, by their
words; so keys that coincide cost work, but change no count. Counts of a shard travel packed by ranges of keys, a range
being as many as one task can hold. The most a key can have there is an entry for each shard.

Null text is empty; null languages are `und`; repeated rows count each; empty tables have no phrases. Columns besides
language and text don't matter. A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import cut, release, workers

#: Positions of a shard.
SHARD = 1 << 21
#: Blocks of bits that grow together: first words whose bitmaps have so many are extended at once.
RUN = 1 << 17
#: Keys that a task sums up at once.
RANGE = 1 << 21
#: Bytes of a text that are parted into words at once.
PART = 1 << 20
#: Parts of a language whose best phrases are found before those of all.
SALTS = 64
MARKS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"  # no byte of UTF-8 is 255
_TABLE = bytes.maketrans(MARKS + b"\t", MARK * len(MARKS) + b" ")
INDEX = "shard long, langs array<string>, lang array<int>, words array<string>, n array<int>, blocks array<int>, places binary, bits binary"


class Ids(dict):
    """Numbers of the words of one language; `every` lists the words of all languages by number."""

    def __init__(self, lang: int, every: list[tuple[int, bytes]]):
        super().__init__({MARK: 0})
        self.lang, self.every = lang, every

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.every)
        self.every.append((self.lang, word))
        return number


class Bitmaps(NamedTuple):
    """Blocks of eight positions with their bits, of words or phrases: sorted by owner, where built from positions."""

    owner: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Bitmaps:
        """The bitmap of each number in a sequence of them; 0 has none."""
        place = np.argsort(ids, kind="stable").astype(np.int32)
        place = place[np.count_nonzero(ids == 0) :]
        owner, block = ids[place], place >> 3
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(new)
        bits = np.left_shift(1, place & 7).astype(np.uint8)
        return cls(owner[starts], block[starts], np.bitwise_or.reduceat(bits, starts) if len(starts) else bits)

    def take(self, at: np.ndarray | slice) -> Bitmaps:
        return Bitmaps(*(x[at] for x in self))

    def shifted(self) -> Bitmaps:
        """All positions moved on by one."""
        wide = self.bits.astype(np.uint16) << 1
        low, over = (wide & 255).astype(np.uint8), np.flatnonzero(wide > 255)
        stay = np.flatnonzero(low)
        return Bitmaps(
            np.concatenate([self.owner[stay], self.owner[over]]),
            np.concatenate([self.block[stay], self.block[over] + 1]),
            np.concatenate([low[stay], np.ones(len(over), np.uint8)]),
        )

    def counts(self, n: int) -> np.ndarray:
        """The popcount of each of n owners."""
        return np.bincount(self.owner, np.bitwise_count(self.bits), n).astype(np.int64)


class Shard:
    """Words of a run of texts, with their bitmaps."""

    def __init__(self, langs: list[str], lang: np.ndarray, words: pa.Array, bitmaps: Bitmaps):
        self.langs, self.lang, self.words, self.maps = langs, lang, words, bitmaps
        self.hash = np.empty(len(words), np.uint64)
        for k in range(0, len(words), 1 << 14):
            some = zip(lang[k : k + (1 << 14)].tolist(), words[k : k + (1 << 14)].to_pylist(), strict=True)
            self.hash[k : k + (1 << 14)] = [xxhash.xxh64_intdigest(f"{langs[at]}\0{word}") for at, word in some]
        order = np.argsort(bitmaps.block, kind="stable")
        self.by_block = bitmaps.take(order)
        blocks = int(bitmaps.block.max()) + 1 if len(order) else 0
        self.starts = np.searchsorted(self.by_block.block, np.arange(blocks + 2))

    def runs(self) -> Iterator[Bitmaps]:
        """The words' bitmaps, whole words at a time."""
        owner, at = self.maps.owner, 0
        while at < len(owner):
            stop = int(np.searchsorted(owner, owner[min(at + RUN, len(owner)) - 1], side="right"))
            yield self.maps.take(slice(at, stop))
            at = stop

    def meet(self, shifted: Bitmaps) -> tuple[Bitmaps, np.ndarray]:
        """Each bitmap ANDed with those of all words that share a block with it: (what is left, the word of each)."""
        block = np.minimum(shifted.block, len(self.starts) - 2)
        first = self.starts[block]
        n = self.starts[block + 1] - first
        left = np.repeat(np.arange(len(block)), n)
        right = np.arange(len(left)) + np.repeat(first - np.cumsum(n) + n, n)
        bits = shifted.bits[left] & self.by_block.bits[right]
        kept = np.flatnonzero(bits)
        left = left[kept]
        return Bitmaps(shifted.owner[left], shifted.block[left], bits[kept]), self.by_block.owner[right[kept]]

    def extend(self, maps: Bitmaps) -> tuple[Bitmaps, np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that are one word longer: their bitmaps (owned by places in the rest), what each extends, the word, the count."""
        maps, word = self.meet(maps.shifted())
        key = maps.owner.astype(np.int64) * len(self.words) + word
        kinds, owner = np.unique(key, return_inverse=True)
        maps = Bitmaps(owner.astype(np.int32), maps.block, maps.bits)
        return maps, kinds // max(1, len(self.words)), kinds % max(1, len(self.words)), maps.counts(len(kinds))

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The 64-bit keys of two-word phrases."""
        x = self.hash[a] * np.uint64(0x9E3779B97F4A7C15) + self.hash[b]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all two-word phrases, sorted, and their counts."""
        found = [(self.keys(a, b), n) for _, a, b, n in map(self.extend, self.runs())]
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)])
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        order = np.argsort(keys)
        return keys[order], counts[order]

    def phrases(self, frequent: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, counts) of the phrases of 2 to `longest` words whose neighbours all have a key in `frequent` (sorted)."""
        for maps in self.runs() if len(frequent) else ():
            heads = np.arange(len(self.words))[:, None]  # the words of each phrase that is being extended
            for _ in range(longest - 1):
                maps, before, word, n = self.extend(maps)
                key = self.keys(heads[before, -1], word)
                at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
                kept = frequent[at] == key
                heads = np.column_stack([heads[before[kept]], word[kept]])
                if not len(heads):
                    break
                yield heads, n[kept]
                renamed = np.cumsum(kept, dtype=np.int32) - 1
                maps = maps.take(kept[maps.owner])
                maps = Bitmaps(renamed[maps.owner], maps.block, maps.bits)

    # -- as a row of the index ----------------------------------------------------------------------------------

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch, k: int) -> Shard:
        """The k-th row of an index."""
        of = {name: rows[name][k] for name in ("langs", "lang", "words", "blocks", "places", "bits")}
        blocks = np.asarray(of["blocks"].values, np.int64)
        owner = np.repeat(np.arange(len(blocks), dtype=np.int32), blocks)
        steps = np.frombuffer(of["places"].as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.int32)[:, 0]
        ends = np.cumsum(blocks)
        block = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate([[0], block])[ends - blocks]  # each word's blocks are counted from 0
        block = (block - np.repeat(before, blocks)).astype(np.int32)
        return cls(of["langs"].as_py(), np.asarray(of["lang"].values), of["words"].values, Bitmaps(owner, block, np.frombuffer(of["bits"].as_buffer(), np.uint8)))


def packed(shard: int, langs: list[str], every: list[tuple[int, bytes]], ids: np.ndarray) -> pa.RecordBatch:
    """A row of the index: the words of a shard, their bitmaps as steps from block to block (low bytes first) and bits."""
    maps = Bitmaps.of(ids)
    steps = maps.block.copy()
    same = np.flatnonzero(maps.owner[1:] == maps.owner[:-1]) + 1
    steps[same] -= maps.block[same - 1]
    n, blocks = maps.counts(len(every))[1:], np.bincount(maps.owner, minlength=len(every))[1:]
    lists = [
        pa.array([langs], pa.list_(pa.string())),
        _one(pa.array([k for k, _ in every[1:]], pa.int32())),
        _one(pa.array([w for _, w in every[1:]], pa.binary()).cast(pa.string())),
        _one(pa.array(n.astype(np.int32))),
        _one(pa.array(blocks.astype(np.int32))),
    ]
    binary = [pa.array([steps.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()), pa.array([maps.bits.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *lists, *binary], ["shard", "langs", "lang", "words", "n", "blocks", "places", "bits"])


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def numbers(text: str | None, ids: Ids) -> Iterator[np.ndarray]:
    """The numbers of a text's words, with 0 for each mark and at the end; long texts come part by part."""
    data = (text or "").encode().lower().translate(_TABLE)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + PART)
        stop = stop if stop >= 0 else len(data)
        words = data[at:stop].replace(MARK, b" \xff ").split()
        yield np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        at = stop
    yield np.zeros(1, np.int32)


def index(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """A row for each shard (see INDEX): its words, how often each occurs, and their bitmaps."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[str, Ids] = {}
        every: list[tuple[int, bytes]] = [(-1, MARK)]
        runs: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.get(name) or known.setdefault(name, Ids(len(known), every))
                runs += (new := list(numbers(body.as_py(), ids)))
                size += sum(map(len, new))
                if size >= SHARD:
                    yield packed(number, list(known), every, np.concatenate(runs))
                    known, every, runs, size, number = {}, [(-1, MARK)], [], 0, number + 1
        if len(every) > 1:
            yield packed(number, list(known), every, np.concatenate(runs))

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, INDEX)


def _pair_counts(shards: DataFrame, bits: int) -> DataFrame:
    """(range, shard, keys, counts): the two-word phrases of each shard, by 2^bits ranges of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts = Shard.of(batch, k).pairs()
                ranges, starts = np.unique(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), return_index=True)
                stops = [*starts[1:].tolist(), len(keys)]
                parts = [(keys[a:b].tobytes(), counts[a:b].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()) for a, b in zip(starts.tolist(), stops, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges.astype(np.int64)), pa.array([batch["shard"][k].as_py()] * len(parts), pa.int64()), pa.array([p for p, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())],
                    ["range", "shard", "keys", "counts"],
                )

    return shards.mapInArrow(run, "range long, shard long, keys binary, counts binary")


def _frequent(pairs: DataFrame, least: int) -> DataFrame:
    """(shard, keys): of each shard's keys, packed, those with a count of `least` or more over all shards."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in group["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for x in group["counts"].to_pylist()])
        kinds, where = np.unique(np.concatenate(parts), return_inverse=True)
        enough = (np.bincount(where, counts, len(kinds)) >= least)[where]
        stops = np.cumsum([len(p) for p in parts])
        kept = [p[e] for p, e in zip(parts, np.split(enough, stops[:-1]), strict=True)]
        return pa.table({"shard": group["shard"], "keys": pa.array([k.tobytes() for k in kept], pa.binary())})

    return pairs.groupBy("range").applyInArrow(run, "shard long, keys binary")


def _shard_phrases(shards: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, n) of each shard's phrases whose neighbours all have a frequent key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(b"".join(right["keys"].to_pylist()), np.uint64))
        tables = []
        for k in range(left.num_rows):
            shard = Shard.of(left, k)
            words, langs = shard.words, pa.array(shard.langs, pa.string())
            for heads, n in shard.phrases(keys, longest):
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(h)) for h in heads.T), " ")
                lang = langs.take(pa.array(shard.lang[heads[:, 0]]))
                tables.append(pa.table({"lang": lang, "phrase": phrase, "size": pa.array(np.full(len(heads), heads.shape[1], np.int32)), "n": pa.array(n)}))
        return pa.concat_tables(tables) if tables else pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})

    return shards.groupBy("shard").cogroup(frequent.groupBy("shard")).applyInArrow(run, "lang string, phrase string, size int, n long")


def counts(docs: DataFrame, least: int = 10, longest: int = 3, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to `longest` words that occur `least` times or more, and (lang, n) of all words."""
    shards = cut(index(docs, lang, text), "phrase-shards", rows=1)
    words = shards.select("langs", F.explode(F.arrays_zip("lang", "words", "n")).alias("w")).select(F.col("langs")[F.col("w.lang")].alias("lang"), F.col("w.words").alias("phrase"), F.col("w.n").alias("n"))
    words = cut(words.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrase-words")
    total = words.agg(F.sum("n")).first()[0] or 0  # one number
    pairs = _pair_counts(shards, max(0, int(total // RANGE).bit_length()))
    frequent = cut(_frequent(pairs, least), "phrase-keys")
    found = _shard_phrases(shards, frequent, longest).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    longer = found.filter(F.col("n") >= least)
    known = cut(longer.union(words.filter(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("size"), "n")), "phrase-counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    release(shards, frequent)
    return known, totals


def _part(words: Column, start: int, size: int) -> Column:
    """`size` words from the start-th on (from 1), joined by spaces."""
    return F.array_join(F.slice(words, start, size), " ")


def apart(phrases: DataFrame, percent: int = 50, longest: int = 3) -> DataFrame:
    """phrases(lang, phrase, size, n) without those that lie in a longer one of them with `percent` of their count or more."""
    words = F.split("phrase", " ")
    inner = F.lit(None)
    for size in range(3, longest + 1):
        parts = [_part(words, start, short) for short in range(2, size) for start in range(1, size - short + 2)]
        inner = F.when(F.col("size") == size, F.array(*parts)).otherwise(inner)
    if longest < 3:
        return phrases
    inside = phrases.filter("size > 2").select("lang", F.col("n").alias("longer"), F.explode(inner).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n"))).drop("longer")


def scored(phrases: DataFrame, known: DataFrame, longest: int = 3) -> DataFrame:
    """phrases(lang, phrase, size, n), of two words or more, with a (their count), l, r, score of their worst cut.

    Counts of the parts are those in known(lang, phrase, n). Scores are exact, of 38 digits.
    """
    words, asked = F.split("phrase", " "), F.lit(None)
    for size in range(2, longest + 1):
        parts = [F.struct(F.lit(2 * k + side).alias("of"), part.alias("part")) for k in range(1, size) for side, part in enumerate((_part(words, 1, k), _part(words, k + 1, size - k)))]
        asked = F.when(F.col("size") == size, F.array(*parts)).otherwise(asked)
    each = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(asked).alias("x")).select("lang", "phrase", "size", "a", "x.*")
    found = each.join(known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    sides = [F.max(F.when(F.col("of") == 2 * k + side, F.col("f"))).alias(f"f{k}{side}") for k in range(1, longest) for side in (0, 1)]
    scores = []
    for k in range(1, longest):
        product = f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(f{k}0 as decimal(18,0)) * cast(f{k}1 as decimal(18,0)))"
        scores.append(F.when(F.col(f"f{k}0").isNotNull(), F.struct(F.expr(product).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r"))))
    worst = found.groupBy("lang", "phrase", "size", "a").agg(*sides).withColumn("worst", F.array_min(F.filter(F.array(*scores), lambda x: x.isNotNull())))
    return worst.select("lang", "phrase", "size", "a", "worst.l", "worst.r", "worst.score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first `top` phrases of each language with `rank`: by score, then count, then bytes. Parts of a language go first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")


def mined(docs: DataFrame, top: int, least: int = 10, longest: int = 3, percent: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, size, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    A phrase's score is floor(10^6 * a^2 / (l * r)) at its worst cut, l and r being the counts of what is left and right
    of it. Counts may have up to 15 digits.
    """
    known, totals = counts(docs, least, longest, lang, text)
    kept = apart(known.filter("size > 1"), percent, longest)
    return best(scored(kept, known, longest), top).join(totals, "lang")
