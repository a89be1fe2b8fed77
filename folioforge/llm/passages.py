"""Near-duplicate passages by compact windows.

Tokens are shingles of five words (A-Z lower-cased). For a hash function, the Cartesian tree over a text's hashed
shingles groups all its subsequences by their min-hash: those whose least shingle is c are the ones that begin in
[l, c] and end in [c, r], the span of c's subtree. Only spans of `least` shingles or more matter; there are about
2n / least of them for n shingles. Two texts whose windows share a least shingle may share a passage there.

1. Equal texts are one text. Windows of HASHES functions meet by their least shingle; most meet nobody and go. The
   others meet by that shingle and the eight before or after it: a passage of fifty words that keeps the similarity
   has long unbroken runs, so its least shingle lies in one. In each group every window is paired with the group's
   first text, so pairs grow with the windows, never with the square of a group.
2. Pairs whose intervals allow a passage in `enough` functions are verified on the texts: runs of equal shingles are
   followed to either side across edits; a stretch of them whose balance allows the similarity is a passage if both
   texts have `least` shingles in it and the Jaccard similarity of their shingle sets reaches `similarity`.
3. Components are formed. Groups whose texts aren't all of one component yet meet again, whole: in a group of up to
   SMALL windows all pairs of different components are tried. Windows of larger ones meet by one of six contexts of 39
   shingles, one of which lies in any passage; and where such groups are large too, by each run of `least` shingles
   their window allows. Texts that meet by the last share the passage exactly, so pairing each with the first links
   them all. So no exact passage is lost, whatever frequent line lies in it.
4. An edited one may have no such context. So the windows of large groups whose texts aren't all of one component by
   then meet by single shingles as well: of the `least` - 1 to either side those that are rarest in the group, so many
   that two windows with the shingles of a passage in common share one of them (prefix filtering). A frequent line is
   not among them unless it is long enough to link its texts by itself. Here too the first text is tried first, then
   all pairs of what is still of different components, whatever the size of the group.

A text of fewer than `least` shingles has no passage; nor has a null or empty one. Texts are told apart by their whole
contents, and found again by md5. Extra columns don't matter; a null key never names a class.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import cut, release, workers
from folioforge.llm.components import components

SHINGLE, SIMILARITY, MIN_WORDS = 5, 0.8, 50
LEAST = MIN_WORDS - SHINGLE + 1
HASHES, ENOUGH, CONTEXT, SEED = 3, 1, 8, 99
#: In groups of up to so many windows all pairs are tried; larger ones are paired with their first text and split.
SMALL = 8
#: Rows of the parts that a group is dealt to where all its pairs are tried.
PART = 1024
#: A window's sides are kept up to so many shingles, which is far more than `least`.
SIDE = (1 << 12) - 1
#: What a shingle that isn't common costs against one that is: both sides then keep 8 of 9, a similarity of 0.8.
COST = 8
#: Bytes of a text that are parted into words at once, and where a block may end.
BLOCK, SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: An odd number, whose powers weigh the words of a run, and its inverse modulo 2 ** 64.
_POWER = 0x9E6C63D0876A9A35
_BACK = pow(_POWER, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _words(text: str | None) -> np.ndarray:
    """Hashes of a text's words, which are parted in blocks."""
    data, at, out = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(data) or not out:
        found = SPACE.search(data, at + BLOCK)
        end = found.start() if found else len(data)
        out.append(b"".join(map(xxhash.xxh64_digest, data[at:end].split(), repeat(SEED))))
        at = end
    return np.frombuffer(b"".join(out), dtype=">u8").astype(np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to size of _POWER and of its inverse."""
    return tuple(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_POWER, _BACK))


class Runs:
    """Hashes of a text's runs of shingles of any length, by sums of words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power, back = _powers(max(1 << 14, 1 << n.bit_length()))
        self.back, self.sums = back[: n + 1], np.zeros(n + 1, np.uint64)
        np.cumsum(words * power[:n], out=self.sums[1:])

    def __call__(self, first: np.ndarray, shingles: int) -> np.ndarray:
        return _mix((self.sums[first + (shingles + SHINGLE - 1)] - self.sums[first]) * self.back[first])

    def shingles(self) -> np.ndarray:
        """The hashes of all runs of one shingle."""
        n = max(0, len(self.sums) - SHINGLE)
        return _mix((self.sums[SHINGLE:] - self.sums[:n]) * self.back[:n])


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles."""
    return Runs(_words(text)).shingles()


def windows(shingles: np.ndarray, least: int = LEAST, hashes: int = HASHES) -> list[tuple[int, int, int, int]]:
    """The compact windows (function, l, c, r), both ends inclusive, of `least` shingles or more.

    Where the least shingle repeats without a break (one word over and over), its first place stands for them all, so a
    run of n equal shingles makes one window and not n: subsequences that begin later in the run are of that window too.
    """
    out: list[tuple[int, int, int, int]] = []
    if len(shingles) < least:
        return out
    end = None
    if (shingles[1:] == shingles[:-1]).any():
        end = _equal_runs(shingles, np.arange(len(shingles)))[1].tolist()
    for j in range(hashes):
        h = _mix(shingles ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        stack = [(0, len(h))]
        while stack:
            a, b = stack.pop()
            c = a + int(h[a:b].argmin())
            out.append((j, a, c, b - 1))
            if c - a >= least:
                stack.append((a, c))
            after = c + 1 if end is None else end[c] + 1
            if b - after >= least:
                stack.append((after, b))
    return out


def _texts(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(digest, md5, text): every text that is long enough for a passage once, with a number of its own."""
    workers(docs.sparkSession)
    shortest = 2 * (least + SHINGLE - 1) - 1
    rows = docs.select(F.col(text).alias("text")).filter(F.length("text") >= shortest).distinct()
    texts, again = cut(rows.select(F.xxhash64("text").alias("digest"), F.md5("text").alias("md5"), "text"), "passage-texts"), 0
    while not (same := texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")).isEmpty():
        again += 1  # different texts with one hash get another one
        other = F.when(F.col("n").isNull(), F.col("digest")).otherwise(F.xxhash64(F.lit(again), "text"))
        texts = cut(texts.join(same, "digest", "left").select(other.alias("digest"), "md5", "text"), "passage-texts")
    return texts


def _found(text: str, least: int) -> tuple[Runs, np.ndarray, np.ndarray]:
    """A text's runs and shingles, and its windows as columns (function, l, c, r)."""
    runs = Runs(_words(text))
    s = runs.shingles()
    return runs, s, np.array(windows(s, least), dtype=np.int64).reshape(-1, 4).T


def _packed(j: np.ndarray, a: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (c * HASHES + j) << 24 | np.minimum(c - a, SIDE) << 12 | np.minimum(b - c, SIDE)


def _sides(runs: Runs, begins: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 bits each of the contexts that begin and that end at a window's places; 0 where the window ends before."""
    out = np.zeros(len(a), np.uint64)
    for places, shift in ((begins, 32), (ends - CONTEXT, 0)):
        fits = np.flatnonzero((places >= a) & (places + CONTEXT <= b))
        out[fits] |= np.maximum(runs(places[fits], CONTEXT + 1) >> np.uint64(32), np.uint64(1)) << np.uint64(shift)
    return out


def _windows(texts: DataFrame, least: int) -> DataFrame:
    """(value, digest, at, sides) of every window: its least shingle under its function, text, packed place, contexts.

    Where the least shingle repeats without a break, the contexts reach out from both ends of that run; another row has
    those that reach into it. A row without a value has the number of words of a text in `at`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            words: list[tuple[int, int]] = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs, s, (j, a, c, b) = _found(text.as_py(), least)
                words.append((digest, len(runs.sums) - 1))
                if not len(j):
                    continue
                last = _equal_runs(s, c)[1]
                rows = (_mix(s[c] + j.astype(np.uint64)).view(np.int64), np.full(len(j), digest), _packed(j, a, c, b), _sides(runs, last, c, a, b).view(np.int64))
                inner = np.flatnonzero((last > c) & (last <= b))
                if len(inner):
                    inside = _sides(runs, c, last, a, b)
                    rows = tuple(np.concatenate([x, y[inner]]) for x, y in zip(rows, (*rows[:3], inside.view(np.int64)), strict=True))
                for column, x in zip(columns, rows, strict=True):
                    column.append(x)
            names = ["value", "digest", "at", "sides"]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names)
            nothing = pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array([d for d, _ in words], pa.int64()), pa.array([n for _, n in words], pa.int64()), nothing], names)

    return texts.select("digest", "text").mapInArrow(run, "value long, digest long, at long, sides long")


def _place(at: str) -> F.Column:
    return F.shiftright(at, 24)


def _shingle(at: str) -> F.Column:
    return F.floor(_place(at) / HASHES)


def _span(a: str, b: str) -> F.Column:
    """How long a subsequence around the common shingle both windows allow."""
    left = F.least(*(F.shiftright(x, 12).bitwiseAND(F.lit(SIDE)) for x in (a, b)))
    return left + F.least(*(F.col(x).bitwiseAND(F.lit(SIDE)) for x in (a, b))) + 1


def _contexts(least: int) -> list[tuple[int, int]]:
    """(shingles before, shingles after) of the contexts by which windows of large groups meet.

    They lie in steps of CONTEXT, so that a passage of `least` shingles around a shingle has one whole.
    """
    return [(k, max(0, least - CONTEXT - k)) for k in range(0, least, CONTEXT)]


def _meetings(texts: DataFrame, least: int, exact: bool) -> DataFrame:
    """(key, digest, at) of the places that texts(digest, text, places) list, under each of their contexts.

    exact: under each run of `least` shingles around the place that its window allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, places = [], [], []
            for digest, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                runs, s, found = _found(text.as_py(), least)
                j, a, c, b = found[:, np.isin(found[2] * HASHES + found[0], listed)]
                if not len(j):
                    continue
                value, at = s[c] + j.astype(np.uint64), _packed(j, a, c, b)
                if exact:  # a run of one repeated shingle may be cut anywhere
                    low, high = np.maximum(a, c - least + 1), np.minimum(_equal_runs(s, c)[1], b - least + 1)
                    which = np.repeat(np.arange(len(c)), np.maximum(0, high - low + 1))
                    begin = np.concatenate([np.arange(x, y + 1) for x, y in zip(low, high, strict=True)])
                    taken = [(which, _mix(value[which] ^ runs(begin, least)))]
                else:
                    taken = []
                    for kind, (before, after) in enumerate(_contexts(least)):
                        which = np.flatnonzero((c - before >= a) & (c + after <= b))
                        taken.append((which, _mix(value[which] ^ runs(c[which] - before, before + after + 1)) + np.uint64(kind)))
                for which, key in taken:
                    keys.append(key.view(np.int64))
                    places.append(at[which])
                    digests.append(np.full(len(which), digest))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, digests, places)], ["key", "digest", "at"])

    return texts.select("digest", "text", "places").mapInArrow(run, "key long, digest long, at long").distinct()


def _near(texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """(digest, at, n, common, keys, marks) of the places that texts(digest, text, places) list: the n distinct shingles
    in reach of each, as keys within the group of its least shingle and as 16 bits of these.

    Two sets of m shingles or more of this similarity have 2 * similarity / (1 + similarity) * m in common, so two windows
    with a passage have at least `common` of theirs. Repeated shingles leave fewer in a passage.
    """
    share = 2 * similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                runs, s, found = _found(text.as_py(), least)
                j, a, c, b = found[:, np.isin(found[2] * HASHES + found[0], listed)]
                last = _equal_runs(s, c)[1]
                low, high = np.maximum(a, c - least + 1), np.minimum(b, last + least - 1)
                keys, n, common = [], [], []
                for value, x, y in zip(s[c] + j.astype(np.uint64), low, high, strict=True):
                    near = np.unique(s[x : y + 1])
                    common.append(max(1, int(np.ceil(share * (least - (y + 1 - x - len(near))) - 1e-9))))
                    keys.append(_mix(near ^ _mix(np.array([value]))).view(np.int64))
                    n.append(len(near))
                if keys:
                    ends, every = pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), np.concatenate(keys)
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (every, every.astype(np.int16))]
                    plain = [np.full(len(n), digest), _packed(j, a, c, b), np.array(n, np.int32), np.array(common, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, plain), *lists], ["digest", "at", "n", "common", "keys", "marks"])

    schema = "digest long, at long, n int, common int, keys array<bigint>, marks array<smallint>"
    return cut(texts.select("digest", "text", "places").mapInArrow(run, schema), "passage-near")


def _rarest(near: DataFrame) -> DataFrame:
    """(key, digest, at) of the places of near under those of their shingles that are rarest in the group of their least
    one: of the n in reach all but the most frequent `common`, less one, are enough."""
    keyed = near.select("digest", "at", F.greatest(F.lit(1), F.col("n") - F.col("common") + 1).alias("most"), F.explode("keys").alias("key"))
    n = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    alone = F.coalesce(F.col("n"), F.lit(1)).alias("n")
    ranked = keyed.join(n, "key", "left").select("digest", "at", "most", F.struct(alone, "key").alias("k"))
    ranked = ranked.groupBy("digest", "at", "most").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    taken = ranked.select("digest", "at", F.explode(F.slice("keys", F.lit(1), F.col("most"))).alias("k")).filter("k.n > 1")
    return cut(taken.select("k.key", "digest", "at"), "passage-rarest")


def _alike(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The different ones of pairs(a, b, a_at, b_at) that have as many shingles in common around their places as a passage.

    A mark that only one of two places has is that of a shingle which only that place has, so none is missed.
    """

    def of(x: str) -> DataFrame:
        return near.select(F.col("digest").alias(x), F.col("at").alias(f"{x}_at"), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "common", "marks")))

    both = pairs.distinct().join(of("a"), ["a", "a_at"]).join(of("b"), ["b", "b_at"])
    most = F.col("a_n") - F.size(F.array_except("a_marks", "b_marks"))
    return both.filter(most >= F.least("a_common", "b_common")).select("a", "b", "a_at", "b_at")


def _reach(common: np.ndarray, c: int) -> tuple[int, int] | None:
    """The stretch around c, from first to last common shingle, that has the best balance of common ones."""
    if not common[c]:
        return None
    score = np.where(common, 1, -COST)
    return c - int(score[c::-1].cumsum().argmax()), c + int(score[c:].cumsum().argmax())


class _Text:
    """The shingles of a text, and their order."""

    def __init__(self, shingles: np.ndarray):
        self.shingles, self.order = shingles, shingles.argsort(kind="stable")
        self.sorted = shingles[self.order]
        self.once = not (self.sorted[1:] == self.sorted[:-1]).any()  # no shingle repeats

    def holds(self, shingles: np.ndarray) -> np.ndarray:
        """Which of the shingles the text has; it has to have some."""
        at = np.searchsorted(self.sorted, shingles)
        return self.sorted[np.minimum(at, len(self.sorted) - 1)] == shingles


class _Alike:
    """The runs of equal shingles of two texts in which no shingle repeats; each shingle then lies in one run at most."""

    def __init__(self, a: _Text, b: _Text):
        at = np.minimum(np.searchsorted(b.sorted, a.shingles), len(b.sorted) - 1)
        self.in_a = np.flatnonzero(b.sorted[at] == a.shingles)
        self.in_b = b.order[at[self.in_a]]
        first = np.flatnonzero(np.append(True, (np.diff(self.in_a) != 1) | (np.diff(self.in_b) != 1))) if len(self.in_a) else np.zeros(0, np.int64)
        self.a, self.b, self.n = self.in_a[first].tolist(), self.in_b[first].tolist(), np.diff(np.append(first, len(self.in_a))).tolist()

    def chain(self, i: int, j: int, most: float) -> np.ndarray:
        """The runs (first in a, first in b, length) around a[i] = b[j], in order: each is the nearest one to go on at."""
        start = bisect_right(self.a, i) - 1
        out = [(self.a[start], self.b[start], self.n[start])]
        t, x, y = start, self.a[start] + self.n[start], self.b[start] + self.n[start]
        while True:
            near, left, u = None, most, t + 1
            while u < len(self.a) and self.a[u] - x <= left:
                skip = max(0, y - self.b[u])
                if skip < self.n[u] and (gap := self.a[u] - x + self.b[u] - y + 2 * skip) <= left:
                    near, left = (u, skip), gap - 1
                u += 1
            if near is None:
                break
            t, skip = near
            out.append((self.a[t] + skip, self.b[t] + skip, self.n[t] - skip))
            x, y = self.a[t] + self.n[t], self.b[t] + self.n[t]
        t, x, y = start, self.a[start], self.b[start]
        while True:
            near, left, u = None, most, t - 1
            while u >= 0 and x - self.a[u] - self.n[u] <= left:
                keep = min(self.n[u], y - self.b[u])
                if keep > 0 and (gap := x - self.a[u] + y - self.b[u] - 2 * keep) <= left:
                    near, left = (u, keep), gap - 1
                u -= 1
            if near is None:
                return np.array(out, dtype=np.int64)
            t, keep = near
            out.insert(0, (self.a[t], self.b[t], keep))
            x, y = self.a[t], self.b[t]

    def similar(self, u: tuple[int, int], v: tuple[int, int], similarity: float) -> bool:
        both = int(((self.in_a >= u[0]) & (self.in_a <= u[1]) & (self.in_b >= v[0]) & (self.in_b <= v[1])).sum())
        return both >= similarity * (u[1] - u[0] + v[1] - v[0] + 2 - both)


class _Repeating:
    """The same for texts whose shingles repeat: runs are followed shingle by shingle."""

    def __init__(self, a: _Text, b: _Text):
        self.texts = a.shingles, b.shingles
        in_a, in_b = np.flatnonzero(b.holds(a.shingles)), np.flatnonzero(a.holds(b.shingles))
        self.common = len(in_a)
        self.ahead = _common(*self.texts, in_a, in_b)
        self.behind = _common(a.shingles[::-1], b.shingles[::-1], len(a.shingles) - 1 - in_a[::-1], len(b.shingles) - 1 - in_b[::-1])

    def chain(self, i: int, j: int, most: float) -> np.ndarray:
        a, b = self.texts
        right = _follow(a, b, self.ahead, i, j, most)
        left = [(len(a) - x - n, len(b) - y - n, n) for x, y, n in _follow(a[::-1], b[::-1], self.behind, len(a) - 1 - i, len(b) - 1 - j, most)]
        first = left[0]
        return np.array([*left[:0:-1], (first[0], first[1], first[2] + right[0][2] - 1), *right[1:]], dtype=np.int64)

    def similar(self, u: tuple[int, int], v: tuple[int, int], similarity: float) -> bool:
        return _similar(self.texts[0][u[0] : u[1] + 1], self.texts[1][v[0] : v[1] + 1], similarity)


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _common(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """The common shingles of a and b, at in_a and in_b: their places in a with them, and their places in b by them."""
    where: dict[int, list[int]] = {}
    for k, shingle in zip(in_b.tolist(), b[in_b].tolist(), strict=True):
        where.setdefault(shingle, []).append(k)
    return list(zip(in_a.tolist(), a[in_a].tolist(), strict=True)), where


def _follow(a: np.ndarray, b: np.ndarray, common: tuple, i: int, j: int, most: float) -> list[tuple[int, int, int]]:
    """The runs of equal shingles (first in a, first in b, length) from a[i] = b[j] on.

    Behind a run it goes on at the nearest shingle common to both, if that is at most so many shingles away.
    """
    places, where = common
    out, x, y = [], i, j
    while True:
        begin, size = (x, y), 64
        while True:  # the end of this run
            k = min(size, len(a) - x, len(b) - y)
            differ = a[x : x + k] != b[y : y + k]
            run = int(differ.argmax()) if differ.any() else k
            x, y, size = x + run, y + run, size * 2
            if run < k or k < size // 2:
                break
        out.append((*begin, x - begin[0]))
        near, left = None, most
        for at in range(bisect_left(places, (x, -1)), len(places)):
            p, shingle = places[at]
            if p - x > left:
                break
            there = where[shingle]
            k = bisect_left(there, y)
            if k < len(there) and (gap := p - x + there[k] - y) <= left:
                near, left = (p, there[k]), gap - 1
        if near is None:
            return out
        x, y = near


def _stretches(chain: np.ndarray, least: int, cost: float) -> Iterator[tuple[int, int]]:
    """First and last run of the stretches of a chain that have a balance of 0 or more, the longest first.

    The balance is 1 for each common shingle, less `cost` for each other one on either side; where a stretch has fewer
    than `least` shingles, those that fill it up are others. Stretches don't overlap.
    """
    gaps = cost * (chain[1:, 0] - chain[:-1, 0] - chain[:-1, 2] + chain[1:, 1] - chain[:-1, 1] - chain[:-1, 2])
    before = np.append(0.0, np.cumsum(chain[:-1, 2] - gaps))  # the balance ahead of each run
    behind = before + chain[:, 2]
    first, last = chain[:, :2], chain[:, :2] + chain[:, 2:] - 1
    todo = [(0, len(chain))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        best = np.maximum.accumulate(behind[lo:hi][::-1])[::-1]  # the best balance at or after each run
        at = np.arange(lo, hi)
        to = lo + np.searchsorted(-best, -(before[lo:hi] - 1e-6), side="right") - 1
        sizes = last[np.maximum(to, lo)] - first[at] + 1
        fits = (to >= at) & (sizes.min(axis=1) >= least)
        length = np.where(fits, sizes.sum(axis=1), -1)
        p, q = int(length.argmax()), -1
        if length[p] >= 0:
            p, q = lo + p, int(to[p])
        else:  # only short ones are left
            for k in range(min(hi - lo, int(least / cost) + 2)):  # more gaps would cost too much
                sizes = last[lo + k : hi] - first[lo : hi - k] + 1
                over = behind[lo + k : hi] - before[lo : hi - k] - cost * np.maximum(least - sizes, 0).sum(axis=1)
                if (over >= -1e-6).any():
                    p = lo + int(np.where(over >= -1e-6, sizes.sum(axis=1), -1).argmax())
                    q = p + k
        if q < 0:
            continue
        yield p, q
        todo += [(q + 1, hi), (lo, p)]


def _ends(first: int, last: int, n: int, least: int) -> tuple[int, int]:
    """A stretch of a text of n shingles, filled up to `least` shingles with what lies next to it."""
    first = max(0, first - max(0, least - 1 - (last - first)))
    return first, min(n - 1, max(last, first + least - 1))


def _equal_runs(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of one repeated shingle that hold the places `at`."""
    change = np.flatnonzero(np.append(x[1:] != x[:-1], True))
    k = np.searchsorted(change, at)
    return np.append(-1, change)[k] + 1, change[k]


def _starts(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One seed of each run of equal shingles of a and b that the seeds lie in.

    Where a shingle repeats without a break, its first places and its last places in a and b are the seeds.
    """
    pairs = np.array(sorted(set(seeds)), dtype=np.int64).reshape(-1, 2)
    pairs = pairs[(pairs[:, 0] < len(a)) & (pairs[:, 1] < len(b))]
    pairs = pairs[a[pairs[:, 0]] == b[pairs[:, 1]]]
    i, j = pairs.T
    (i0, i1), (j0, j1) = _equal_runs(a, i), _equal_runs(b, j)
    if (i0 != i1).any() or (j0 != j1).any():
        pairs = np.unique(np.concatenate([np.stack([i0, j0], 1), np.stack([i1, j1], 1)]), axis=0)
    out = []
    for d in np.unique(pairs[:, 1] - pairs[:, 0]).tolist():
        low = max(0, -d)
        size = min(len(a) - low, len(b) - low - d)
        breaks = np.flatnonzero(a[low : low + size] != b[low + d : low + d + size])
        those = pairs[pairs[:, 1] - pairs[:, 0] == d, 0]
        first = np.unique(np.searchsorted(breaks, those - low), return_index=True)[1]
        out += [(k, k + d) for k in those[first].tolist()]
    return sorted(out)


def verify(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """Near-duplicate passages (first and last shingle in a, the same in b) around common shingles of a and b."""
    return _verify(_Text(a), _Text(b), seeds, least, similarity)


def _verify(first: _Text, second: _Text, seeds: list[tuple[int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    a, b, once = first.shingles, second.shingles, first.once and second.once
    out: list[tuple[int, int, int, int]] = []
    if min(len(a), len(b)) < least:
        return out
    cost = min(similarity / max(1 - similarity, 1e-9), 1e6)
    if once:
        alike = _Alike(first, second)
        common = len(alike.in_a)
        if common < similarity * least:
            return out  # fewer common shingles than any passage has
    else:
        alike = _Repeating(first, second)
        common = alike.common
    whole = None
    chained: dict[int, list[tuple[int, int]]] = {}
    for i, j in _starts(a, b, seeds):
        if any(p <= i <= q and u <= j <= v for p, q, u, v in out):
            continue
        inside = False
        if not any(x <= i < y for x, y in chained.get(j - i, ())):
            chain = alike.chain(i, j, common / cost)
            for x, y, n in chain.tolist():
                chained.setdefault(y - x, []).append((x, x + n))
            for p, q in _stretches(chain, least, cost):
                u, v = _ends(int(chain[p, 0]), int(chain[q, 0] + chain[q, 2]) - 1, len(a), least), _ends(int(chain[p, 1]), int(chain[q, 1] + chain[q, 2]) - 1, len(b), least)
                if not alike.similar(u, v, similarity):  # shingles repeat: the longest run may do
                    k = p + int(chain[p : q + 1, 2].argmax())
                    if chain[k, 2] < least:
                        continue
                    u, v = (int(chain[k, 0]), int(chain[k, 0] + chain[k, 2]) - 1), (int(chain[k, 1]), int(chain[k, 1] + chain[k, 2]) - 1)
                if (*u, *v) not in out:
                    out.append((*u, *v))
                inside = inside or (u[0] <= i <= u[1] and v[0] <= j <= v[1])
        if not inside:  # the same shingles in another order
            if whole is None:
                whole = first.holds(b)
            there = _reach(whole, j)
            if there is None or there[1] - there[0] + 1 < least:
                continue
            here = _reach(np.isin(a, b[there[0] : there[1] + 1]), i)
            there = here and _reach(np.isin(b, a[here[0] : here[1] + 1]), j)
            if there and min(here[1] - here[0], there[1] - there[0]) + 1 >= least and _similar(a[here[0] : here[1] + 1], b[there[0] : there[1] + 1], similarity):
                out.append((*here, *there))
    return out


class _Grams(OrderedDict):
    """Shingles of the texts that were met last, by digest; at most `size` shingles, or one text."""

    size, held = 2_000_000, 0

    def of(self, digest: int, text: pa.Scalar) -> _Text:
        if digest in self:
            self.move_to_end(digest)
            return self[digest]
        self[digest] = found = _Text(shingles(text.as_py()))
        self.held += len(found.shingles)
        while self.held > self.size and len(self) > 1:
            self.held -= len(self.popitem(last=False)[1].shingles)
        return found


def _verified(pairs: DataFrame, least: int, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Grams()
        for batch in batches:
            rows = []
            for a, b, x, y, seeds in zip(*(batch.column(k) for k in range(5)), strict=True):
                a, b = a.as_py(), b.as_py()
                p, q = known.of(a, x), known.of(b, y)
                rows += [(a, b, *w) for w in _verify(p, q, [(s["i"], s["j"]) for s in seeds.as_py()], least, similarity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "a_from", "a_to", "b_from", "b_to"])

    return pairs.select("a", "b", "a_text", "b_text", "seeds").mapInArrow(run, "a long, b long, a_from long, a_to long, b_from long, b_to long")


def _pairs(groups: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(a, b, a_at, b_at): texts of groups(key, digest, at, root) with the first text firsts(key, a, a_at, a_root) of
    their group, unless one component has both."""
    pairs = groups.join(firsts, "key").filter((F.col("root") != F.col("a_root")) & (_span("at", "a_at") >= least))
    return pairs.select("a", F.col("digest").alias("b"), "a_at", F.col("at").alias("b_at"))


def _all_pairs(groups: DataFrame, least: int) -> DataFrame:
    """(a, b, a_at, b_at): all pairs of texts of different components in groups(key, digest, at, root) of SMALL rows."""
    members = groups.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("digest", "at", "root"))).alias("members"))
    pairs = members.select("members", F.posexplode("members").alias("k", "x")).select("x", F.explode(F.expr(f"slice(members, k + 2, {SMALL})")).alias("y")).filter("x.root <> y.root")
    pairs = pairs.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"), F.col("x.at").alias("a_at"), F.col("y.at").alias("b_at"))
    return pairs.filter(_span("a_at", "b_at") >= least)


def _every_pair(groups: DataFrame, least: int) -> DataFrame:
    """(a, b, a_at, b_at): all pairs of texts of different components in groups(key, digest, at, root) of any size.

    Each has a text outside the group's largest component, so only those meet the whole group. Both sides are dealt to
    parts of about PART rows, and two parts meet at once.
    """
    sizes = groups.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    parts = lambda n: (n / PART).cast("int") + 1
    sizes = sizes.select("key", F.col("most.root").alias("main"), parts(F.col("n") - F.col("most.n")).alias("few_parts"), parts(F.col("n")).alias("parts"))
    rows = groups.join(sizes, "key")
    dealt = lambda n: F.pmod(F.xxhash64("digest", "at"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.filter("root <> main").select("key", dealt("few_parts").alias("i"), each("parts").alias("j"), F.col("digest").alias("a"), F.col("at").alias("a_at"), F.col("root").alias("a_root"))
    every = rows.select("key", each("few_parts").alias("i"), dealt("parts").alias("j"), F.col("digest").alias("b"), F.col("at").alias("b_at"), F.col("root").alias("b_root"), "main")
    pairs = few.join(every, ["key", "i", "j"]).filter("a_root <> b_root and (b_root = main or a < b)").filter(_span("a_at", "b_at") >= least)
    first = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), first("a_at", "b_at").alias("a_at"), first("b_at", "a_at").alias("b_at"))


def _seeded(pairs: DataFrame, enough: int) -> DataFrame:
    """(a, b, seeds) of the pairs(a, b, a_at, b_at) that meet in `enough` functions."""
    seed = F.struct(_shingle("a_at").cast("int").alias("i"), _shingle("b_at").cast("int").alias("j"))
    both = pairs.groupBy("a", "b").agg(F.collect_set(seed).alias("seeds"), F.size(F.collect_set(_place("b_at") % HASHES)).alias("n"))
    return both.filter(F.col("n") >= enough).drop("n")


def _check(pairs: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """The verified passages of pairs. The second text joins first: it has few partners, the first may have many."""
    of = lambda x: texts.select(F.col("digest").alias(x), F.col("text").alias(f"{x}_text"))
    return cut(_verified(of("a").join(of("b").join(pairs.hint("shuffle_hash"), "b"), "a"), least, similarity), "passages")


def _firsts(groups: DataFrame) -> DataFrame:
    """(key, a, a_at, a_root, n) of the groups(key, digest, at, root) that have texts of several components: the first
    text, and the group's rows."""
    first = groups.groupBy("key").agg(F.min(F.struct("digest", "at", "root")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return first.filter("low <> high").select("key", F.col("first.digest").alias("a"), F.col("first.at").alias("a_at"), F.col("first.root").alias("a_root"), "n")


def _split(groups: DataFrame, firsts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of groups(key, digest, at, root): all in small groups, those with the first text in large ones; and
    (digest, places) of the rows of large groups."""
    small, large = firsts.filter(F.col("n") <= SMALL), firsts.filter(F.col("n") > SMALL)
    pairs = _all_pairs(groups.join(small.select("key"), "key", "left_semi"), least).union(_pairs(groups, large, least))
    places = groups.join(large.select("key"), "key", "left_semi").groupBy("digest").agg(F.collect_set(_place("at")).alias("places"))
    return pairs, places


def _new(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b, seeds) with the seeds that weren't tried before; two texts may have thousands, so each is a row."""
    each = lambda p: p.select("a", "b", F.explode("seeds").alias("seed")).select("a", "b", "seed.*")
    left = each(pairs).join(each(tried), ["a", "b", "i", "j"], "left_anti")
    return left.groupBy("a", "b").agg(F.collect_list(F.struct("i", "j")).alias("seeds"))


def _linked(found: DataFrame, roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found with more passages, and the roots of the components that these connect further."""
    if more.isEmpty():
        return found, roots
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b"))
    return found.union(more), cut(components(edges), "passage-roots")


def passages(texts: DataFrame, least: int = LEAST, similarity: float = SIMILARITY, enough: int = ENOUGH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified passages (a, b, a_from, a_to, b_from, b_to) of texts(digest, text): two texts and the shingles of each;
    (node, root) of the texts that these connect; and (digest, words) of all texts."""
    everything = cut(_windows(texts, least), "passage-windows")
    words = cut(everything.filter("value is null").select("digest", F.col("at").alias("words")), "passage-words")
    valued = everything.filter("value is not null")
    several = valued.groupBy("value").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    several = cut(several.select("value"), "passage-values")
    shared = valued.join(several.hint("shuffle_hash"), "value", "left_semi")
    sides = F.array(F.shiftrightunsigned("sides", 32), -F.col("sides").bitwiseAND(F.lit((1 << 32) - 1)))
    met = shared.select("value", "digest", "at", F.explode(sides).alias("side")).filter("side <> 0")
    met = cut(met.select(F.xxhash64("value", "side").alias("key"), "digest", "at", F.col("digest").alias("root")), "passage-met")
    release(everything, several)
    firsts = cut(_firsts(met), "passage-firsts")
    groups = cut(met.join(firsts.select("key").hint("shuffle_hash"), "key", "left_semi"), "passage-groups")
    release(met)
    texts = cut(texts.select("digest", "text").join(groups.select("digest").distinct().hint("shuffle_hash"), "digest", "left_semi"), "passage-some")
    pairs = cut(_seeded(_pairs(groups, firsts, least), enough), "passage-pairs")
    found = _check(pairs, texts, least, similarity)
    roots = cut(components(found.select("a", "b")), "passage-roots")

    # groups of several components meet again, whole
    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        both = rows.drop("root").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        return both.select("key", "digest", "at", F.coalesce("root", "digest").alias("root"))

    again = cut(rooted(groups.join(firsts.filter("n > 2").select("key"), "key", "left_semi"), roots), "passage-again")
    by_side, places = _split(again, cut(_firsts(again), "passage-firsts"), least)
    by_context = cut(rooted(_meetings(texts.join(places.hint("shuffle_hash"), "digest"), least, False), roots), "passage-context")
    by_context_pairs, places = _split(by_context, cut(_firsts(by_context), "passage-firsts"), least)
    by_run = cut(rooted(_meetings(texts.join(places.hint("shuffle_hash"), "digest"), least, True), roots), "passage-run")
    by_run_pairs, _ = _split(by_run, cut(_firsts(by_run), "passage-firsts"), least)
    more = cut(_new(_seeded(by_side.union(by_context_pairs).union(by_run_pairs), enough), pairs), "passage-pairs")
    release(groups, firsts, by_context, by_run)
    found, roots = _linked(found, roots, _check(more, texts, least, similarity))

    # what is left of large groups meets by its rarest shingles: with the first text, then all pairs
    again = rooted(again, roots)
    large = cut(_firsts(again).filter(F.col("n") > SMALL), "passage-firsts")
    if not large.isEmpty():
        places = again.join(large.select("key"), "key", "left_semi").groupBy("digest").agg(F.collect_set(_place("at")).alias("places"))
        near = _near(texts.join(places.hint("shuffle_hash"), "digest"), least, similarity)
        tried = pairs.union(more)
        rarest = cut(rooted(_rarest(near), roots), "passage-rarest")
        firsts = cut(_firsts(rarest), "passage-firsts")
        first_pairs = cut(_new(_seeded(_alike(_pairs(rarest, firsts, least), near), enough), tried), "passage-pairs")
        found, roots = _linked(found, roots, _check(first_pairs, texts, least, similarity))
        left = cut(rooted(rarest.join(firsts.filter("n > 2").select("key"), "key", "left_semi"), roots), "passage-left")
        left = left.join(_firsts(left).select("key"), "key", "left_semi")
        last_pairs = cut(_new(_seeded(_alike(_every_pair(left, least), near), enough), tried.union(first_pairs)), "passage-pairs")
        found, roots = _linked(found, roots, _check(last_pairs, texts, least, similarity))
        release(rarest, near, first_pairs, last_pairs)
    release(texts, pairs, more)
    return found, roots, words


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, similarity: float = SIMILARITY, enough: int = ENOUGH) -> DataFrame:
    """Per document (key, class_id, n_links, spans).

    class_id is the least key of the documents that shared passages connect it with. n_links counts the other texts
    that it was found to share a passage with, and copies of its own. spans has the passages, as first and last word, but
    for those that lie inside another.
    """
    texts = _texts(docs, text, least)
    found, roots, words = passages(texts, least, similarity, enough)
    ids = cut(docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("md5")), "passage-keys")
    copies = ids.groupBy("md5").agg(F.min("key").alias("least_key"), F.count("*").alias("copies"))
    whole = F.when((F.col("copies") > 1) & (F.col("words") >= least + SHINGLE - 1), F.col("copies") - 1).otherwise(0)
    ends = found.select("a", "b", F.col("a_from").alias("from"), F.col("a_to").alias("to")).union(found.select("b", "a", "b_from", "b_to"))
    links = ends.groupBy(F.col("a").alias("digest"), "b").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("linked"))
    spans = ends.select(F.col("a").alias("digest"), "from", "to").distinct()
    so_far = F.max("to").over(Window.partitionBy("digest").orderBy("from", F.desc("to")).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("so_far", so_far).filter("so_far is null or to > so_far")  # no more than the text has words
    spans = spans.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(F.col("from"), (F.col("to") + SHINGLE - 1).alias("to")))).alias("spans"))
    long = texts.select("digest", "md5").join(words, "digest")
    for more in (roots.withColumnRenamed("node", "digest"), links, spans):
        long = long.join(more, "digest", "left")
    one = copies.join(long, "md5").withColumn("whole", whole).filter("whole > 0 or root is not null")
    one = cut(one.select("md5", "least_key", F.coalesce(F.col("root").cast("string"), "md5").alias("root"), "words", "whole", "linked", "spans"), "passage-linked")
    release(texts)
    named = one.groupBy("root").agg(F.min("least_key").alias("class_id"))
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.col("words") - 1).cast("long").alias("to")))
    one = one.join(named, "root").select("md5", "class_id", (F.col("whole") + F.coalesce("linked", F.lit(0))).alias("n_links"), F.when(F.col("whole") > 0, all_words).otherwise(F.col("spans")).alias("spans"))
    out = ids.join(one, "md5", "left")
    none = F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("spans", none).alias("spans"))
