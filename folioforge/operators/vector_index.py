"""An index of vectors: lists around k-means centres, ordered by angle.

Every row is in the list of its most similar centre, in the order of its angle to it. Centres are fitted on a bounded
sample, by sums over its partitions; the lists hold all rows. They are Parquet partitions, so a search reads the lists
that it asks for and no others.

Two ways to ask:

- `probes=n` reads the n lists with the most similar centres. What lies in others is missed.
- Without it the answer is exact. On the sphere angle(q, x) is at least the difference between angle(q, c) and
  angle(x, c). The nearest lists give a first k-th best angle t; after that only rows at angle(q, c) - t to
  angle(q, c) + t around each centre c can be as near, and lists without such rows aren't read.

How much the exact way spares depends on the data: much where vectors lie in clusters, next to nothing for vectors
spread evenly over many dimensions, where everything is about as far away as the nearest neighbour.

Rows without a vector, or with one of zeros, are left out; vectors of another length than most are a list of their own,
which is asked for by vectors of another length only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.functions import vectors as V
from folioforge.operators.search import similarity
from folioforge.sources.package import importable
from folioforge.sources.scratch import fresh, remove

#: Rows of a block; rows of a group, which a join compares in one task, and vectors that meet a group at once.
BLOCK, GROUP, ASKED = 1024, 16_384, 32_768
#: The most partitions of a join.
TASKS = 4096
#: More than rounding can make of an angle or a similarity.
EPS = 1e-7
#: The list of vectors of another length.
OTHER = -1
LISTS = "list int, centre array<double>, n long, low double, high double"


class VectorIndex:
    """An index that lies in a folder: `rows` (key, vec, theta, block, list), `lists` (list, centre, n, low, high)."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder, key
        columns = StructType.fromJson(json.loads(spark.read.text(f"{folder}/schema").first()[0]))
        self.rows = spark.read.schema(columns).parquet(f"{folder}/rows")
        found = sorted(spark.read.schema(LISTS).parquet(f"{folder}/lists").collect(), key=lambda r: r["list"])  # bounded: a row a list
        self.centres = np.array([r["centre"] for r in found if r["list"] >= 0], np.float64)
        self.n = np.array([r["n"] for r in found if r["list"] >= 0], np.int64)
        self.low, self.high = (np.array([r[x] for r in found if r["list"] >= 0], np.float64) for x in ("low", "high"))
        self.others = sum(r["n"] for r in found if r["list"] == OTHER)
        self.dim = self.centres.shape[1] if len(self.centres) else 0

    # -- making -------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, rows: DataFrame, folder: str, lists: int | None = None, key: str = "id", sample: int = 20_000, rounds: int = 5, most: int = 4096) -> VectorIndex:
        """Indexes rows(key, vec, ...) in `folder`. Centres are fitted on `sample` rows, the first by a hash of the key;
        without `lists` there are about as many as the root of the number of rows, `most` at most."""
        spark = rows.sparkSession
        importable(spark)
        usable = rows.filter(V.norm("vec") > 0)
        sizes = {r["size"]: r["n"] for r in usable.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).collect()}
        dim = max(sizes, key=lambda s: (sizes[s], s), default=0)
        lists = max(1, min(lists or math.isqrt(sizes.get(dim, 0)), most, sample))
        at = fresh(spark, "index-sample")
        usable.filter(F.size("vec") == dim).orderBy(F.xxhash64(F.col(key)), "vec").limit(sample).select("vec").repartition(4).write.parquet(at)
        centres = fitted(spark.read.schema("vec array<double>").parquet(at), lists, rounds)
        remove(spark, at)
        placed = _placed(usable, centres, dim)
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes.values()) // BLOCK + 1))
        dealt = placed.repartitionByRange(parts, "list", "theta").sortWithinPartitions("list", "theta")
        number = F.floor(F.monotonically_increasing_id() / BLOCK)  # a block may be parted by the end of a list
        blocks = dealt.withColumn("block", number)
        blocks.write.partitionBy("list").parquet(f"{folder}/rows")
        spark.createDataFrame([(json.dumps(json.loads(blocks.schema.json())),)], "value string").coalesce(1).write.text(f"{folder}/schema")
        stats = spark.read.schema(blocks.schema).parquet(f"{folder}/rows").groupBy("list").agg(F.count("*").alias("n"), F.min("theta").alias("low"), F.max("theta").alias("high"))
        found = {r["list"]: (r["n"], r["low"], r["high"]) for r in stats.collect()}  # bounded: a row a list
        table = [(k, c.tolist(), *found.get(k, (0, 0.0, 0.0))) for k, c in enumerate(centres)] + [(k, [], *v) for k, v in found.items() if k == OTHER]
        spark.createDataFrame(table, LISTS).coalesce(1).write.parquet(f"{folder}/lists")
        return cls(spark, folder, key)

    # -- asking for one vector ----------------------------------------------------------------------------------

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        """The angle of each vector to each centre."""
        return np.arccos(np.clip(unit(vectors) @ self.centres.T, -1, 1))

    def nearest(self, query: list[float], k: int, least: float | None = None, probes: int | None = None) -> DataFrame:
        """As `search.nearest`: the k most similar rows, then those at or above `least`. Exact unless `probes` is given;
        for that a first job finds the k-th best of the nearest lists."""
        q = np.array([query], np.float64)
        if q.shape[1] != self.dim or not np.linalg.norm(q):
            return self._best(self.rows.filter(F.col("list") == OTHER), query, k, least)
        angle = self.angles(q)[0]
        order = np.argsort(angle)
        if probes:
            return self._best(self._of(order[:probes]), query, k, least)
        enough = int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1
        first = self._best(self._of(order[:enough]), query, k, None).agg(F.min("similarity").alias("s"), F.count("*").alias("n")).first()
        reach = math.acos(max(-1.0, min(1.0, max(first["s"], -1.0 if least is None else least) - EPS))) if first["n"] == k else math.pi
        lists, low, high = self._within(angle, reach)
        ring = F.col("theta").between(*(F.array(*(F.lit(float(x)) for x in bound))[F.col("list")] for bound in (low, high)))
        return self._best(self._of(lists).filter(ring), query, k, least)

    def _within(self, angle: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists that can hold rows within an angle, and from and to which angle around each centre."""
        low, high = angle - reach - EPS, angle + reach + EPS
        return np.flatnonzero((self.n > 0) & (self.high >= low) & (self.low <= high)), low, high

    def _of(self, lists: np.ndarray) -> DataFrame:
        """The rows of some lists; only their files are read."""
        return self.rows.filter(F.col("list").isin(*sorted(map(int, lists))) if len(lists) else F.lit(False))

    def _best(self, rows: DataFrame, query: list[float], k: int, least: float | None) -> DataFrame:
        scored = rows.drop("theta", "block", "list").withColumn("similarity", similarity("vec", query)).filter("similarity is not null")
        best = scored.orderBy(F.desc("similarity"), self.key).limit(k)
        return best if least is None else best.filter(F.col("similarity") >= least)

    # -- asking for many ----------------------------------------------------------------------------------------

    def best_per_row(self, left: DataFrame, k: int, key: str = "qid", unlike: str | None = None, least: float = -1.0, probes: int | None = None, compared: Accumulator | None = None) -> DataFrame:
        """As `search.best_per_row` over the indexed rows, of similarity `least` or more; exact unless `probes` is given.

        Lists are put in groups of about GROUP rows, a large one by itself in several. A row goes to its group, a row of
        left(key, qvec) once to each group with a list that it asks for, and each group is compared in one task, block by
        block. `compared` is added the pairs of vectors that are compared.
        """
        asked = left.filter(V.norm("qvec") > 0).select(F.col(key).alias("key"), F.col(unlike or key).alias("unlike"), F.col("qvec").alias("vec"))
        kinds = [left.schema[key].dataType.simpleString(), left.schema[unlike or key].dataType.simpleString(), self.rows.schema[self.key].dataType.simpleString()]
        apart, parts = unlike is not None, max(1, -(-left.count() // ASKED))
        unbounded = asked.withColumn("reached", F.lit(-1.0))
        if probes:
            found = self._met(self._requests(unbounded, kinds, probes=probes), k, kinds, apart, parts, compared)
        else:
            first = self._met(self._requests(unbounded, kinds, enough=k + 1), k, kinds, apart, parts, None)
            ranks = Window.partitionBy("key").orderBy(F.desc("similarity"))
            bound = first.withColumn("n", F.row_number().over(ranks)).filter(F.col("n") == k).select("key", F.col("similarity").alias("reached"))
            bounded = asked.join(bound, "key", "left").withColumn("reached", F.greatest(F.coalesce("reached", F.lit(-1.0)), F.lit(float(least))))
            found = self._met(self._requests(bounded.select("key", "unlike", "vec", "reached"), kinds), k, kinds, apart, parts, compared)
        w = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
        best = found.filter(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return best.select(F.col("key").alias(key), F.col("other").alias(self.key), "similarity", "rank")

    def _groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The first group of each list, and how many it has; the last is that of OTHER."""
        first, parts, at, held = [], [], 0, 0
        for n in [*self.n.tolist(), self.others]:
            if held and held + n > GROUP:
                at, held = at + 1, 0
            first.append(at)
            parts.append(max(1, -(-n // GROUP)))
            at, held = (at + parts[-1], 0) if parts[-1] > 1 else (at, held + n)
        return np.array(first, np.int64), np.array(parts, np.int64)

    def _requests(self, asked: DataFrame, kinds: list[str], probes: int | None = None, enough: int | None = None) -> DataFrame:
        """(key, unlike, vec, reached, group, lists, low, high): the lists of each group that a vector asks for, and
        which angles of them."""
        index = _Lists(self.centres, self.n, self.low, self.high, *self._groups())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK // 4):
                    some = batch.slice(start, BLOCK // 4)
                    row, group, *lists = index.asked(some.column(2), np.asarray(some.column(3)), probes, enough)
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(group), *lists], ["key", "unlike", "vec", "reached", "group", "lists", "low", "high"])

        vec = asked.schema["vec"].dataType.simpleString()
        return asked.mapInArrow(run, f"key {kinds[0]}, unlike {kinds[1]}, vec {vec}, reached double, group long, lists array<int>, low array<double>, high array<double>")

    def _met(self, requests: DataFrame, k: int, kinds: list[str], apart: bool, parts: int, compared: Accumulator | None) -> DataFrame:
        """(key, other, similarity): the best k of each group for each vector that asks for it. Vectors are dealt to
        `parts`, so that a task holds a bounded number of them."""
        first, of = self._groups()
        groups = int(first[-1] + of[-1])
        tasks = min(groups * parts, TASKS)
        left = requests.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition(tasks, "group", "part")
        at = F.when(F.col("list") == OTHER, F.lit(len(first) - 1)).otherwise(F.col("list"))
        begin, many = (F.array(*map(F.lit, x.tolist()))[at] for x in (first, of))
        rows = self.rows.select("list", "theta", F.col(self.key).alias("key"), "vec", (begin + F.pmod(F.xxhash64("block"), many)).alias("group"))
        right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "group", "part")

        def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
            q, r, found, pairs = _nearest_of_group(asked.combine_chunks(), rows.combine_chunks(), k, apart)
            if compared is not None:
                compared.add(pairs)
            return pa.table([asked.column("key").take(pa.array(q)), rows.column("key").take(pa.array(r)), pa.array(found)], ["key", "other", "similarity"])

        return left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(run, f"key {kinds[0]}, other {kinds[2]}, similarity double")


class _Lists:
    """What workers know of the lists; bounded by their number."""

    def __init__(self, centres: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, parts: np.ndarray):
        self.centres, self.n, self.low, self.high, self.first, self.parts = centres, n, low, high, first, parts

    def asked(self, vectors: pa.Array, reached: np.ndarray, probes: int | None, enough: int | None) -> tuple:
        """(vector, group, lists, from, to) that vectors ask for: some nearest lists, lists with enough rows, or all that
        can hold rows of a similarity of `reached` or more."""
        dim = self.centres.shape[1] if len(self.centres) else -1
        same = np.asarray(pc.list_value_length(vectors)) == dim
        i, other = np.flatnonzero(same), np.flatnonzero(~same)
        row, at, low, high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if len(i):
            angle = np.arccos(np.clip(unit(_matrix(vectors.take(pa.array(i)))) @ self.centres.T, -1, 1))
            if probes or enough:
                order = np.argsort(angle, axis=1)
                some = np.full(len(i), probes) if probes else (np.cumsum(self.n[order], axis=1) < enough).sum(axis=1) + 1
                wanted = np.zeros(angle.shape, bool)
                np.put_along_axis(wanted, order, np.arange(angle.shape[1]) < some[:, None], axis=1)
                begin, end = np.zeros_like(angle), np.full_like(angle, 4.0)
            else:
                reach = np.arccos(np.clip(reached[i] - EPS, -1, 1))[:, None]
                begin, end = angle - reach - EPS, angle + reach + EPS
                wanted = (self.n > 0) & (self.high >= begin) & (self.low <= end)
            row, at = np.nonzero(wanted)
            low, high = begin[row, at], end[row, at]
            row = i[row]
        row, at = np.append(row, other), np.append(at, np.full(len(other), len(self.first) - 1))
        low, high = np.append(low, np.zeros(len(other))), np.append(high, np.full(len(other), 4.0))
        lists = np.where(at == len(self.first) - 1, OTHER, at).astype(np.int32)
        group = self.first[at]
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))) if len(row) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(starts, len(row)).astype(np.int32))
        times = self.parts[at[starts]]
        each = np.repeat(np.arange(len(starts)), times)
        number = group[starts][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        return row[starts][each], number, *(pa.ListArray.from_arrays(offsets, pa.array(x)).take(pa.array(each)) for x in (lists, low, high))


def _nearest_of_group(asked: pa.Table, rows: pa.Table, k: int, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vector, row, similarity) of the best k rows of a group for each vector that asks for it, ties by the rows' keys,
    and how many pairs were compared. What can be among the best is found in single precision, whose error is bounded,
    and compared in double."""
    out, pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    if not asked.num_rows or not rows.num_rows:
        return *out[0], 0
    a, b = _array(asked, "vec"), _array(rows, "vec")
    place = np.asarray(pc.rank(_array(rows, "key"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)
    mine, theirs = (np.asarray(_array(asked, "unlike")), np.asarray(_array(rows, "key"))) if apart else (None, None)
    reached, theta, list_of = np.asarray(asked.column("reached")), np.asarray(rows.column("theta")), np.asarray(rows.column("list"))
    wanted = _array(asked, "lists")
    asker = np.repeat(np.arange(asked.num_rows), np.asarray(pc.list_value_length(wanted)))
    wanted, low, high = (np.asarray(x.flatten()) for x in (wanted, _array(asked, "low"), _array(asked, "high")))
    sizes = np.asarray(pc.list_value_length(a)), np.asarray(pc.list_value_length(b))
    best, row_of = np.full((asked.num_rows, k), -np.inf), np.full((asked.num_rows, k), -1, np.int64)
    with np.errstate(all="ignore"):
        for size in np.intersect1d(*sizes):
            i, j = np.flatnonzero(sizes[0] == size), np.flatnonzero(sizes[1] == size)
            if not size:
                continue
            p, q = _matrix(a.take(pa.array(i))), _matrix(b.take(pa.array(j)))
            kept = _first_of_copies(q, place[j], k + 1)
            j, q = j[kept], q[kept]
            p_norm, q_norm = (np.sqrt((m * m).sum(axis=1)) for m in (p, q))
            x, y = ((m / n[:, None]).astype(np.float32) for m, n in ((p, p_norm), (q, q_norm)))
            within = np.full(asked.num_rows, -1)
            within[i] = np.arange(len(i))
            margin = (size + 8) * 2.0**-22
            for number in np.unique(list_of[j]):
                of = np.flatnonzero(list_of[j] == number)
                of = of[np.argsort(theta[j[of]], kind="stable")]
                those = np.flatnonzero((wanted == number) & (within[asker] >= 0))
                for block in (of[m : m + BLOCK] for m in range(0, len(of), BLOCK)):
                    near, far = theta[j[block[0]]], theta[j[block[-1]]]
                    meets = those[(high[those] >= near) & (low[those] <= far)]
                    for some in (meets[m : m + 2 * BLOCK] for m in range(0, len(meets), 2 * BLOCK)):
                        who = asker[some]
                        pairs += len(who) * len(block)
                        s = x[within[who]] @ y[block].T
                        least = np.maximum(best[who, k - 1], np.where(reached[who] > -1, reached[who], -np.inf))
                        new = np.flatnonzero(least == -np.inf)
                        if len(new) and len(block) >= k:
                            t = s[new]
                            if apart:
                                t[mine[who[new]][:, None] == theirs[j[block]][None, :]] = -np.inf
                            t = np.where(np.isfinite(t), t, -np.inf)
                            least[new] = np.partition(t, len(block) - k, axis=1)[:, len(block) - k] - margin
                        at, to = np.nonzero(s >= (least - margin).astype(np.float32)[:, None])
                        if not len(at):
                            continue
                        at, to = who[at], block[to]
                        if apart:
                            differ = mine[at] != theirs[j[to]]
                            at, to = at[differ], to[differ]
                        found = np.zeros(len(at))
                        for c in range(size):  # added up in one order whatever the block, so that equal vectors tie
                            found += p[within[at], c] * q[to, c]
                        found /= p_norm[within[at]] * q_norm[to]
                        real = np.isfinite(found)
                        _keep(best, row_of, at[real], j[to[real]], found[real], place)
    at, n = np.nonzero(row_of >= 0)
    return at, row_of[at, n], best[at, n], pairs


def _keep(best: np.ndarray, row_of: np.ndarray, at: np.ndarray, rows: np.ndarray, found: np.ndarray, place: np.ndarray) -> None:
    """Puts what is found for vectors `at` among their best k, the rows of the smallest keys first on ties."""
    k, who = best.shape[1], np.unique(at)
    at, rows, found = np.append(np.repeat(who, k), at), np.append(row_of[who].ravel(), rows), np.append(best[who].ravel(), found)
    order = np.lexsort((np.where(rows < 0, -1, place[rows]), -found, at))
    at, rows, found = at[order], rows[order], found[order]
    starts = np.searchsorted(at, who)
    first = (starts[:, None] + np.arange(k)).ravel()
    best[who], row_of[who] = found[first].reshape(-1, k), rows[first].reshape(-1, k)


def _first_of_copies(vectors: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Which rows can be among the best: of equal vectors those of the first `most` keys."""
    _, copy = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((place, copy))
    c, p = copy[order], place[order]
    begins = np.append(True, c[1:] != c[:-1])
    steps = np.cumsum(np.append(True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])))
    return np.sort(order[steps - steps[begins][np.cumsum(begins) - 1] < most])


def _array(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def fitted(sample: DataFrame, lists: int, rounds: int) -> np.ndarray:
    """Centres of length 1 by spherical k-means over sample(vec), begun with its first rows; each round is one job that
    adds up, per partition, the vectors nearest to each centre. Centres that attract nothing stay."""
    first = sample.limit(lists).collect()  # bounded by the number of lists
    if not first:
        return np.zeros((0, 0))
    centres = unit(np.array([r["vec"] for r in first], np.float64))
    dim = centres.shape[1]
    for _ in range(rounds):
        now = centres

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(now)
            for batch in batches:
                if batch.num_rows:
                    x = unit(_matrix(batch.column(0)))
                    np.add.at(sums, (x @ now.T).argmax(axis=1), x)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        total = sum(np.frombuffer(r["sums"]).reshape(-1, dim) for r in sample.mapInArrow(run, "sums binary").collect())
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.where(length > 0, length, 1), centres)
    return centres


def _placed(rows: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """rows with `list` and `theta`, the angle to its centre; vectors of another length are in OTHER."""
    names = list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(names.index("vec"))
            sizes = np.asarray(vectors.value_lengths())
            same = np.flatnonzero(sizes == dim)
            where, theta = np.full(batch.num_rows, OTHER, np.int32), np.zeros(batch.num_rows)
            if len(same):
                cosines = unit(_matrix(vectors.take(pa.array(same)))) @ centres.T
                where[same] = cosines.argmax(axis=1)
                theta[same] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta), pa.array(where)], [*names, "theta", "list"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, theta double, list int")
