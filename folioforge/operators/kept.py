"""A table that is kept in a folder and changed in place.

Rows are dealt to buckets by a hash of their keys. A change writes the changed rows only, as a delta with the buckets
that it touches; deltas are merged when the table is read, by the rule that the table was made with:

- `last`: the row of the last change counts (M7, M8);
- `first`: the row that was there first counts, so a change only adds rows whose keys are new (M1);
- `best:<column>`: the row with the largest value counts, the earlier one of equals (A21);
- `sum:<column>`: the values of all changes are added up, and keys whose sum is 0 go (counts and retractions, A22).

What the table consists of is a snapshot: a small file with a number, in `log`, that lists the deltas. A change becomes
part of the table by creating the next number, which succeeds for one writer only; another one looks again and takes the
number after it. Changes of two writers never conflict, since they only add deltas; a compaction names the deltas that
it replaces, and is dropped if one of them is gone. So a crash at any point leaves the last snapshot as it was, and the
files of the attempt for `clean`. A batch with a name is taken once, however often it is delivered.

Null keys are keys like any other. Within one change the same rule picks among rows of one key, in no order for `last`
and `first`, where keys should be distinct.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.sources.scratch import file_system, write_files

#: Deltas that a table has before the change that adds one more compacts it.
DELTAS = 32
#: Rows that a task puts together at once, and the most tasks of a change or a reading.
ROWS, TASKS = 500_000, 4096


class Conflict(Exception):
    """What a compaction replaces is gone."""


class KeptTable:
    """A table in a folder: `meta` (schema, keys, rule, buckets), `log/<number>`, `data/<attempt>/bucket=<k>`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, self._path = file_system(spark, self.folder)
        meta = json.loads(self._read("meta"))
        self.schema, self.keys, self.rule, self.buckets = StructType.fromJson(meta["schema"]), meta["keys"], meta["rule"], meta["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, folder: str, columns: str, keys: list[str], rule: str = "last", buckets: int = 32) -> KeptTable:
        """An empty table of some columns (DDL)."""
        kind, _, column = rule.partition(":")
        schema = StructType.fromDDL(columns)
        if kind not in ("last", "first", "best", "sum") or (kind in ("best", "sum")) != bool(column) or (column and column not in schema.names):
            raise ValueError(f"no such rule: {rule}")
        meta = {"schema": json.loads(schema.json()), "keys": keys, "rule": rule, "buckets": buckets}
        write_files(spark, folder, {"meta": json.dumps(meta).encode()})
        return cls(spark, folder)

    # -- snapshots ----------------------------------------------------------------------------------------------

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _listed(self, kind: str) -> list[tuple[str, float]]:
        """(name, time of its last change) of what is in a subfolder."""
        home = self._path(f"{self.folder}/{kind}")
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(home)) if self._fs.exists(home) else []

    def snapshot(self) -> dict:
        """The last snapshot: its number, the deltas (name, since, buckets), and each stream's last batch."""
        names = [name for name, _ in self._listed("log") if name.isdigit()]
        return json.loads(self._read(f"log/{max(names)}")) if names else {"number": 0, "deltas": [], "streams": {}}

    def _create(self, state: dict) -> bool:
        """Makes a snapshot the last one; False if there is one of its number. It appears whole or not at all."""
        draft = f"draft-{uuid.uuid4().hex}"
        write_files(self.spark, f"{self.folder}/log", {draft: json.dumps(state).encode()})
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # a rename that doesn't replace anything
        target = self._path(f"{self.folder}/log/{state['number']:010d}")
        try:
            files.rename(self._path(f"{self.folder}/log/{draft}"), target, plain)
            return True
        except Exception:
            self._fs.delete(self._path(f"{self.folder}/log/{draft}"), False)
            if self._fs.exists(target):
                return False
            raise

    def _commit(self, delta: dict | None, rows: int, replaces: list[str] = (), stream: tuple[str, int] | None = None) -> bool:
        """Adds a delta of at most `rows` rows to the last snapshot, whichever that is; False if the stream's batch is in
        it already."""
        while True:
            state = self.snapshot()
            if stream and state["streams"].get(stream[0], -1) >= stream[1]:
                return False
            names = {d["name"] for d in state["deltas"]}
            if not names.issuperset(replaces):
                raise Conflict
            number = state["number"] + 1
            kept = [d for d in state["deltas"] if d["name"] not in replaces]
            since = min((d["since"] for d in state["deltas"] if d["name"] in replaces), default=number)
            fresh = {"number": number, "deltas": [*kept, *([delta | {"since": since, "rows": rows}] if delta else [])], "streams": state["streams"] | (dict([stream]) if stream else {})}
            if self._create(fresh):
                return True

    # -- changes ------------------------------------------------------------------------------------------------

    def _dealt(self, rows: DataFrame, most: int) -> DataFrame:
        """rows, `most` at most, with their `bucket`; a large one is dealt to several tasks."""
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        parts = -(-_tasks(most) // self.buckets)
        return dealt.repartition(self.buckets * parts, "bucket", F.pmod(F.hash(*self.keys), F.lit(parts))) if _tasks(most) > 1 else dealt.repartition("bucket")

    def _written(self, dealt: DataFrame) -> dict | None:
        """The delta that rows with their bucket were written as; None if there are none."""
        name = uuid.uuid4().hex
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        buckets = sorted(int(x.split("=")[1]) for x, _ in self._listed(f"data/{name}") if x.startswith("bucket="))
        return {"name": name, "buckets": buckets} if buckets else None

    def upsert(self, rows: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """Adds rows by the table's rule; of a named stream's batch (name, number) False, and nothing, if it was taken before."""
        if stream and self.snapshot()["streams"].get(stream[0], -1) >= stream[1]:
            return False
        ready = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(False).alias("__gone"))
        n = rows.count()
        done = self._commit(self._written(self._dealt(self._reduced(ready, F.lit(0), n), n)), n, stream=stream)
        self.compact(DELTAS)
        return done

    def delete(self, keys: DataFrame) -> bool:
        """Removes the rows of some keys, by rows that say so (rule `last`)."""
        if self.rule != "last":
            raise ValueError("rows can only be deleted where the last change counts")
        others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in self.keys else F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        n = keys.count()
        done = self._commit(self._written(self._dealt(keys.select(*self.keys).distinct().select(*others, F.lit(True).alias("__gone")), n)), n)
        self.compact(DELTAS)
        return done

    def compact(self, most: int = 0) -> bool:
        """Makes one delta of all, if there are more than `most`; False if nothing was done. Changes may go on meanwhile."""
        deltas = self.snapshot()["deltas"]
        if len(deltas) <= max(1, most):
            return False
        found = self._merged(deltas, keep_gone=False)
        n = sum(d.get("rows", 0) for d in deltas)
        name = self._written(self._dealt(found.withColumn("__gone", F.lit(False)), n))
        try:
            return self._commit(name, n, [d["name"] for d in deltas])
        except Conflict:
            return False

    def clean(self, grace: float = 86_400) -> int:
        """Removes deltas and snapshots that the last snapshot doesn't need and that are older than `grace` seconds."""
        before, state, gone = time.time() - grace, self.snapshot(), 0
        live = {d["name"] for d in state["deltas"]}
        for kind in ("log", "data"):
            for name, at in self._listed(kind):
                if at <= before and name != f"{state['number']:010d}" and name not in live:
                    self._fs.delete(self._path(f"{self.folder}/{kind}/{name}"), True)
                    gone += 1
        return gone

    # -- reading ------------------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """The table's rows as of now."""
        return self._merged(self.snapshot()["deltas"], keep_gone=False)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, few enough for their buckets to be named; only these are read."""
        wanted = keys.select(*(F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys)).distinct()
        buckets = [r["b"] for r in wanted.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # BUCKETS at most
        deltas = [d for d in self.snapshot()["deltas"] if set(buckets) & set(d["buckets"])]
        same = [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.keys]
        return self._merged(deltas, keep_gone=False, buckets=buckets).alias("t").join(wanted.alias("w"), same, "left_semi")

    def _merged(self, deltas: list[dict], keep_gone: bool, buckets: list[int] | None = None) -> DataFrame:
        if not deltas:
            return self.spark.createDataFrame([], self.schema)
        since = {d["name"]: d["since"] for d in deltas}
        paths = [f"{self.folder}/data/{d['name']}/bucket={b}" for d in deltas for b in d["buckets"] if buckets is None or b in buckets]
        columns = StructType.fromJson(json.loads(self.schema.json())).add("__gone", "boolean")
        rows = self.spark.read.schema(columns).parquet(*paths)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
        order = F.create_map(*(F.lit(x) for pair in since.items() for x in pair))[name]
        merged = self._reduced(rows.withColumn("__since", order), F.col("__since"), sum(d.get("rows", 0) for d in deltas))
        return merged.filter(~F.col("__gone")).drop("__gone") if not keep_gone else merged

    def _reduced(self, rows: DataFrame, since: Column, most: int) -> DataFrame:
        """One row of each key, by the rule. Many rows are dealt to tasks by their keys first: what a task puts together
        is bounded then, however many rows the tasks have that read them."""
        rows = rows.repartition(_tasks(most), *self.keys) if _tasks(most) > 1 else rows
        kind, _, column = self.rule.partition(":")
        names = [f.name for f in self.schema.fields]
        rest = [c for c in (*names, "__gone") if c not in self.keys]
        if kind == "sum":
            total = F.sum(column).cast(self.schema[column].dataType)
            summed = rows.groupBy(*self.keys).agg(total.alias(column), *(F.max(c).alias(c) for c in rest if c not in (column, "__gone")))
            return summed.filter(F.col(column) != 0).select(*names, F.lit(False).alias("__gone"))
        held = F.struct(*rest)
        order = {"last": -since, "first": since}.get(kind)
        if kind == "best":
            order = F.struct((-F.col(column)).isNull().alias("none"), (-F.col(column)).alias("value"), since.alias("since"), F.xxhash64(*rest).alias("tie"))
        else:
            order = F.struct(order.alias("since"), F.xxhash64(*rest).alias("tie"))
        picked = rows.groupBy(*self.keys).agg(F.min_by(held, order).alias("__held"))
        return picked.select(*(F.col(c) if c in self.keys else F.col(f"__held.{c}").alias(c) for c in (*names, "__gone")))


def _tasks(rows: int) -> int:
    return max(1, min(TASKS, -(-rows // ROWS)))


def pair_counts(pairs: KeptTable) -> DataFrame:
    """(matched, n): distinct sources of each matched item, from a kept table (source, matched, n) of rule `sum:n`."""
    return pairs.read().filter("matched is not null and n > 0").groupBy("matched").agg(F.count("*").alias("n"))
