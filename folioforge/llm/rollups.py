"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

A batch of changes is reduced to signed sums: an insert adds a document and its tokens, a delete takes both away, a
revised count adds the difference of the tokens. An attempt at a batch writes the sums to a folder of its own, whole,
and then creates an empty file whose name has the batch and that folder. The name is all that counts, so there is no
moment at which a batch is claimed but has no sums: a crash before the file leaves nothing that is read, and the batch
can be delivered again. If several attempts at a batch come through, their sums are the same and readers take the one
with the least name, so a batch counts once however often it is delivered and however many writers there are.

`compact` adds the totals up in one folder, writes the names of the batches that it folds in as a *segment* beside it,
and the list of all segments that its totals rest on; then it creates an empty file that names it and says the how
manieth it is. Readers take the last (of several, the one with the least name) and add the batches that its segments
don't have; batches that arrive meanwhile are such batches. Segments are tables, read by the batch asked for, and merged
when there are many; names don't come to the driver but for those of commits that haven't been folded and removed.

`clean` removes what a compaction has made superfluous: commits that it folded and their sums, older compactions, and
what crashed attempts have left. It leaves everything younger than `grace` seconds, which has to be longer than any
commit, compaction or read takes. So what a commit or a reader lists is what came since the last clean-up, however many
batches there have been.

Null sources, languages and versions are groups of their own. A null count is 0 tokens. A revision of a document that
moves to another group is a delete and an insert. A group whose documents and tokens are both 0 isn't listed. Rows
that repeat within a batch count as often as they come; an empty batch is committed and changes nothing.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.bpe import sent, shipped
from folioforge.llm.textstats import words_of

KEYS = ("source", "lang", "tokenizer")
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (op, source, lang, tokenizer, old_tokens, new_tokens) by KEYS: documents, tokens."""
    old, new = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("old_tokens", "new_tokens"))
    op = F.col("op")
    docs = F.when(op == INSERT, 1).when(op == DELETE, -1).when(op == REVISE, 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null")))))
    tokens = F.when(op == INSERT, new).when(op == DELETE, -old).otherwise(new - old)
    return changes.select(*KEYS, docs.cast("long").alias("documents"), tokens.alias("tokens")).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share: data/<attempt> (sums), commits/<batch>~<attempt>,
    segments/<attempt> (names), lineage/<attempt> (which segments), compactions/<number>~<attempt>."""

    SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
    #: Segments of names that a compaction leaves side by side before it merges them.
    SEGMENTS = 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, kind: str) -> list[tuple[str, float]]:
        """(name, time of its last change) of what is in a subfolder."""
        home = self._path(f"{self.folder}/{kind}")
        found = self._fs.listStatus(home) if self._fs.exists(home) else []
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in found)

    def _mark(self, kind: str, name: str) -> None:
        """Creates an empty file; that it exists is all it says."""
        self._fs.create(self._path(f"{self.folder}/{kind}/{name}"), True).close()

    def _drop(self, kind: str, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{kind}/{name}"), True)

    @staticmethod
    def _named(batch: str) -> str:
        """A batch's name in file names; a long one by its digest."""
        name = quote(batch, safe="")
        return name if len(name) <= 150 else "=" + hashlib.sha256(batch.encode()).hexdigest()

    def _commits(self) -> dict[str, str]:
        """Batches whose commits haven't been removed, by their names in file names, and the attempt that counts of each."""
        found: dict[str, str] = {}
        for name, _ in self._listed("commits"):
            batch, attempt = name.rsplit("~", 1)
            found.setdefault(batch, attempt)
        return found

    def _last(self) -> tuple[int, str | None, list[str]]:
        """The compaction that counts: its number, its attempt, and the segments that it rests on."""
        found = [(int(number), attempt) for number, attempt in (name.split("~") for name, _ in self._listed("compactions"))]
        if not found:
            return 0, None, []
        number = max(n for n, _ in found)
        attempt = min(a for n, a in found if n == number)
        lineage = self.spark.read.schema("segment string").parquet(f"{self.folder}/lineage/{attempt}")
        return number, attempt, [r["segment"] for r in lineage.collect()]  # SEGMENTS at most

    def _folded(self, segments: list[str]) -> DataFrame:
        """(batch) of what is folded in."""
        return self.spark.read.schema("batch string").parquet(*(f"{self.folder}/segments/{s}" for s in segments))

    def _open(self, segments: list[str], commits: dict[str, str]) -> dict[str, str]:
        """Those of the commits that aren't folded in."""
        if not segments or not commits:
            return commits
        names = self.spark.createDataFrame([(b,) for b in commits], "batch string")
        return {r["batch"]: commits[r["batch"]] for r in names.join(self._folded(segments), "batch", "left_anti").collect()}

    def committed(self, batch: str) -> bool:
        name = self._named(batch)
        if name in self._commits():
            return True
        segments = self._last()[2]
        return bool(segments) and not self._folded(segments).filter(F.col("batch") == name).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and nothing happens, if it is committed already."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.folder}/data/{attempt}")
        self._mark("commits", f"{self._named(batch)}~{attempt}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        commits = self._commits()  # first, so that a clean-up meanwhile can't hide a batch from both lists
        _, base, segments = self._last()
        return self._sums(self._open(segments, commits), base).filter("documents <> 0 or tokens <> 0")

    def _sums(self, commits: dict[str, str], base: str | None) -> DataFrame:
        data = [*([base] if base else []), *(a for _, a in sorted(commits.items()))]
        if not data:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.folder}/data/{d}" for d in data))
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def compact(self) -> None:
        """Folds in what is committed so far. Commits, totals and other compactions may go on meanwhile."""
        commits = self._commits()
        number, base, segments = self._last()
        fresh = self._open(segments, commits)
        attempt = uuid.uuid4().hex
        self._sums(fresh, base).write.parquet(f"{self.folder}/data/{attempt}")
        names = self.spark.createDataFrame([(b,) for b in sorted(fresh)], "batch string")
        if len(segments) >= self.SEGMENTS:
            names, segments = names.union(self._folded(segments)), []
            names = names.repartitionByRange("batch").sortWithinPartitions("batch")  # so that a look-up reads few row groups
        else:
            names = names.coalesce(1)
        names.write.parquet(f"{self.folder}/segments/{attempt}")
        self.spark.createDataFrame([(s,) for s in [*segments, attempt]], "segment string").coalesce(1).write.parquet(f"{self.folder}/lineage/{attempt}")
        self._mark("compactions", f"{number + 1:08d}~{attempt}")

    def clean(self, grace: float = 86_400) -> int:
        """Removes what nothing needs any more and is older than `grace` seconds; returns how much that was.

        Commits go before their sums, and older compactions last, so a crash in between leaves nothing that is missed.
        """
        before = time.time() - grace
        number, base, segments = self._last()
        compactions = self._listed("compactions")
        ripe = base is not None and any(name.endswith(f"~{base}") and at <= before for name, at in compactions)
        commits = self._listed("commits")
        counted = self._commits()
        still = self._open(segments, counted) if ripe else counted
        gone = 0
        for name, at in commits:
            batch, attempt = name.rsplit("~", 1)
            if at <= before and (batch not in still or still[batch] != attempt):
                self._drop("commits", name)
                gone += 1
        for name, at in compactions:
            if ripe and at <= before and not name.endswith(f"~{base}") and int(name.split("~")[0]) <= number:
                self._drop("compactions", name)
                gone += 1
        live = {name.rsplit("~", 1)[1] for kind in ("commits", "compactions") for name, _ in self._listed(kind)}
        for kind, needed in (("data", live), ("lineage", live), ("segments", live | set(segments))):
            for name, at in self._listed(kind):
                if at <= before and name not in needed:
                    self._drop(kind, name)
                    gone += 1
        return gone


def token_counts(docs: DataFrame, path: str, pattern: str, version: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document and tokenizer version (key, source, lang, tokenizer, n_tokens), and `rough`, a count made without one.

    Versions are `version`, the byte-level BPE at path, and "words". rough is a quarter of the bytes, or of the words.
    """
    ranks = shipped(docs, path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent(ranks.value, pattern)
        for batch in batches:
            exact, rough = [], []
            for t in batch.column(3):
                t = t.as_py() or ""
                words = len(words_of(t))
                exact += [len(bpe.packed(t)) // 4, words]
                rough += [len(t.encode("utf-8", "surrogatepass")) // 4, words // 4]
            n = batch.num_rows
            twice = pa.array([i for i in range(n) for _ in range(2)], pa.int64())
            columns = [batch.column(k).take(twice) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([version, "words"] * n, pa.string()), pa.array(exact, pa.int64()), pa.array(rough, pa.int64())], [key, "source", "lang", "tokenizer", "n_tokens", "rough"])

    return docs.select(key, F.col("source").cast("string"), F.col("lang").cast("string"), text).mapInArrow(run, f"`{key}` {kind}, source string, lang string, tokenizer string, n_tokens long, rough long")
