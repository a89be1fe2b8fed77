"""Caches, pools, uploads, parsers as arguments, batched changes, encoders."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import vectors as V
from folioforge.operators import dml, runtime
from folioforge.sources import files
from folioforge.sources.scratch import fresh, shared_folder, write_files


def test_cache_expires_and_can_be_invalidated(spark):
    now, built = [0.0], []

    def build():
        built.append(1)
        return spark.range(len(built))

    kept = runtime.Cached(build, 30, clock=lambda: now[0])
    assert kept.get().count() == 1 and kept.get().count() == 1 and len(built) == 1
    now[0] = 30.0
    assert kept.get().count() == 2
    kept.invalidate()
    assert kept.get().count() == 3


def test_pool_is_set_inside_only(spark):
    read = lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    before = read()
    with runtime.in_pool(spark, "high"):
        assert read() == "high"
    assert read() == before


def test_uploads_go_even_if_the_request_fails(spark):
    with pytest.raises(KeyError), runtime.uploaded(spark, {"a/b.txt": b"x"}) as folder:
        assert files.listing(spark, folder, "*.txt").count() == 1
        raise KeyError
    with pytest.raises(Exception, match="(?i)path"):
        files.listing(spark, folder).count()


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir") and fresh(spark, "x") != fresh(spark, "x")


def test_documents_by_a_parser(spark):
    folder = write_files(spark, fresh(spark, "docs"), {"a.pdf": "one\fzwei".encode(), "sub/b.pdf": b"", "c.txt": b"no"})
    got = files.documents(spark, folder, lambda data: data.decode().split("\f") if data else [])
    assert sorted((r["doc"].rsplit("/", 1)[1], r["page"], r["text"]) for r in got.collect()) == [("a.pdf", 1, "one"), ("a.pdf", 2, "zwei")]
    with pytest.raises(Exception, match="a.pdf"):
        files.documents(spark, folder, lambda data: [1 / len(data[:0])]).count()


def test_figures_by_an_extractor(spark):
    folder = write_files(spark, fresh(spark, "docs"), {"a.pdf": b"x"})
    got = files.figures(spark, folder, lambda data: [(1, "png", b"1"), (1, "jpg", b"2"), (3, "png", b"3")])
    assert sorted((r["page"], r["name"], bytes(r["content"])) for r in got.collect()) == [(1, "page1_img1.png", b"1"), (1, "page1_img2.jpg", b"2"), (3, "page3_img1.png", b"3")]


def test_archives_by_an_unpacker(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a%20b/c.htm", "<p>x</p>")
        z.writestr("d.css", "")

    def unpack(data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(n, z.read(n)) for n in z.namelist()]

    folder = write_files(spark, fresh(spark, "help"), {"help.chm": packed.getvalue()})
    got = {r["path"]: bytes(r["content"]) for r in files.unpacked(spark, folder, unpack).collect()}
    assert got == {"a b/c.htm": b"<p>x</p>", "d.css": b""}


def test_batches_that_are_committed_are_not_made_again(spark):
    """A run that breaks on some rows leaves the batches of other tasks; the next one makes the rest, in one pass."""
    folder = fresh(spark, "batched")
    rows = spark.range(400).withColumnRenamed("id", "k").repartition(4)
    run = lambda number, wrong: lambda df: df.withColumn("twice", F.when(F.lit(wrong) & (F.col("k") == 7), F.raise_error(F.lit("crash"))).otherwise(F.col("k") * 2)).withColumn("run", F.lit(number))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Exception, match="crash"):
            dml.in_batches(rows, run(1, True), folder, "k", 10)
        done = dml.in_batches(rows, run(2, False), folder, "k", 10)
        got = {r["k"]: (r["twice"], r["run"]) for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert done.count() == 400 and {k: v for k, (v, _) in got.items()} == {k: 2 * k for k in range(400)} and got[7][1] == 2
    again = dml.in_batches(rows, run(3, False), folder, "k", 10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))
    assert dml.in_batches(rows.limit(0), run(1, False), fresh(spark, "none"), "k").count() == 0


def test_batches_take_one_scan(spark):
    plans = []

    def change(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    dml.in_batches(spark.range(1000), change, fresh(spark, "batched"), "id", 10)
    assert len(plans) == 1 and plans[0].count("Range") == 1


def test_set_where_reads_old_values(spark):
    df = spark.createDataFrame([("x", 0), ("z", 5), (None, 7)], "status string, n int")
    got = dml.set_where(df, F.col("status") == "x", status=F.lit("y"), n=F.lit(1))
    assert {tuple(r) for r in got.collect()} == {("y", 1), ("z", 5), (None, 7)}


def test_encoder_gets_batches_of_real_texts(spark):
    def encode(texts):
        assert 0 < len(texts) <= 2 and all(t.strip() for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "abc"), (5, "ab")], "id int, text string").coalesce(1)
    got = {r["id"]: r["v"] for r in rows.select("id", V.embedder(encode, 2)("text").alias("v")).collect()}
    assert got == {1: [1.0, 1.0], 2: None, 3: None, 4: [3.0, 1.0], 5: [2.0, 1.0]}
    (v,) = V.hashed_terms(["One two, one"])
    assert math.isclose(sum(x * x for x in v), 1) and sorted(x for x in v if x)[-1] > 0.8 and V.hashed_terms(["..."]) == [[0.0] * 64]


def test_texts_become_python_objects_a_batch_at_a_time(spark):
    """What a worker holds is an Arrow batch and the vectors as numbers; before, the texts were all objects in pandas, and so was each number."""
    texts = spark.range(3000).select("id", F.repeat(F.lit("many words "), 1000).alias("text")).coalesce(1)

    def encode(some):
        import gc

        alive = sum(1 for x in gc.get_objects() if isinstance(x, list) and len(x) == 2 and x[0] == 0.25)
        return [[0.25, float(alive < 100)] for _ in some]

    got = texts.select(V.embedder(encode, 16)("text").alias("v")).groupBy(F.col("v")[1].alias("few")).count().collect()
    assert [(r["few"], r["count"]) for r in got] == [(1.0, 3000)]
