"""Streams give what the batch forms give."""

from conftest import SF
from pyspark.sql import functions as F

from folioforge.operators import dml
from folioforge.sources import tables as S
from folioforge.streaming import counters


def stream(spark, tmp_path, df, parts=3):
    df.repartition(parts).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_view_counts(spark, tmp_path):
    e = S.events(spark, SF).filter("event_type = 'view'")
    finish(counters.view_counts(stream(spark, tmp_path, e)), "views", "complete")
    assert {tuple(r) for r in spark.table("views").collect()} == {tuple(r) for r in counters.view_counts(e).collect()}


def test_edge_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, 5), (-1, 5), (1, 6), (1, None)], "op int, matched long")
    finish(counters.edge_counts(stream(spark, tmp_path, rows)), "edge_counts", "complete")
    assert {tuple(r) for r in spark.table("edge_counts").collect()} == {(5, 1), (6, 1)}


def test_recents(spark, tmp_path):
    e = S.events(spark, SF).filter("user_id < 20 and item is not null")
    finish(counters.recents(stream(spark, tmp_path, e), 3), "recents", "update")
    last = {}
    for r in spark.table("recents").collect():
        last[r["user_id"]] = r["items"]
    want = dml.recents(e, 3).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l")).collect()
    assert last == {r["user_id"]: [x["item"] for x in r["l"]] for r in want}


def test_windows(spark, tmp_path):
    finish(counters.windowed_views(stream(spark, tmp_path, S.events(spark, SF)), "1 day"), "windowed", "append")
    assert spark.table("windowed").columns == ["window", "item", "views"]


def test_recents_kept(spark, tmp_path):
    """Lists of several batches without a call of Python for each user, null and tied times as in the batch form."""
    e = S.events(spark, SF).filter("user_id < 20 and item is not null").select("user_id", "item", "ts")
    e = e.union(spark.createDataFrame([(77, k % 4) for k in range(9)], "user_id long, item long").withColumn("ts", F.lit(None).cast("timestamp")))
    kept = counters.recents_kept(stream(spark, tmp_path, e), 3)
    want = dml.recents(e, 3).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l")).collect()
    assert {r["user_id"]: r["items"] for r in kept.read().collect()} == {r["user_id"]: [x["item"] for x in r["l"]] for r in want}
    assert kept.snapshot()["streams"] == {"recents": 2}
