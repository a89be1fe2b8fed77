"""Ingestion marks exactly the rows that a step fails on."""

import pytest
from pyspark.sql import functions as F

from folioforge.sources.scratch import shared_folder
from folioforge.streaming import ingestion
from test_streaming import stream


def breaking(every):
    def run(rows):
        for r in rows:
            if r["id"] % every == 0:
                raise KeyError(r["id"])
        return [{"size": len(r["text"] or "")} for r in rows]

    return run


@pytest.mark.parametrize("every", [334, 10, 1])
def test_exactly_the_failing_rows_in_one_job_a_batch(spark, every):
    """12, 400 and all of 4,000 rows fail."""
    rows = spark.range(4000).withColumn("text", F.repeat(F.lit("x"), F.col("id").cast("int") % 7)).repartition(3)
    native = ingestion.checked("native", {"text": F.upper("text")}, F.when(F.col("id") % every == 0, "no"))
    python = ingestion.attempted("python", ["id", "text"], "size int", breaking(every))
    context = spark.sparkContext
    context.setJobGroup(f"ingest-{every}", "")
    try:
        done = ingestion.through(rows, [native, python]).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup(f"ingest-{every}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3 and len(done) == 4000
    for r in done:
        broken = r["id"] % every == 0
        assert [f["step"] for f in r["failed"]] == (["native", "python"] if broken else [])
        assert r["status"] == ("failed" if broken else "complete")
        assert r["size"] == (None if broken else r["id"] % 7) and r["text"] == ("x" if broken else "X") * (r["id"] % 7)
        if broken:
            assert r["failed"][1]["error"] == f"KeyError: {r['id']}"


def test_equal_rows_nulls_and_wrong_results(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "bad"), (4, "short"), (None, "z")], "id int, text string")
    returned = {"bad": [{"size": "no number"}], "short": []}

    def run(rows):
        return [x for r in rows for x in returned.get(r["text"], [{"size": 1, "more": 2}])]

    got = {(r["id"], r["text"]): (r["size"], len(r["failed"])) for r in ingestion.through(rows, [ingestion.attempted("s", ["text"], "size int", run)]).collect()}
    assert got == {(1, "a"): (1, 0), (2, None): (1, 0), (3, "bad"): (None, 1), (4, "short"): (None, 1), (None, "z"): (1, 0)}


def test_a_failing_row_keeps_its_values_and_goes_on(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")

    def run(rows):
        return [{"text": {1: "A"}[r["id"]]} for r in rows]

    steps = [ingestion.attempted("first", ["id"], "text string", run), ingestion.checked("second", {"n": F.length("text")}, F.when(F.col("text") == "A", "capital"))]
    got = {r["id"]: r for r in ingestion.through(rows, steps).collect()}
    assert got[1]["text"] == "A" and got[1]["n"] is None and [f["step"] for f in got[1]["failed"]] == ["second"]
    assert got[2]["text"] == "b" and got[2]["n"] == 1 and [f["step"] for f in got[2]["failed"]] == ["first"]
    letters = ingestion.dead_letters(ingestion.through(rows, steps)).collect()
    assert sorted((r["id"], r["step"], r["error"]) for r in letters) == [(1, "second", "capital"), (2, "first", "KeyError: 2")]


def test_a_stream_of_batches_leaves_nothing_behind(spark, tmp_path):
    import os

    rows = spark.range(40).withColumn("text", F.lit("x"))
    done = []
    steps = [ingestion.attempted("python", ["id", "text"], "size int", breaking(9))]
    folder = f"{shared_folder(spark)}/folioforge"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    writer = ingestion.ingest(stream(spark, tmp_path, rows), steps, lambda df, _: done.extend(df.collect()) or df.count())
    writer.trigger(availableNow=True).start().awaitTermination()
    assert len(done) == 40 and sorted(r["id"] for r in done if r["status"] == "failed") == [0, 9, 18, 27, 36]
    assert {x for x in set(os.listdir(folder)) - before if x.startswith("batch")} == set()


def test_an_interval_and_an_empty_batch(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, text string")
    done = []
    writer = ingestion.ingest(stream(spark, tmp_path, rows, 1), [ingestion.attempted("s", ["id"], "n int", lambda r: r)], lambda df, n: done.append(n), every="1 second")
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    assert ingestion.through(rows, [ingestion.attempted("s", ["id"], "n int", lambda r: r)]).columns == ["id", "text", "failed", "n", "status"]
