"""Streams, each run to the end of its input: counters, recents, ingestion, batched changes, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import vectors as V
from folioforge.operators import dml, insights
from folioforge.operators.kept import KeptTable, pair_counts
from folioforge.plans.queries_aggregate import EDGES, RECENT, q
from folioforge.plans.registry import register
from folioforge.sources import tables as S
from folioforge.sources.scratch import fresh
from folioforge.streaming import counters, ingestion


@register("stream_edge_counts", q(EDGES, select="SELECT matched, CAST(sum(CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS n FROM e WHERE matched IS NOT NULL GROUP BY matched"))
def stream_edge_counts(spark, d):
    """Inserted and deleted edges, counted as they come."""
    changes = S.edges(spark, d).select(F.when(F.col("seq") % 3 == 0, -1).otherwise(1).alias("op"), "matched")
    return counters.settled(counters.edge_counts(counters.replayed(changes)), "complete").select("matched", "n")


@register("stream_edge_pairs", q(EDGES, "n AS (SELECT source, matched FROM e WHERE matched IS NOT NULL GROUP BY source, matched HAVING sum(CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END) > 0)", select="SELECT matched, count(*) AS n FROM n GROUP BY matched"))
def stream_edge_pairs(spark, d):
    """Distinct pairs under doubled inserts and deletes; each batch is delivered twice."""
    changes = S.edges(spark, d).select("source", "matched", F.when(F.col("seq") % 3 == 0, -1).otherwise(1).cast("long").alias("n"))
    pairs = KeptTable.create(spark, fresh(spark, "pairs"), "source long, matched long, n long", ["matched", "source"], "sum:n", buckets=8)

    def take(df, number):
        for _ in range(2):
            pairs.upsert(df, stream=("edges", number))

    counters.replayed(changes).writeStream.foreachBatch(take).option("checkpointLocation", fresh(spark, "pairs-state")).trigger(availableNow=True).start().awaitTermination()
    return pair_counts(pairs)


@register("stream_view_counts", q(RECENT, select="SELECT item, count(*) AS views FROM v WHERE event_type = 'view' GROUP BY item"))
def stream_view_counts(spark, d):
    """R2."""
    views = S.events(spark, d).filter("event_type = 'view'").select("item")
    return counters.settled(counters.view_counts(counters.replayed(views)), "complete").select("item", "views")


@register(
    "stream_recents",
    q(RECENT, "l AS (SELECT user_id, item, max(ts) AS ts FROM v WHERE item IS NOT NULL GROUP BY user_id, item)", select="SELECT user_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rank) AS items FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS rank FROM l) WHERE rank <= 10 GROUP BY user_id"),
)
def stream_recents(spark, d):
    """Each user's last list."""
    views = S.events(spark, d).filter("item is not null").select("user_id", "item", "ts")
    last = counters.recents_kept(counters.replayed(views)).read()
    return last.select("user_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


#: Every twentieth upload breaks the title step, every fiftieth (from 7 on) the size step.
BROKEN_TITLE, BROKEN_SIZE = "c_custkey % 20 = 3", "c_custkey % 50 = 7"
UPLOADS = (
    f"u AS (SELECT c_custkey AS id, CASE WHEN {BROKEN_TITLE} THEN c_name ELSE upper(c_name) END AS title, "
    f"CASE WHEN {BROKEN_SIZE} THEN NULL ELSE CAST(length(c_name) AS INTEGER) END AS size, concat_ws(',', CASE WHEN {BROKEN_TITLE} THEN 'title' END, CASE WHEN {BROKEN_SIZE} THEN 'size' END) AS failed, "
    f"CASE WHEN {BROKEN_TITLE} OR {BROKEN_SIZE} THEN 'failed' ELSE 'complete' END AS status FROM customer)"
)


def _sized(rows: list[dict]) -> list[dict]:
    """A step in Python that breaks on some rows."""
    for row in rows:
        if row["id"] % 50 == 7:
            raise ValueError(f"broken upload {row['id']}")
    return [{"size": len(row["title"])} for row in rows]


def _ingested(spark, d):
    """Uploads after two steps, one of column expressions and one of Python, as a stream of two batches."""
    wrong = F.when(F.col("id") % 20 == 3, F.concat(F.lit("broken title "), "title"))
    steps = [ingestion.checked("title", {"title": F.upper("title")}, wrong), ingestion.attempted("size", ["id", "title"], "size int", _sized)]
    rows = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    path = fresh(spark, "ingested")
    writer = ingestion.ingest(counters.replayed(rows), steps, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/{n}"))
    writer.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(f"id long, title string, failed {ingestion.FAILED}, size int, status string").parquet(path)


@register("stream_ingest", q(UPLOADS, select="SELECT * FROM u"))
def stream_ingest(spark, d):
    """Uploads through steps that fail on some rows; these rows miss only that step."""
    return _ingested(spark, d).select("id", "title", "size", F.array_join("failed.step", ",").alias("failed"), "status")


@register(
    "ingest_dead_letters",
    f"SELECT c_custkey AS id, 'title' AS step, 'broken title ' || c_name AS error FROM customer WHERE {BROKEN_TITLE} UNION ALL SELECT c_custkey, 'size', 'ValueError: broken upload ' || c_custkey FROM customer WHERE {BROKEN_SIZE}",
)
def ingest_dead_letters(spark, d):
    """What went wrong with which upload."""
    return ingestion.dead_letters(_ingested(spark, d)).select("id", "step", "error")


@register("ingest_status", q(UPLOADS, select="SELECT status, count(*) AS n FROM u GROUP BY status"))
def ingest_status(spark, d):
    """What a poll of the uploads' states sees once all are through."""
    return insights.histogram(_ingested(spark, d).select(F.array("status").alias("status")), "status", "status")


@register("batched_updates", "SELECT c_custkey AS id, upper(c_name) AS name FROM customer")
def batched_updates(spark, d):
    """An update in transactional batches."""
    rows = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return dml.in_batches(rows, lambda df: df.withColumn("name", F.upper("name")), fresh(spark, "batched"), size=max(100, rows.count() // 8))


@register(
    "embed_texts",
    q(
        "t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)",
        "b AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 4)) AS INTEGER) % 64 AS place, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY ALL)",
        select="SELECT id, CAST(place AS INTEGER) AS place, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 4) AS weight FROM b",
    ),
)
def embed_texts(spark, d):
    """Q24 with the encoder that needs no model."""
    vectors = S.chunks(spark, d).select("id", V.embedder(V.hashed_terms)("text").alias("vec"))
    return vectors.select("id", F.posexplode("vec").alias("place", "x")).filter("x <> 0").select("id", "place", F.round(F.col("x").cast("double"), 4).alias("weight"))
