"""Slow work per row is dealt to tasks by the number of rows, not by the bytes they were read from."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans.catalogue import QUERIES


@pytest.mark.parametrize("query,table,key", [("title_page_fields", "part", "p_partkey"), ("html_sections", "part", "p_partkey"), ("help_contents", "part", "p_partkey"), ("abstract_pages", "customer", "c_custkey")])
def test_a_small_file_of_many_rows_is_work_for_several_tasks(spark, tmp_path, query, table, key):
    rows = spark.read.parquet(f"/root/testdata/sf0.1/{table}.parquet").limit(15_000)
    more = rows.crossJoin(spark.range(4).withColumnRenamed("id", "copy"))
    more.withColumn(key, (F.col(key) + F.col("copy") * 1_000_000).cast(rows.schema[key].dataType)).drop("copy").coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[query](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_page_titles(spark):
    pages = ["a\n\n b \nc\nA Thesis Presented\nx\n\nA Dissertation", "one\ntwo\na case study proposal", "A final project\nx", "no cue\nat all", "", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(pages)], "k int, text string")
    got = rows.select("k", T.page_title("text").alias("title")).orderBy("k").collect()
    assert [r["title"] for r in got] == ["b c", "one two", "", None, None, None]
