"""op12_variants: spelling variants among the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.variants import variants

QUERY = "op12_variants"

#: One in about so many distinct words of a document loses a letter.
EVERY = 199

ORACLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM coded, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM places),
gone AS (SELECT DISTINCT word, n, a || b AS rest FROM cuts),
near AS (
  SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT g.word, w.word, w.n FROM gone g JOIN words w ON w.word = g.rest
  UNION ALL SELECT w.word, g.word, g.n FROM gone g JOIN words w ON w.word = g.rest),
best AS (SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS k FROM near),
found AS (
  SELECT w.word, w.n, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1),
ways AS (
  SELECT word, word AS at, form AS next FROM found
  UNION ALL SELECT w.word, w.next, f.form FROM ways w JOIN found f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN ways w ON w.word = f.word AND w.next IS NULL
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    return variants(table(spark, sf_dir, "documents"), every=EVERY)
