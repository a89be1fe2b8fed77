"""op13_phrases: the best phrases of two and three words in all documents, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.phrases import mined

QUERY = "op13_phrases"

ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM (
    SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM pieces),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.n AS a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * c.n * c.n // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, phrase, max(n) AS longer FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, n FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN total USING (lang) QUALIFY rank <= 2000
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases: lang, rank, phrase, a, l, r, n, score."""
    return mined(table(spark, sf_dir, "documents"), top=2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
