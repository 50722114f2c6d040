"""Query op9_bm25 and its SQL: documents whose id is divisible by 100 as queries against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bm25 import searched
from tidemark.llm.common import table

K = 10


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return searched(docs, queries, K).withColumn("score", F.round("score", 6))


ORACLE = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
word AS (SELECT doc_id, unnest(w) AS w FROM doc),
tf AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS tf FROM word GROUP BY ALL),
df AS (SELECT w, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY w),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM doc),
score AS (
  SELECT q.doc_id AS query_id, tf.doc_id,
         round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(doc.w) / n.mean))), 9) AS score
  FROM tf q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN doc ON doc.doc_id = tf.doc_id, n
  WHERE q.doc_id % 100 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM score) WHERE r <= {K}
"""

QUERIES = {"op9_bm25": op9_bm25}
ORACLES = {"op9_bm25": ORACLE}
