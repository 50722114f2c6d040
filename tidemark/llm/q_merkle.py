"""Query op13_merkle_manifest and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.merkle import leaf_hash, manifest, proven

EVERY = 7


def tampered() -> Column:
    """Whether the query checks the proof of a row against changed content."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0, F.lit(False))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = values | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    leaves = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", leaf_hash(*values.values()).alias("node"), F.when(tampered(), leaf_hash(*changed.values())).alias("changed")
    )
    rows = manifest(leaves, "lang", ["doc_id"]).withColumn("shown", F.coalesce("changed", "node"))
    found = proven(rows.select("doc_id", "node", "subroot", "root", "witness", "shown"), "shown")
    return found.select(
        "doc_id",
        *[F.lower(F.hex(c)).alias(name) for c, name in (("node", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))],
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _crc32(text: str) -> str:
    """Bit by bit, as the checksum is defined."""
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    byte = "xor(a, CAST(ord(b) AS BIGINT))"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    chars = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT)))"
    return f"xor(list_reduce({chars}, lambda a, b: {byte.replace('CAST(ord(b) AS BIGINT)', 'b')}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS r
  FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
          CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % {EVERY} = 0 THEN {_leaf('(CAST(n_chars AS HUGEINT) + 1)')} ELSE {_leaf('n_chars')} END AS shown
        FROM documents)
),
up AS (
  SELECT lang, 0 AS h, place, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaf
  UNION ALL
  SELECT lang, h + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 1) // 2
  FROM up WHERE n > 1 GROUP BY lang, h, place // 2
),
sub AS (SELECT lang, node AS subroot, h AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS at_top FROM up WHERE n = 1),
top AS (
  SELECT 0 AS h, at_top AS place, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT h + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY h, place // 2
),
root AS (SELECT node AS root, h AS top_height FROM top WHERE n = 1),
step AS (
  SELECT leaf.r, g.h, (leaf.place >> g.h) % 2 AS side, up.node
  FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, LATERAL (SELECT unnest(range(0, sub.height)) AS h) g
  LEFT JOIN up ON up.lang IS NOT DISTINCT FROM leaf.lang AND up.h = g.h AND up.place = xor(leaf.place >> g.h, 1)
  UNION ALL
  SELECT leaf.r, sub.height + g.h, (sub.at_top >> g.h) % 2, top.node
  FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, root, LATERAL (SELECT unnest(range(0, root.top_height)) AS h) g
  LEFT JOIN top ON top.h = g.h AND top.place = xor(sub.at_top >> g.h, 1)
),
proof AS (SELECT r, sha256(coalesce(string_agg(node, '' ORDER BY h), '')) AS proof_sha256 FROM step GROUP BY r),
walk AS (
  SELECT r, 0 AS h, shown AS node FROM leaf
  UNION ALL
  SELECT walk.r, walk.h + 1, sha256(CASE WHEN step.node IS NULL THEN walk.node WHEN step.side = 1 THEN step.node || walk.node ELSE walk.node || step.node END)
  FROM walk JOIN step ON step.r = walk.r AND step.h = walk.h
),
ended AS (SELECT r, arg_max(node, h) AS folded_root FROM walk GROUP BY r)
SELECT doc_id, leaf.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang JOIN ended USING (r) LEFT JOIN proof USING (r), root
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": ORACLE}
