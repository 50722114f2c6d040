"""Query op8_preference and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.preference import conversations, formatted, with_other_replies


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = conversations(table(spark, sf_dir, "conversations"))
    return formatted(with_other_replies(talks), "conv_id")


def _side(side: str) -> str:
    return f"""
  {side} AS (
    SELECT conv_id, string_agg(head || plain || '<|im_end|>' || chr(10), '' ORDER BY k) AS body,
           string_agg(CASE WHEN role = 'assistant' THEN CAST(ends - length(plain) - 11 AS VARCHAR) || '-' || CAST(ends - 1 AS VARCHAR) END, ',' ORDER BY k) AS mask
    FROM (
      SELECT p.*, sum(length(head) + length(plain) + 11) OVER (PARTITION BY conv_id ORDER BY k) AS ends
      FROM (
        SELECT conv_id, k, role, head, replace(replace({side}_text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS plain
        FROM both_sides WHERE k > n
      ) p
    ) GROUP BY conv_id
  )"""


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'none') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'none'), coalesce(text, '')) AS k
  FROM conversations
),
last AS (SELECT conv_id, max(k) AS k FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT conv_id, k, text FROM t JOIN last USING (conv_id, k)),
side AS (
  SELECT t.conv_id, t.k, t.role, '<|im_start|>' || t.role || chr(10) AS head, t.text AS c_text,
         CASE WHEN own.k = t.k THEN coalesce(lent.text, '') ELSE t.text END AS r_text
  FROM t LEFT JOIN reply own ON own.conv_id = t.conv_id LEFT JOIN reply lent ON lent.conv_id = xor(t.conv_id, 1)
),
prefix AS (
  SELECT conv_id, coalesce(min(k) FILTER (WHERE c_text <> r_text) - 1, max(k)) AS n,
  FROM side GROUP BY conv_id
),
both_sides AS (SELECT side.*, n FROM side JOIN prefix USING (conv_id)),
prompt AS (
  SELECT conv_id, string_agg(head || replace(replace(c_text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), '' ORDER BY k) AS body
  FROM both_sides WHERE k <= n GROUP BY conv_id
),
{_side("c")},
{_side("r")}
SELECT p.conv_id, CAST(n AS INTEGER) AS n_prompt_turns, coalesce(prompt.body, '') AS prompt, coalesce(c.body, '') AS chosen,
       coalesce(r.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM prefix p LEFT JOIN prompt USING (conv_id) LEFT JOIN c USING (conv_id) LEFT JOIN r USING (conv_id)
"""

QUERIES = {"op8_preference": op8_preference}
ORACLES = {"op8_preference": ORACLE}
