"""The same results as DuckDB SQL over the driver's tables."""

from __future__ import annotations

EVENT = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'log' ELSE 'edit' END AS kind,
    CASE WHEN user_id < 100 THEN 'Item' WHEN user_id < 130 THEN 'Property' ELSE 'Lexeme' END AS entity_type,
    CASE WHEN user_id < 100 THEN 'Q' WHEN user_id < 130 THEN 'P' ELSE 'L' END AS prefix,
    epoch_us(ts) // 1000 AS ms
  FROM events)"""

COMMANDS = """
cmd AS (
  SELECT 'Item' AS entity_type, user_id AS entity_num, event_id AS seq,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS rev,
    CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, value AS body,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events)"""

# The same with its seq as the body.
SEQ_COMMANDS = COMMANDS.replace("value AS body", "CAST(event_id AS VARCHAR) AS body")

CUSTOMER_STATE = """
stored AS (SELECT 'Item' AS entity_type, c_custkey AS entity_num, CAST(50 AS BIGINT) AS rev, c_acctbal AS body
           FROM customer)"""

NO_STATE = """
stored AS (SELECT entity_type, entity_num, rev, body FROM cmd WHERE false)"""

# Every entity's standing revision and body after each of its commands.
FOLD = """
st AS (
  SELECT k.entity_type, k.entity_num, CAST(0 AS BIGINT) AS rn, s.rev IS NOT NULL AS p, s.rev, s.body
  FROM (SELECT entity_type, entity_num FROM cmd UNION SELECT entity_type, entity_num FROM stored) k
  LEFT JOIN stored s ON s.entity_type = k.entity_type AND s.entity_num = k.entity_num
  UNION ALL
  SELECT st.entity_type, st.entity_num, cmd.rn,
    CASE WHEN st.p AND st.rev > cmd.rev THEN true ELSE cmd.op <> 'D' END,
    CASE WHEN st.p AND st.rev > cmd.rev THEN st.rev WHEN cmd.op = 'D' THEN NULL ELSE cmd.rev END,
    CASE WHEN st.p AND st.rev > cmd.rev THEN st.body WHEN cmd.op = 'D' THEN NULL ELSE cmd.body END
  FROM st JOIN cmd ON cmd.entity_type = st.entity_type AND cmd.entity_num = st.entity_num
    AND cmd.rn = st.rn + 1),
ended AS (
  SELECT entity_type, entity_num, rev, body
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_num ORDER BY rn DESC) AS r FROM st)
  WHERE r = 1 AND p)"""

CHANGES = """
ch AS (
  SELECT event_id AS seq, ms AS event_ts_ms, entity_type, prefix,
    CASE WHEN kind = 'log' AND k = 13 THEN NULL ELSE user_id END AS entity_num, kind,
    CASE WHEN kind <> 'log' THEN k END AS revision, event_type = 'purchase' AS is_redirect,
    event_type = 'view' AS reversed_order
  FROM ev
  WHERE value <= 300 AND value >= 0.5 AND event_type <> 'click' AND NOT (kind <> 'log' AND k = 13))"""

CONTENT = """
con AS (
  SELECT DISTINCT entity_type, prefix, user_id AS entity_num, k AS requested_revision,
    CASE c_mktsegment WHEN 'FURNITURE' THEN k + 1 ELSE k END AS revision, c_name AS label
  FROM ev JOIN customer ON user_id = c_custkey
  WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT (c_mktsegment = 'HOUSEHOLD' AND k = 7))"""

RESOLVED = """
res AS (
  SELECT ch.seq, ch.event_ts_ms, ch.entity_type, ch.entity_num,
    CASE WHEN con.revision IS NOT NULL OR kind = 'new' THEN 'U' ELSE 'D' END AS op,
    coalesce(con.revision, ch.revision) AS revision,
    CASE WHEN con.revision IS NOT NULL
           THEN '{"id":"' || ch.prefix || ch.entity_num || '","lastrevid":' || con.revision
                || ',"label":"' || con.label || '"}'
         WHEN kind = 'new' THEN '{"id":"' || ch.prefix || ch.entity_num || '", "lastrevid":' || ch.revision || '}'
    END AS data,
    CASE WHEN con.revision IS NOT NULL THEN NULL WHEN kind = 'new' THEN 'stub'
         WHEN is_redirect THEN 'redirect' ELSE 'not_found' END AS reason
  FROM ch LEFT JOIN con ON con.entity_type = ch.entity_type AND con.entity_num = ch.entity_num
    AND con.requested_revision = ch.revision
  WHERE kind <> 'log')"""

RESOLVED_COMMANDS = """
cmd AS (
  SELECT entity_type, entity_num, seq, revision AS rev, op, data AS body,
    row_number() OVER (PARTITION BY entity_type, entity_num ORDER BY seq) AS rn
  FROM res)"""

# The same where every 97th record has no readable position.
DAMAGED_CHANGES = CHANGES.replace("WHERE value <= 300", "WHERE event_id % 97 <> 0 AND value <= 300")

CUSTOMER_BODIES = """
SELECT 'Item' AS entity_type, c_custkey AS entity_num, CAST(10 AS BIGINT) AS rev,
  '{"id":"Q' || c_custkey || '","lastrevid":10,"label":"' || c_name || '"}' AS body FROM customer"""

# Every other customer, else the content's highest revision.
FIRST_LOAD = f"""
spine AS (SELECT unnest(range(1, max(user_id) + 101)) AS entity_num FROM ev WHERE entity_type = 'Item'),
best AS (
  SELECT entity_num, max((revision, '{{"id":"Q' || entity_num || '","lastrevid":' || revision || ',"label":"' || label || '"}}')) AS b
  FROM con WHERE entity_type = 'Item' GROUP BY 1),
dumped AS (SELECT * FROM ({CUSTOMER_BODIES}) WHERE entity_num % 2 = 0),
stored AS (
  SELECT 'Item' AS entity_type, spine.entity_num, coalesce(d.rev, b[1]) AS rev, coalesce(d.body, b[2]) AS body
  FROM spine LEFT JOIN dumped d ON d.entity_num = spine.entity_num LEFT JOIN best ON best.entity_num = spine.entity_num
  WHERE d.rev IS NOT NULL OR b IS NOT NULL)"""

POSITION = """
pos AS (
  SELECT *, '{"topic":"east.changes","partition":0,"timestamp":' AS timed,
    '{"topic":"west.changes","partition":0,"offset":-1}' AS counted FROM ev)"""


def position_text(ms: str, reversed_order: str) -> str:
    return (
        f"CASE WHEN {reversed_order} THEN '[' || counted || ',' || timed || ({ms}) || '}}]' "
        f"ELSE '[' || timed || ({ms}) || '}},' || counted || ']' END"
    )


DOCUMENT_ROWS = """
SELECT doc_id AS entity_num, n_chars AS revision, md5(text) AS text_md5 FROM documents"""


def volume_rows(budget: int, source: str) -> str:
    """Entities with their volume, and the volume table, for a source of (entity_type, entity_num, sz)."""
    return f"""
sized AS ({source}),
placed AS (
  SELECT *, CAST(sum(sz) OVER (PARTITION BY entity_type ORDER BY entity_num) - sz AS BIGINT) // {budget} AS bucket
  FROM sized),
assigned AS (
  SELECT entity_type, entity_num, sz,
    CAST(dense_rank() OVER (PARTITION BY entity_type ORDER BY bucket) - 1 AS INTEGER) AS volume_id
  FROM placed),
vol AS (
  SELECT entity_type, volume_id, count(*) AS n, CAST(sum(sz) AS BIGINT) AS raw_bytes,
    min(entity_num) AS first_num, max(entity_num) AS last_num
  FROM assigned GROUP BY ALL),
volumes AS (
  SELECT *, coalesce(lag(last_num) OVER w + 1, least(1, first_num)) AS lo,
    CASE WHEN lead(volume_id) OVER w IS NOT NULL THEN last_num END AS hi
  FROM vol WINDOW w AS (PARTITION BY entity_type ORDER BY volume_id))"""


DOCUMENT_SIZES = "SELECT 'Item' AS entity_type, doc_id AS entity_num, octet_length(encode(text)) + 1 AS sz FROM documents"
ORDER_SIZES = (
    "SELECT 'Item' AS entity_type, o_orderkey AS entity_num, octet_length(encode(o_orderpriority)) + 1 AS sz FROM orders"
)
TYPED_ORDER_SIZES = (
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'Item' WHEN 'O' THEN 'Property' ELSE 'Lexeme' END AS entity_type, "
    "o_orderkey AS entity_num, octet_length(encode(o_orderpriority)) + 1 AS sz FROM orders"
)

OUTCOMES = """
count(*) FILTER (WHERE NOT st.p AND cmd.op = 'U') AS inserted,
count(*) FILTER (WHERE st.p AND st.rev <= cmd.rev AND cmd.op = 'U') AS replaced,
count(*) FILTER (WHERE st.p AND st.rev <= cmd.rev AND cmd.op = 'D') AS deleted,
count(*) FILTER (WHERE st.p AND st.rev > cmd.rev) AS stale,
count(*) FILTER (WHERE NOT st.p AND cmd.op = 'D') AS missing_delete
FROM st JOIN cmd ON cmd.entity_type = st.entity_type AND cmd.entity_num = st.entity_num AND cmd.rn = st.rn + 1"""


def reconcile_sql(where_spine: str) -> str:
    return f"""
WITH best AS (
  SELECT l_orderkey AS id, max((l_partkey * 10 + l_linenumber, l_returnflag || l_linestatus || l_suppkey)) AS b
  FROM lineitem GROUP BY 1),
bounds AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
spine AS (SELECT unnest(range(lo, hi + 101)) AS id FROM bounds),
found AS (SELECT o_orderkey AS id, o_orderpriority AS data FROM orders WHERE o_orderstatus <> 'P')
SELECT spine.id AS entity_num, coalesce(b[1], 1) AS revision, coalesce(b[2], found.data) AS data,
  CASE WHEN b IS NOT NULL THEN 'dump' ELSE 'lookup' END AS origin
FROM spine LEFT JOIN best USING (id) LEFT JOIN found USING (id), bounds
WHERE (b IS NOT NULL OR found.data IS NOT NULL) AND {where_spine}"""


ARRIVAL_ORDER = """
a AS (SELECT event_id, row_number() OVER (ORDER BY event_id + (event_id * 7919) % 31, event_id) - 1 AS pos FROM events)"""

ARRIVAL = f"""{ARRIVAL_ORDER},
inv AS (SELECT x.event_id, count(y.event_id) AS c
        FROM a x LEFT JOIN a y ON y.pos < x.pos AND y.event_id > x.event_id GROUP BY 1)"""

TYPED_FEED = """
tf AS (SELECT event_id AS seq, ms AS event_ts_ms, entity_type, octet_length(encode(props)) AS sz FROM ev)"""

SAMPLES = """
s AS (SELECT i AS feed_index, ms AS event_ts_ms, as_of - ms AS lag_ms
      FROM (SELECT ms, row_number() OVER (ORDER BY event_id) - 1 AS i, max(ms) OVER () AS as_of FROM ev)
      WHERE i % 10 = 0)"""

LEDGER = """
led AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'Item' WHEN 'O' THEN 'Property' ELSE 'Lexeme' END AS entity_type,
    o_orderkey AS item_id, o_totalprice <= 499000 AS persisted FROM orders)"""

MERGED_COLUMNS = "SELECT entity_num, rev AS revision, body AS value FROM ended"

ORACLES: dict[str, str] = {
    "merge_sequence": f"WITH RECURSIVE {COMMANDS}, {NO_STATE}, {FOLD} {MERGED_COLUMNS}",
    "merge_lww": f"""WITH {COMMANDS}
        SELECT entity_num, rev AS revision, body AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_num ORDER BY rev DESC, seq DESC) AS r FROM cmd)
        WHERE r = 1 AND op = 'U'""",
    "merge_with_state": f"WITH RECURSIVE {COMMANDS}, {CUSTOMER_STATE}, {FOLD} {MERGED_COLUMNS}",
    "merge_outcomes": f"""WITH RECURSIVE {COMMANDS}, {CUSTOMER_STATE}, {FOLD}
        SELECT cmd.entity_num, {OUTCOMES} GROUP BY 1""",
    "merge_outcomes_by_volume": f"""WITH RECURSIVE {COMMANDS}, {CUSTOMER_STATE}, {FOLD},
        {volume_rows(3000, "SELECT entity_type, entity_num, 100 AS sz FROM stored")},
        o AS (SELECT cmd.entity_num, {OUTCOMES} GROUP BY 1)
        SELECT volume_id, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(replaced) AS BIGINT) AS replaced,
          CAST(sum(deleted) AS BIGINT) AS deleted, CAST(sum(stale) AS BIGINT) AS stale,
          CAST(sum(missing_delete) AS BIGINT) AS missing_delete
        FROM o JOIN assigned USING (entity_num) GROUP BY 1""",
    "replay_overlap": f"""WITH RECURSIVE once AS (
          SELECT 'Item' AS entity_type, user_id AS entity_num, event_id AS seq,
            CAST(json_extract_string(props, '$.k') AS BIGINT) AS rev,
            CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, value AS body FROM events),
        cmd AS (
          SELECT *, row_number() OVER (PARTITION BY entity_num ORDER BY round, seq) AS rn
          FROM (SELECT *, 1 AS round FROM once UNION ALL SELECT *, 2 FROM once WHERE rev >= 90)),
        {NO_STATE}, {FOLD} {MERGED_COLUMNS}""",
    "id_parse_format": """WITH t AS (
          SELECT o_orderkey,
            CASE WHEN o_totalprice > 450000 THEN 'Z'
                 ELSE CASE o_orderstatus WHEN 'F' THEN 'Q' WHEN 'O' THEN 'P' ELSE 'L' END END
            || CASE o_orderpriority WHEN '1-URGENT' THEN '0' || o_orderkey WHEN '2-HIGH' THEN '+' || o_orderkey
                 WHEN '3-MEDIUM' THEN CAST(o_orderkey * 400000 AS VARCHAR)
                 WHEN '5-LOW' THEN o_orderkey || 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS id_text,
            CASE o_orderstatus WHEN 'F' THEN 'Q' WHEN 'O' THEN 'P' ELSE 'L' END AS prefix
          FROM orders),
        n AS (
          SELECT *, CASE WHEN id_text[1] = prefix AND regexp_full_match(id_text[2:], '[0-9]+')
              AND TRY_CAST(id_text[2:] AS BIGINT) <= 4294967295 THEN TRY_CAST(id_text[2:] AS BIGINT) END AS num
          FROM t)
        SELECT o_orderkey, id_text, num AS entity_num, prefix || num AS formatted, num + 1 AS next_num FROM n""",
    "title_parse": """SELECT o_orderkey,
          CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 400000 THEN o_orderkey
               WHEN o_orderstatus = 'O' THEN o_orderkey
               WHEN o_orderstatus = 'P' AND o_totalprice <= 400000 THEN o_orderkey END AS entity_num
        FROM orders""",
    "entity_type_lookup": """SELECT d.*, n AS entities
        FROM (VALUES ('Item', 0, 0, 'Q', '', 'items'), ('Property', 1, 120, 'P', 'Property:', 'properties'),
                     ('Lexeme', 2, 146, 'L', 'Lexeme:', 'lexemes'))
          d(entity_type, type_ord, namespace, id_prefix, title_prefix, export_name)
        JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'Item' WHEN 'O' THEN 'Property' ELSE 'Lexeme' END AS entity_type,
                count(*) AS n FROM orders GROUP BY 1) USING (entity_type)""",
    "position_decode_rewind": f"""WITH {EVENT}, {POSITION}
        SELECT event_id AS seq, ms AS event_ts_ms, ms - 20000 AS rewound_ts_ms,
          {position_text("ms - 20000", "event_type = 'view'")} AS rewound FROM pos""",
    "dump_parse": DOCUMENT_ROWS,
    "dump_scan_bzip2": DOCUMENT_ROWS,
    "dump_scan_lines": DOCUMENT_ROWS,
    "dump_quarantine": """SELECT CASE source WHEN 'src3' THEN 'bad_json' WHEN 'src4' THEN 'bad_revision'
            WHEN 'src5' THEN 'bad_id' ELSE 'accepted' END AS reason, count(*) AS lines
        FROM documents WHERE source <> 'src6' GROUP BY 1""",
    "bootstrap_reconcile": reconcile_sql("true"),
    "bootstrap_resume": reconcile_sql("spine.id BETWEEN (lo + hi) // 2 AND hi"),
    "id_spine": """SELECT id AS entity_num, 'P' || id AS id_text
        FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 101)) AS id FROM orders)""",
    "missing_ids": """SELECT id AS entity_num
        FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 1)) AS id FROM orders)
        WHERE id NOT IN (SELECT l_orderkey FROM lineitem)""",
    "feed_filter_decode": f"""WITH {EVENT}, {CHANGES}
        SELECT seq, event_ts_ms, entity_type, entity_num, kind, revision, is_redirect FROM ch""",
    "feed_quarantine": f"""WITH {EVENT}
        SELECT 'feed' AS source, CASE WHEN value > 300 THEN 'bad_payload' WHEN value < 0.5 THEN 'unknown_kind'
            ELSE 'bad_title' END AS reason, count(*) AS records
        FROM ev
        WHERE value > 300 OR (event_type <> 'click' AND (value < 0.5 OR (kind <> 'log' AND k = 13))) GROUP BY ALL""",
    "feed_numbering": f"""WITH {EVENT}, {CHANGES}
        SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS feed_index FROM ch""",
    "feed_head": f"""WITH {EVENT}, {POSITION}
        SELECT event_id AS seq, {position_text("ms", "event_type = 'view'")} AS event_id_json
        FROM pos ORDER BY event_id LIMIT 1""",
    "feed_from_position": f"""WITH {EVENT}, {POSITION}
        SELECT event_id AS seq, {position_text("ms", "event_type = 'view'")} AS event_id_json
        FROM pos WHERE ms >= (SELECT (min(ms) + max(ms)) // 2 FROM ev) - 20000""",
    "latest_entity_id": f"""WITH {EVENT}, {CHANGES}
        SELECT entity_type, arg_max(entity_num, seq) AS entity_num, arg_max(entity_num, seq) + 100 AS bootstrap_end
        FROM ch WHERE kind = 'new' GROUP BY 1""",
    "content_extract": f"""WITH {EVENT}, {CONTENT}
        SELECT entity_type, entity_num, requested_revision, revision, label FROM con""",
    "resolve_changes": f"WITH {EVENT}, {CHANGES}, {CONTENT}, {RESOLVED} SELECT * FROM res",
    "received_updates": f"""WITH {EVENT}, {CHANGES}, {CONTENT}, {RESOLVED}
        SELECT entity_type, count(*) AS updates_received FROM res GROUP BY 1""",
    "current_state": f"""WITH RECURSIVE {EVENT}, {CHANGES}, {CONTENT}, {RESOLVED}, {RESOLVED_COMMANDS}, {NO_STATE}, {FOLD}
        SELECT entity_type, entity_num, rev AS revision, body AS data FROM ended""",
    "volume_table": f"""WITH {volume_rows(1_000_000, DOCUMENT_SIZES)}
        SELECT volume_id, lo, hi, n AS rows, raw_bytes, first_num, last_num FROM volumes""",
    "volume_assign": f"""WITH {volume_rows(1_000_000, DOCUMENT_SIZES)}
        SELECT entity_num, volume_id, sz AS raw_bytes FROM assigned""",
    "volume_report": f"""WITH {volume_rows(1_000_000, DOCUMENT_SIZES)}
        SELECT volume_id, n AS rows, first_num, last_num, raw_bytes FROM vol""",
    "volume_route": f"""WITH {volume_rows(20_000, ORDER_SIZES)}
        SELECT volume_id, count(*) AS rows, min(l_orderkey) AS first_num, max(l_orderkey) AS last_num
        FROM lineitem JOIN volumes ON l_orderkey BETWEEN lo AND coalesce(hi, 4294967295) GROUP BY 1""",
    "initialized_up_to": f"""WITH {volume_rows(20_000, TYPED_ORDER_SIZES)}
        SELECT entity_type, CASE WHEN entity_type = 'Property' THEN max(hi) ELSE max(last_num) END AS initialized_up_to
        FROM volumes GROUP BY 1""",
    "entity_order": """SELECT entity_type, entity_num, row_number() OVER (ORDER BY o, entity_num) - 1 AS place
        FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'Item' WHEN 'O' THEN 'Property' ELSE 'Lexeme' END AS entity_type,
                CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS o, o_orderkey AS entity_num FROM orders)""",
    "export_whole": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id AS entity_num,
          md5(text) AS data_md5 FROM documents WHERE length(text) > 0""",
    "export_range": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id AS entity_num,
          md5(text) AS data_md5
        FROM documents, (SELECT max(doc_id) AS last FROM documents)
        WHERE length(text) > 0 AND doc_id BETWEEN last // 4 AND 3 * last // 4""",
    "export_files": """SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS revisions,
          CAST(max(doc_id) - min(doc_id) + 1 - count(*) AS BIGINT) AS overlap FROM documents""",
    "disorder_profile": """WITH a AS (
          SELECT event_id, max(event_id) OVER (ORDER BY event_id + (event_id * 7919) % 31, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
        SELECT count(*) AS rows, count(*) FILTER (WHERE seen > event_id) AS behind,
          coalesce(max(seen - event_id) FILTER (WHERE seen > event_id), 0) AS largest_gap FROM a""",
    "late_rows": f"""WITH {ARRIVAL}
        SELECT CAST(n AS INTEGER) AS buffer_size, count(*) FILTER (WHERE c > n) AS late_rows
        FROM inv, (VALUES (5), (30)) s(n) GROUP BY 1""",
    "smallest_buffer": f"WITH {ARRIVAL} SELECT max(c) AS smallest_buffer FROM inv",
    "reorder_feed": f"""WITH {ARRIVAL_ORDER},
        before AS (SELECT x.pos, count(*) AS n FROM a x JOIN a y ON y.pos < x.pos AND y.event_id > x.event_id GROUP BY 1)
        SELECT event_id, pos AS arrival_rank, row_number() OVER (ORDER BY event_id) - 1 AS emit_index,
          coalesce(n > 30, false) AS late FROM a LEFT JOIN before USING (pos)""",
    "feed_rate": f"""WITH {EVENT}, {TYPED_FEED}
        SELECT event_ts_ms // 86400000 * 86400000 AS period_start_ms, entity_type, count(*) AS events,
          CAST(sum(sz) AS BIGINT) AS bytes, count(*) / 86400.0::DOUBLE AS events_per_sec FROM tf GROUP BY 1, 2""",
    "feed_rate_total": f"""WITH {EVENT}, {TYPED_FEED},
        w AS (SELECT count(*) AS n, max(event_ts_ms) - min(event_ts_ms) AS span FROM tf)
        SELECT entity_type, count(*) AS events, CAST(sum(sz) AS BIGINT) AS bytes,
          round(count(*) / max(n)::DOUBLE, 6) AS share,
          round(count(*) * 1000.0::DOUBLE / max(span), 6) AS events_per_sec
        FROM tf, w GROUP BY ROLLUP (entity_type)""",
    "feed_lag": f"""WITH {EVENT}, {SAMPLES}
        SELECT count(*) AS samples, min(lag_ms) AS min_lag_ms, quantile_disc(lag_ms, 0.5) AS median_lag_ms,
          max(lag_ms) AS max_lag_ms FROM s""",
    "feed_lag_samples": f"WITH {EVENT}, {SAMPLES} SELECT * FROM s",
    "safe_frontier": f"""WITH {LEDGER}
        SELECT entity_type,
          CASE WHEN max(item_id) FILTER (WHERE persisted) IS NOT NULL THEN
            least(max(item_id) FILTER (WHERE persisted), min(item_id) FILTER (WHERE NOT persisted) - 1) END AS frontier,
          count(*) FILTER (WHERE NOT persisted) AS outstanding_items, bool_and(persisted) AS all_persisted
        FROM led GROUP BY 1""",
    "progress_positions": f"""WITH {EVENT}, {CHANGES}, {POSITION},
        p AS (SELECT ch.entity_type, ch.seq, ch.event_ts_ms, {position_text("pos.ms", "reversed_order")} AS j
              FROM ch JOIN pos ON pos.event_id = ch.seq)
        SELECT entity_type, min(event_ts_ms) AS start_event_ts_ms, arg_min(j, (event_ts_ms, seq)) AS start_event_id,
          max(event_ts_ms) AS last_event_ts_ms, arg_max(j, (event_ts_ms, seq)) AS last_event_id
        FROM p GROUP BY 1""",
    "conservative_start": f"""WITH {EVENT}, {CHANGES}
        SELECT DISTINCT entity_type, (SELECT arg_min(ms, event_id) FROM ev) AS last_event_ts_ms FROM ch""",
    "quality_checks": f"""WITH {EVENT}, {volume_rows(1_000_000, DOCUMENT_SIZES)}, {LEDGER}
        SELECT 'outside_volume' AS check_name, count(*) AS violations
        FROM assigned a JOIN volumes v USING (entity_type, volume_id)
        WHERE v.volume_id = 1 AND a.entity_num < v.lo + 10
        UNION ALL SELECT 'empty_ranges', count(*) FROM volumes WHERE hi < lo
        UNION ALL SELECT 'never_pending', count(*) FROM led WHERE entity_type = 'Lexeme' AND persisted
        UNION ALL SELECT 'bad_content', count(*) FROM (
          SELECT DISTINCT user_id, k FROM ev JOIN customer ON c_custkey = user_id
          WHERE c_mktsegment = 'HOUSEHOLD' AND k = 7)
        UNION ALL SELECT 'oversize_volumes', count(*) FROM volumes WHERE raw_bytes > 1000000 // 4 * 2
        UNION ALL SELECT 'repeated_entities', count(*) FROM (
          SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
    "id_gaps": """SELECT 'Item' AS entity_type, min(l_orderkey) AS first_num, max(l_orderkey) AS last_num,
          count(DISTINCT l_orderkey) AS entities, count(*) AS rows,
          max(l_orderkey) - min(l_orderkey) + 1 - count(DISTINCT l_orderkey) AS missing FROM lineitem""",
    "store_load": f"""WITH loaded AS ({reconcile_sql("true")}),
        {volume_rows(20_000, "SELECT 'Item' AS entity_type, entity_num, octet_length(encode(data)) + 1 AS sz FROM loaded")}
        SELECT entity_num, revision, data, sz AS raw_bytes, volume_id FROM loaded JOIN assigned USING (entity_num)""",
    "store_manifest": f"""WITH loaded AS ({reconcile_sql("true")}),
        {volume_rows(20_000, "SELECT 'Item' AS entity_type, entity_num, octet_length(encode(data)) + 1 AS sz FROM loaded")}
        SELECT volume_id, lo, hi, n AS rows, raw_bytes, last_num FROM volumes""",
    "store_progress": f"""WITH {EVENT}, {CHANGES}, {POSITION},
        p AS (SELECT ch.entity_type, ch.seq, ch.event_ts_ms, {position_text("pos.ms", "reversed_order")} AS j
              FROM ch JOIN pos ON pos.event_id = ch.seq)
        SELECT entity_type, arg_min(j, (event_ts_ms, seq)) AS last_event_id, min(event_ts_ms) AS last_event_ts_ms,
          true AS initialized
        FROM p GROUP BY 1""",
    "store_apply": f"""WITH RECURSIVE
        stored AS (SELECT 'Item' AS entity_type, entity_num, revision AS rev, data AS body FROM ({reconcile_sql("true")})),
        cmd AS (
          SELECT 'Item' AS entity_type, user_id * 101 AS entity_num, event_id AS seq,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 200 AS rev,
            CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CAST(event_id AS VARCHAR) AS body,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
          FROM events),
        {FOLD}
        SELECT entity_num, rev AS revision, body AS data FROM ended""",
    "store_versions": f"""WITH RECURSIVE
        stored AS ({CUSTOMER_BODIES}),
        half AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 2 + 1 AS at FROM events),
        cmd AS (
          SELECT 'Item' AS entity_type, user_id AS entity_num, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rev,
            CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CAST(event_id AS VARCHAR) AS body,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
          FROM events, half WHERE event_id < half.at),
        {FOLD}
        SELECT entity_num, rev AS revision, body AS data FROM ended""",
    "store_progress_of_streams": f"""WITH {EVENT}, {DAMAGED_CHANGES}
        SELECT ty AS entity_type, ty = 'Item' AS initialized, (SELECT max(event_ts_ms) FROM ch) AS last_event_ts_ms, 'feed' AS stream_id
        FROM (VALUES ('Item'), ('Property'), ('Lexeme')) t(ty)""",
    "job_first_load": f"""WITH {EVENT}, {CONTENT}, {FIRST_LOAD}
        SELECT entity_num, rev AS revision, body AS data FROM stored""",
    "job_follow": f"""WITH RECURSIVE {EVENT}, {DAMAGED_CHANGES}, {CONTENT}, {RESOLVED}, {RESOLVED_COMMANDS}, {FIRST_LOAD}, {FOLD}
        SELECT entity_type, entity_num, rev AS revision, body AS data FROM ended""",
    "job_follow_quarantine": f"""WITH {EVENT}
        SELECT 'feed' AS source, CASE WHEN value > 300 THEN 'bad_payload' WHEN event_id % 97 = 0 THEN 'bad_position'
            WHEN value < 0.5 THEN 'unknown_kind' ELSE 'bad_title' END AS reason, count(*) AS records
        FROM ev
        WHERE value > 300 OR (event_type <> 'click' AND (event_id % 97 = 0 OR value < 0.5 OR (kind <> 'log' AND k = 13)))
        GROUP BY ALL""",
    "job_follow_unnumbered": f"""WITH RECURSIVE {EVENT}, {CHANGES}, {CONTENT}, {RESOLVED}, {RESOLVED_COMMANDS}, {FIRST_LOAD}, {FOLD}
        SELECT entity_type, entity_num, rev AS revision, body AS data FROM ended""",
    "job_follow_corrupt": """SELECT 'feed' AS source, '{"seq":' || event_id || ',"data' AS raw, 'bad_record' AS reason
        FROM events WHERE event_id % 50 = 0""",
    "job_resume_load": f"""WITH {EVENT}, {CONTENT}, {FIRST_LOAD}, h AS (SELECT max(entity_num) // 2 AS half FROM stored)
        SELECT entity_num, rev AS revision, body AS data FROM stored, h WHERE entity_num < half
        UNION ALL
        SELECT entity_num, b[1], b[2] || ' ' FROM best, h WHERE entity_num BETWEEN half AND 2 * half + 100""",
    "replay_after_delete": f"""WITH RECURSIVE {SEQ_COMMANDS}, {NO_STATE}, {FOLD} SELECT entity_num, rev AS revision, body AS data FROM ended""",
    "store_dump": f"""WITH RECURSIVE
        stored AS (SELECT 'Item' AS entity_type, entity_num, revision AS rev, data AS body FROM ({reconcile_sql("true")})),
        cmd AS (
          SELECT 'Item' AS entity_type, user_id * 101 AS entity_num, event_id AS seq,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 200 AS rev,
            CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CAST(event_id AS VARCHAR) AS body,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
          FROM events),
        {FOLD}
        SELECT row_number() OVER (ORDER BY entity_num) - 1 AS position, body AS line FROM ended""",
    "stream_merge": f"""WITH RECURSIVE {EVENT}, {CHANGES}, {CONTENT}, {RESOLVED}, {RESOLVED_COMMANDS},
        stored AS (
          SELECT 'Item' AS entity_type, c_custkey AS entity_num, CAST(10 AS BIGINT) AS rev,
            '{{"id":"Q' || c_custkey || '","lastrevid":10,"label":"' || c_name || '"}}' AS body FROM customer),
        {FOLD}
        SELECT entity_type, entity_num, rev AS revision, body AS data FROM ended""",
    "stream_dedupe": f"""WITH {EVENT}
        SELECT event_id AS seq, ms AS event_ts_ms, entity_type, props AS data FROM ev""",
    "stream_rate": f"""WITH {EVENT}, {TYPED_FEED}
        SELECT event_ts_ms // 86400000 * 86400000 AS period_start_ms, entity_type, count(*) AS events,
          CAST(sum(sz) AS BIGINT) AS bytes, count(*) / 86400.0::DOUBLE AS events_per_sec FROM tf GROUP BY 1, 2""",
    "stream_lag": f"""WITH {EVENT}
        SELECT ms // 3600000 * 3600000 AS period_start_ms, count(*) AS events,
          min(CAST(round(value * 1000) AS BIGINT)) AS min_lag_ms, max(CAST(round(value * 1000) AS BIGINT)) AS max_lag_ms
        FROM ev GROUP BY 1""",
}
