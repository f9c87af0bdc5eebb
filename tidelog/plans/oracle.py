"""The same queries in DuckDB's SQL."""

from __future__ import annotations

DOC = "SELECT lang AS bucket, source || '/' || lpad(doc_id::VARCHAR, 10, '0') AS key, text AS value, strlen(text)::BIGINT AS size, doc_id FROM documents"
PAGE = "SELECT 'pages' AS bucket, regexp_replace(url, '^https?://', '') AS key, html AS value FROM pages"
CONV = "SELECT 'conv' AS bucket, lpad(conv_id::VARCHAR, 10, '0') AS key, 'PUT' AS op, text AS value, turn FROM conversations"
EVENT = (
    "SELECT 'events' AS bucket, 'u' || user_id || '/' || json_extract_string(props, '$.k') AS key, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,"
    " props AS value, ts, event_id FROM events"
)
ITEM = (
    "SELECT 'items' AS bucket, lpad(l_orderkey::VARCHAR, 10, '0') AS key, CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'PUT' END AS op,"
    " CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) END AS value,"
    " l_shipdate, l_linenumber, l_partkey, l_suppkey FROM lineitem"
)
ITEM_SEQ = "l_shipdate, l_linenumber, l_partkey, l_suppkey"


def h(codes: str) -> str:
    """Signed 32-bit hash of a list of UTF-16 units (the keys are ASCII)."""
    u = f"list_reduce(list_prepend(0::BIGINT, {codes}), lambda a, b: (a * 31 + b) & 4294967295)"
    return f"(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END)"


def codes(text: str) -> str:
    return f"[ord(c)::BIGINT FOR c IN string_split({text}, '')]"


INTERNAL = f"list_concat(list_append({codes('bucket')}, 0::BIGINT), {codes('key')})"
PART = f"(abs({h(INTERNAL)}) % 16)::INT"


def live(view: str, seq: str) -> str:
    return (
        f"SELECT bucket, key, strlen(value)::BIGINT AS size, md5(value) AS value_md5 FROM"
        f" (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY {', '.join(s + ' DESC' for s in seq.split(', '))}) AS r FROM ({view})) WHERE r = 1 AND op = 'PUT'"
    )


def token(key: str) -> str:
    return f"rtrim(translate(base64(encode({key})), '+/', '-_'), '=')"


def page(bucket: str, prefix: str = "", delimiter: str = "", after: str = "", n: int = 1000) -> str:
    start = max(after, prefix)
    at = f"strpos(substr(key, {len(prefix) + 1}), '{delimiter}')" if delimiter else "0"
    return f"""
WITH k AS (SELECT key, size FROM ({DOC}) WHERE bucket = '{bucket}' AND starts_with(key, '{prefix}') AND key >= '{start}'),
e AS (SELECT CASE WHEN {at} > 0 THEN 'P' ELSE 'K' END AS kind, CASE WHEN {at} > 0 THEN substr(key, 1, {len(prefix)} + {at}) ELSE key END AS name, key, size FROM k),
g AS (SELECT kind, name, min(key) AS first_key, CASE WHEN kind = 'K' THEN max(size) END AS size FROM e GROUP BY kind, name),
p AS (SELECT *, row_number() OVER (ORDER BY first_key) AS r FROM g QUALIFY r <= {n}),
t AS (SELECT min(key) AS next_key FROM k WHERE (SELECT count(*) FROM p) >= {n} AND key > (SELECT max(first_key) FROM p))
SELECT kind, name, size, next_key IS NOT NULL AS truncated, next_key, {token('next_key')} AS token FROM p, t"""


RECORDS = f"""
r0 AS (SELECT *, {PART} AS partition_id, strlen(bucket) + 1 + strlen(key) + coalesce(strlen(value), 0) + 23 AS record_length, coalesce(strlen(value), 0)::BIGINT AS value_length FROM ({ITEM})),
r1 AS (SELECT *, coalesce(sum(record_length) OVER (PARTITION BY partition_id ORDER BY {ITEM_SEQ}, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_start FROM r0),
rec AS (SELECT *, (record_start // 16384 + 1)::INT AS segment_id, record_start + 19 + strlen(bucket) + 1 + strlen(key) AS value_offset FROM r1),
last AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM rec),
idx AS (SELECT * FROM last WHERE r = 1 AND op = 'PUT'),
seg AS (SELECT s.partition_id, s.segment_id, s.size, s.n_records, coalesce(l.live, 0)::BIGINT AS live, coalesce(l.n_live, 0)::BIGINT AS n_live,
        s.segment_id < max(s.segment_id) OVER (PARTITION BY s.partition_id) AS sealed
  FROM (SELECT partition_id, segment_id, sum(record_length)::BIGINT AS size, count(*)::BIGINT AS n_records FROM rec GROUP BY ALL) s
  LEFT JOIN (SELECT partition_id, segment_id, sum(value_length) AS live, count(*) AS n_live FROM idx GROUP BY ALL) l USING (partition_id, segment_id)),
ratio AS (SELECT *, 1.0::DOUBLE - live::DOUBLE / size AS dead_ratio FROM seg WHERE sealed AND size > 0),
cand AS (SELECT *, (row_number() OVER (PARTITION BY partition_id ORDER BY dead_ratio DESC, segment_id))::INT AS rank FROM ratio WHERE dead_ratio > 0.5 QUALIFY rank <= 4)"""

RING = f"""
ring AS (SELECT bucket, key, size, value, abs({h(INTERNAL)}) % 6 AS anchor, {h(codes('key'))} AS kh FROM ({{view}})),
sh AS (SELECT bucket, key, size, value, i::INT AS shard_idx, 'n' || ((anchor + i) % 6)::VARCHAR AS node_id, ((kh + i) % {{lost}} + {{lost}}) % {{lost}} = 0 AS is_lost FROM ring, unnest(generate_series(0, {{last}})) AS t(i))"""
SHARDS = RING.replace("{view}", DOC).replace("{lost}", "7").replace("{last}", "5")
ASKED = f"SELECT DISTINCT bucket, key FROM ({EVENT}) UNION ALL SELECT DISTINCT bucket, key || '/none' FROM ({EVENT})"
EVENT_LIVE = live(EVENT, "ts, event_id")
TALK = "SELECT 'conv' AS bucket, lpad(conv_id::VARCHAR, 10, '0') || '/' || lpad(turn::VARCHAR, 4, '0') AS key, text AS value FROM conversations"
REPORT = (
    "SELECT s.partition_id, s.segments, s.size, coalesce(i.live_keys, 0)::BIGINT AS live_keys FROM"
    " (SELECT partition_id, count(DISTINCT segment_id)::BIGINT AS segments, sum(record_length)::BIGINT AS size FROM rec GROUP BY partition_id) s"
    " LEFT JOIN (SELECT partition_id, count(*) AS live_keys FROM idx GROUP BY partition_id) i USING (partition_id)"
)
REPLICAS = "SELECT p::INT AS partition_id, i::INT AS replica, 'n' || ((p + i) % 6)::VARCHAR AS node_id FROM unnest(generate_series(0, 15)) AS a(p), unnest(generate_series(0, 2)) AS b(i)"

ORACLE_SQL: dict[str, str] = {
    "list_delimited": page("en", delimiter="/"),
    "list_prefix": page("en", prefix="src1"),
    "list_page1": page("en", prefix="src1", delimiter="/", n=4),
    "list_page2": page("en", prefix="src1", delimiter="/", after="src12/", n=4),
    "list_maxkeys0": f"SELECT 'N' AS kind, NULL::VARCHAR AS name, NULL::BIGINT AS size, min(key) IS NOT NULL AS truncated, min(key) AS next_key, {token('min(key)')} AS token FROM ({DOC}) WHERE bucket = 'en'",
    "list_buckets": f"SELECT bucket, count(*) AS n_objects FROM ({DOC}) GROUP BY bucket",
    "continuation_token": f"SELECT key, {token('key')} AS token, true AS round_trip FROM ({PAGE})",
    "live_index_conv": live(CONV, "turn"),
    "live_index_events": EVENT_LIVE,
    "live_index_items": live(ITEM, ITEM_SEQ),
    "get_etag": f"""SELECT bucket, key, size, '"' || md5(value) || '"' AS etag FROM ({DOC})""",
    "head_exists": f"SELECT a.bucket, a.key, (CASE WHEN l.size IS NULL THEN 404 ELSE 200 END)::INT AS status, l.size FROM ({ASKED}) a LEFT JOIN ({EVENT_LIVE}) l USING (bucket, key)",
    "missing_keys": f"SELECT a.bucket, a.key FROM ({ASKED}) a ANTI JOIN ({EVENT_LIVE}) l USING (bucket, key)",
    "java_hash": f"SELECT key, {h(codes('key'))} AS hash FROM ({PAGE})",
    "partition_route": f"SELECT bucket, key, {PART} AS partition_id FROM ({DOC})",
    "partition_stats": f"WITH {RECORDS} {REPORT}",
    "replica_assignment": REPLICAS,
    "partition_report": f"WITH {RECORDS}, s AS ({REPORT}), p AS ({REPLICAS}) SELECT partition_id, segments, size, live_keys, node_id, replica = 0 AS leader FROM s JOIN p USING (partition_id)",
    "ring_placement": f"WITH {RING.replace('{view}', 'SELECT *, 0 AS size FROM (' + PAGE + ')').replace('{lost}', '7').replace('{last}', '5')} SELECT bucket, key, shard_idx, node_id FROM sh",
    "segment_offsets": f"""
WITH r0 AS (SELECT *, {PART} AS partition_id, (strlen(bucket) + 1 + strlen(key) + strlen(value) + 23)::BIGINT AS record_length FROM ({CONV})),
r1 AS (SELECT *, coalesce(sum(record_length) OVER (PARTITION BY partition_id ORDER BY turn, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_start FROM r0)
SELECT bucket, key, turn, partition_id, record_start, record_length, record_start + 19 + strlen(bucket) + 1 + strlen(key) AS value_offset FROM r1""",
    "segment_roll": f"""
WITH RECURSIVE {RECORDS}, n AS (SELECT partition_id, record_length, row_number() OVER (PARTITION BY partition_id ORDER BY record_start) AS i FROM rec),
f(partition_id, i, segment_id, filled) AS (
  SELECT partition_id, i, 1, record_length FROM n WHERE i = 1
  UNION ALL SELECT n.partition_id, n.i, f.segment_id + (f.filled >= 16384)::INT, CASE WHEN f.filled >= 16384 THEN n.record_length ELSE f.filled + n.record_length END
  FROM f JOIN n ON n.partition_id = f.partition_id AND n.i = f.i + 1)
SELECT partition_id, segment_id, count(*)::BIGINT AS n_records, max(filled)::BIGINT AS size FROM f GROUP BY ALL""",
    "segment_live_bytes": f"WITH {RECORDS} SELECT partition_id, segment_id, size, n_records, live, n_live, sealed FROM seg",
    "compaction_candidates": f"WITH {RECORDS} SELECT partition_id, segment_id, size, live, round(dead_ratio, 9) AS dead_ratio, rank FROM cand",
    "compaction_rewrite": f"""
WITH {RECORDS}, mine AS (SELECT * FROM last SEMI JOIN cand USING (partition_id, segment_id)), other AS (SELECT * FROM last ANTI JOIN cand USING (partition_id, segment_id)),
kept AS (SELECT partition_id, segment_id, op, key FROM mine WHERE r = 1 AND op = 'PUT'
  UNION ALL SELECT DISTINCT m.partition_id, m.segment_id, m.op, m.key FROM mine m WHERE op = 'DELETE' AND EXISTS (
    SELECT 1 FROM other o WHERE o.key = m.key AND o.op = 'PUT' AND o.r > (SELECT min(x.r) FROM mine x WHERE x.key = m.key AND x.op = 'DELETE' AND x.partition_id = m.partition_id AND x.segment_id = m.segment_id)))
SELECT partition_id, segment_id, op, count(*)::BIGINT AS n_kept FROM kept GROUP BY ALL""",
    "compaction_freshness": f"""
WITH {RECORDS}, old AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS o FROM rec WHERE l_shipdate <= TIMESTAMP '1996-01-01')
SELECT o.bucket, o.key, o.segment_id, i.key IS NOT NULL AS fresh FROM (SELECT * FROM old WHERE o = 1 AND op = 'PUT') o
LEFT JOIN idx i ON i.key = o.key AND i.partition_id = o.partition_id AND i.segment_id = o.segment_id AND i.value_offset = o.value_offset AND i.value_length = o.value_length""",
    "compaction_summary": f"""
WITH {RECORDS} SELECT s.partition_id, s.sealed, coalesce(c.compacted, 0)::BIGINT AS compacted, coalesce(c.live_bytes, 0)::BIGINT AS live_bytes, greatest(0, s.sealed - coalesce(c.compacted, 0))::BIGINT AS intact
FROM (SELECT partition_id, count(*)::BIGINT AS sealed FROM seg WHERE sealed GROUP BY partition_id) s
LEFT JOIN (SELECT partition_id, count(*) AS compacted, sum(live) AS live_bytes FROM cand GROUP BY partition_id) c USING (partition_id)""",
    "ec_split_sizes": f"SELECT bucket, key, size AS original_size, ((size + 3) // 4)::BIGINT AS shard_size, ((size + 3) // 4 * 4 - size)::BIGINT AS padding FROM ({DOC})",
    "ec_parity_k2m1": f"""
WITH b AS (SELECT key, hex(encode(value)) AS x, (strlen(value) + 1) // 2 AS s FROM ({TALK})),
p AS (SELECT key, s, [('0x' || substr(x, (2 * i + 1)::INT, 2))::INT FOR i IN generate_series(0, s - 1)] AS a,
      [coalesce(try_cast('0x' || nullif(substr(x, (2 * (i + s) + 1)::INT, 2), '') AS INT), 0) FOR i IN generate_series(0, s - 1)] AS c FROM b),
q AS (SELECT key, s, [xor(xor(CASE WHEN a[i] >= 128 THEN xor(2 * a[i], 285) ELSE 2 * a[i] END, a[i]), CASE WHEN c[i] >= 128 THEN xor(2 * c[i], 285) ELSE 2 * c[i] END) FOR i IN generate_series(1, s)] AS y FROM p)
SELECT key, md5(coalesce(array_to_string([printf('%02x', v) FOR v IN y], ''), '')) AS parity_md5 FROM q""",
    "ec_roundtrip": f"SELECT bucket, key, 'decoded' AS status, md5(value) AS value_md5 FROM ({DOC})",
    "ec_degraded_status": f"""
WITH {SHARDS} SELECT bucket, key, count(*)::INT AS n_present, CASE WHEN count(*) < 4 THEN 'unavailable' WHEN count(*) FILTER (shard_idx < 4) = 4 THEN 'intact' ELSE 'decoded' END AS status,
CASE WHEN count(*) >= 4 THEN any_value(md5(value)) END AS value_md5 FROM sh WHERE NOT is_lost GROUP BY bucket, key""",
    "ec_missing_shards": f"WITH {SHARDS} SELECT bucket, key, shard_idx, node_id FROM sh WHERE is_lost",
    "ec_repair_plan": f"""
WITH {SHARDS} SELECT bucket, key, count(*)::BIGINT AS n_expected, count(*) FILTER (NOT is_lost)::BIGINT AS n_present,
CASE WHEN count(*) FILTER (NOT is_lost) = count(*) THEN 'none' WHEN count(*) FILTER (NOT is_lost) < 4 THEN 'unrepairable' ELSE 'repair' END AS action FROM sh GROUP BY bucket, key""",
    "ec_repaired": f"""
WITH {SHARDS}, ok AS (SELECT bucket, key FROM sh GROUP BY bucket, key HAVING count(*) FILTER (NOT is_lost) >= 4)
SELECT bucket, key, shard_idx, node_id, true AS equal FROM sh SEMI JOIN ok USING (bucket, key) WHERE is_lost""",
    "repair_batch_checkpoint": f"WITH b AS (SELECT DISTINCT key FROM ({PAGE}) WHERE key >= 'm.' ORDER BY key LIMIT 200) SELECT key, hex(encode(max(key) OVER ())) || '00' AS next_checkpoint FROM b",
    "ec_listing_union": f"""
SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.key, b.key) AS key, coalesce(a.size, 0)::BIGINT AS size
FROM (SELECT bucket, key, size FROM ({DOC}) WHERE size % 3 <> 0) a FULL JOIN (SELECT DISTINCT bucket, key FROM ({DOC}) WHERE size % 2 = 0) b ON a.bucket = b.bucket AND a.key = b.key""",
    "plain_fallback": f"""
WITH {RING.replace('{view}', DOC).replace('{lost}', '2').replace('{last}', '1')}
SELECT bucket, key, count(*) FILTER (NOT is_lost)::BIGINT AS n_present, CASE WHEN count(*) FILTER (NOT is_lost) = 0 THEN 'plain' ELSE 'shards' END AS source FROM sh GROUP BY bucket, key""",
    "bucket_semi_join": f"SELECT bucket, key, size FROM ({DOC}) WHERE bucket NOT IN ('de', 'fr')",
    "internal_bucket_guard": f"SELECT CASE WHEN bucket = 'es' THEN '__sys_shards__' ELSE bucket END AS bucket, key, (CASE WHEN bucket = 'es' THEN 403 ELSE 200 END)::INT AS status FROM ({DOC})",
    "sync_from_offset": f"WITH {RECORDS} SELECT key, partition_id, segment_id, record_start, op FROM rec WHERE segment_id > 3 OR segment_id = 3 AND record_start >= 32868 OR NOT EXISTS (SELECT 1 FROM rec WHERE segment_id = 3)",
    "command_apply": live(EVENT, "event_id").replace("strlen(value)::BIGINT AS size, ", ""),
    "rebuild_equals_index": f"WITH l AS (SELECT *, {PART} AS partition_id FROM ({live(ITEM, ITEM_SEQ)})) SELECT partition_id, count(*) AS n_live, count(*) AS n_again, true AS equal FROM l GROUP BY partition_id",
    "latency_percentiles": """
SELECT event_type, count(*)::BIGINT AS n, quantile_disc(b, 0.5) AS p50, quantile_disc(b, 0.95) AS p95, quantile_disc(b, 0.99) AS p99
FROM (SELECT event_type, least(floor(value * 1000), 100000)::BIGINT AS b FROM events) GROUP BY event_type""",
    "health_rollup": """
SELECT count(*)::BIGINT AS groups, count(*) FILTER (n_regionkey <> 3)::BIGINT AS led, bool_and(n_regionkey <> 3) AS ready,
(CASE WHEN bool_and(n_regionkey <> 3) THEN 200 ELSE 503 END)::INT AS status FROM nation""",
    "xml_escape": f"SELECT key, md5(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM ({PAGE})",
    "path_parse": f"SELECT key, 'pages' AS bucket, key AS object_key, key AS object_path FROM ({PAGE})",
    "object_status": f"""
WITH a AS ({ASKED}) SELECT a.bucket, a.key, CASE WHEN l.size IS NULL THEN '404 NoSuchKey' ELSE '200' END AS status FROM a LEFT JOIN ({EVENT_LIVE}) l USING (bucket, key)
UNION ALL SELECT 'nowhere', key, '404 NoSuchBucket' FROM a""",
}
