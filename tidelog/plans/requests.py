"""Registered queries of requests, segment files, shards, repair and recovery, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog import sources as src
from tidelog import streaming
from tidelog.operators import cluster, compaction, erasure, listing, log, store
from tidelog.plans import oracle as o
from tidelog.plans import queries as q
from tidelog.sources import segments
from tidelog.work import saved, spread, work_dir

SHARD_BUCKET = "__sys_shards__"
#: Namespace of the example's consensus groups.
NAMESPACE = "0f0e0d0c-0b0a-0908-0706-050403020100"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def item_images(spark, d):
    """The lineitem log as written segments, and its records."""
    records = q.items(spark, d, values=True)
    return segments.images(records), records.drop("value")


IN_FILE = "record_start - min(record_start) OVER (PARTITION BY partition_id, segment_id)"


@query(f"WITH {o.RECORDS} SELECT partition_id, segment_id, 'segment-' || lpad(segment_id::VARCHAR, 10, '0') || '.log' AS name, segment_id AS number, count(*) AS n_records, sum(record_length)::BIGINT AS n_bytes FROM rec GROUP BY partition_id, segment_id")
def segment_write(spark, d):
    files = item_images(spark, d)[0]
    return files.select("partition_id", "segment_id", "name", fn.segment_number(F.concat("name", F.lit(".compact"))).alias("number"), "n_records", F.octet_length("content").cast("bigint").alias("n_bytes"))


SCANNED = f"WITH {o.RECORDS} SELECT partition_id, segment_id, ({IN_FILE})::BIGINT AS record_start, (op = 'DELETE')::INT AS flags, bucket, key, md5(coalesce(value, '')) AS value_md5 FROM rec"


@query(SCANNED)
def segment_scan(spark, d):
    """Records read back from written segments, strictly."""
    return segments.read_images(item_images(spark, d)[0]).select("partition_id", "segment_id", "record_start", "flags", "bucket", "key", F.md5("value").alias("value_md5"))


@query(SCANNED + " QUALIFY record_start <> max(record_start) OVER (PARTITION BY partition_id, segment_id)")
def segment_scan_cut(spark, d):
    """Segments cut ten bytes before their end, read leniently: all but the last record."""
    files = item_images(spark, d)[0]
    files = files.withColumn("content", F.substring("content", F.lit(1), F.octet_length("content") - 10))
    return segments.read_images(files, drop_tail=True).select("partition_id", "segment_id", "record_start", "flags", "bucket", "key", F.md5("value").alias("value_md5"))


WANTED = f"SELECT DISTINCT bucket, key FROM ({o.ITEM}) UNION ALL SELECT DISTINCT bucket, key || '/none' FROM ({o.ITEM})"


@query(f"""
SELECT a.bucket, a.key, (CASE WHEN l.key IS NULL THEN 404 ELSE 200 END)::INT AS status, l.size, '"' || l.value_md5 || '"' AS etag, CASE WHEN l.key IS NOT NULL THEN true END AS verified
FROM ({WANTED}) a LEFT JOIN ({o.live(o.ITEM, o.ITEM_SEQ)}) l USING (bucket, key)""")
def get_object(spark, d):
    """Every key that ever was, and as many that never were, read through the index from written segments."""
    files, records = item_images(spark, d)
    first = records.groupBy("partition_id", "segment_id").agg(F.min("record_start").alias("first"))
    # a key's records are in one partition, whose segments grow along with record_start
    keys = saved(records.groupBy("bucket", "key").agg(*[F.max(c).alias(c) for c in ("partition_id", "segment_id")], F.max("record_start").alias("at"), F.max_by(F.col("op") == "PUT", "record_start").alias("live")), "keys")
    index = keys.where("live").join(first, ["partition_id", "segment_id"]).withColumn("record_start", F.col("at") - F.col("first"))
    real = keys.select("bucket", "key")
    asked = real.unionByName(real.withColumn("key", F.concat("key", F.lit("/none"))))
    return store.get(asked, index, segments.read_images(files)).drop("value")


@query(f"""
WITH {o.RECORDS}, old AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS o FROM rec WHERE l_shipdate <= TIMESTAMP '1996-01-01')
SELECT o.partition_id, count(i.key)::BIGINT AS kept, (count(*) - count(i.key))::BIGINT AS skipped, sum(o.value_length)::BIGINT AS live_bytes FROM (SELECT * FROM old WHERE o = 1 AND op = 'PUT') o
LEFT JOIN idx i ON i.key = o.key AND i.partition_id = o.partition_id AND i.value_offset = o.value_offset GROUP BY o.partition_id""")
def compaction_stats(spark, d):
    return compaction.stats(q.moved_since_1996(spark, d), "partition_id")


@query(f"""
WITH {o.RECORDS}, l AS (SELECT partition_id, segment_id, sum(record_length) AS live_size FROM idx GROUP BY ALL)
SELECT s.partition_id, s.segment_id, s.size, coalesce(l.live_size, 0)::BIGINT AS live_size, round(1.0::DOUBLE - coalesce(l.live_size, 0)::DOUBLE / s.size, 9) AS dead_ratio FROM seg s LEFT JOIN l USING (partition_id, segment_id)""")
def dead_ratio_exact(spark, d):
    return compaction.exact_ratio(q.items(spark, d)).withColumn("dead_ratio", F.round("dead_ratio", 9))


@query(f"WITH {o.RECORDS} SELECT partition_id, segment_id, n_live > 0 AS referenced FROM seg")
def segment_membership(spark, d):
    records = q.items(spark, d)
    return compaction.referenced(records.select("partition_id", "segment_id").distinct(), compaction.index_of(records))


@query(o.live(o.ITEM, o.ITEM_SEQ))
def rebuild_compacted(spark, d):
    """The live index rebuilt from the segments that a compaction has written."""
    records = q.items(spark, d, values=True)
    back = segments.read_images(segments.images(compaction.compacted(records)))
    back = back.select("bucket", "key", F.when(F.col("flags") == 1, "DELETE").otherwise("PUT").alias("op"), "value", F.struct("partition_id", "segment_id", "record_start").alias("seq"))
    return log.live_index(back, {"size": F.octet_length("value").cast("bigint"), "value_md5": F.md5("value")})


@query(f"SELECT event_id, key, op = 'PUT' OR coalesce(lag(op) OVER (PARTITION BY bucket, key ORDER BY ts, event_id) = 'PUT', false) AS written FROM ({o.EVENT})")
def delete_noop(spark, d):
    return store.writes(src.event_log(spark, d)).select(F.col("seq.event_id").alias("event_id"), "key", "written")


@query(f"""
WITH a AS ({o.ASKED}), r AS (SELECT unnest(['GET', 'HEAD', 'PUT', 'DELETE']) AS method, b AS bucket, key FROM a, (VALUES ('events'), ('nowhere'), ('__sys_x')) v(b)), l AS ({o.EVENT_LIVE}),
c AS (SELECT r.*, CASE WHEN r.bucket = '__sys_x' THEN 'AccessDenied' WHEN r.bucket = 'nowhere' THEN 'NoSuchBucket' WHEN method IN ('GET', 'HEAD') AND l.key IS NULL THEN 'NoSuchKey' END AS code FROM r LEFT JOIN l USING (bucket, key))
SELECT method, bucket, key, (CASE code WHEN 'AccessDenied' THEN 403 WHEN 'NoSuchBucket' THEN 404 WHEN 'NoSuchKey' THEN 404 ELSE CASE method WHEN 'DELETE' THEN 204 ELSE 200 END END)::INT AS status, code FROM c""")
def request_status(spark, d):
    """Every method on every key asked for, in a bucket that exists, one that doesn't and an internal one."""
    methods = F.explode(F.array(*[F.lit(m) for m in ("GET", "HEAD", "PUT", "DELETE")]))
    buckets = F.explode(F.array(*[F.lit(b) for b in ("events", "nowhere", "__sys_x")]))
    asked = q._asked(spark, d).select(methods.alias("method"), "key").select("method", "key", buckets.alias("bucket"))
    live = q.live_index_events(spark, d)
    return store.statuses(asked, live, live.select("bucket"))


REGISTRY = "SELECT event_id, 'b' || user_id AS bucket, CASE WHEN event_type IN ('error', 'click') THEN 'DELETE' ELSE 'CREATE' END AS op FROM events"


def _registry_commands(spark, d):
    op = F.when(F.col("event_type").isin("error", "click"), "DELETE").otherwise("CREATE")
    return src.table(spark, d, "events").select(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("bucket"), op.alias("op"), F.col("event_id").alias("seq"))


@query(f"""
SELECT event_id, bucket, op, (CASE WHEN op = 'CREATE' THEN 200 WHEN lag(op) OVER (PARTITION BY bucket ORDER BY event_id) = 'CREATE' THEN 204 ELSE 404 END)::INT AS status FROM ({REGISTRY})""")
def bucket_commands(spark, d):
    return store.bucket_commands(_registry_commands(spark, d)).withColumnRenamed("seq", "event_id")


@query(f"""
WITH c AS ({REGISTRY}), g AS (SELECT bucket, max(event_id) AS gone FROM c WHERE op = 'DELETE' GROUP BY bucket)
SELECT c.bucket, min(c.event_id) AS created FROM c LEFT JOIN g USING (bucket) WHERE c.op = 'CREATE' AND (g.gone IS NULL OR c.event_id > g.gone) GROUP BY c.bucket""")
def bucket_registry(spark, d):
    return store.registry(_registry_commands(spark, d))


HEX = "upper(hex(encode({})))"


def _be(n: str, digits: int) -> str:
    return f"upper(printf('%0{digits}x', ({n})::BIGINT))"


@query(f"""
WITH c AS (SELECT event_id, bucket, key, op, CASE WHEN op = 'PUT' THEN value END AS value FROM ({o.EVENT}))
SELECT event_id, md5(unhex(CASE op WHEN 'PUT' THEN '01' ELSE '02' END || {_be('strlen(bucket)', 4)} || {HEX.format('bucket')} || {_be('strlen(key)', 4)} || {HEX.format('key')} ||
  CASE WHEN op = 'PUT' THEN {_be('strlen(value)', 16)} || {HEX.format('value')} ELSE '' END)) AS command_md5, bucket, key, op AS kind, md5(value) AS value_md5 FROM c""")
def command_codec(spark, d):
    """Commands in binary, and what they decode to."""
    raw = src.event_log(spark, d).select(F.col("seq.event_id").alias("event_id"), fn.encode_command(F.col("op"), F.col("bucket"), F.col("key"), F.col("value")).alias("raw"))
    back = raw.withColumn("c", fn.decode_command(F.col("raw")))
    return back.select("event_id", F.md5("raw").alias("command_md5"), "c.bucket", "c.key", "c.kind", F.md5("c.value").alias("value_md5"))


ROUTED = f"SELECT event_id, bucket, key, CASE WHEN event_id % 7 = 0 THEN -1 ELSE {o.PART} END AS grp FROM ({o.EVENT})"


@query(f"WITH r AS ({ROUTED}) SELECT event_id, grp, '0f0e0d0c-0b0a-0908-' || CASE WHEN grp = -1 THEN 'ffff-ffffffffffff' ELSE '0000-' || printf('%012x', grp) END AS group_id FROM r")
def command_routing(spark, d):
    """The consensus group of each command; every seventh is one on its bucket."""
    rows = src.event_log(spark, d).select(F.col("seq.event_id").alias("event_id"), "bucket", "key", F.when(F.col("seq.event_id") % 7 == 0, "DELETE_BUCKET").otherwise("PUT").alias("kind"))
    rows = rows.select("event_id", fn.command_group(F.col("kind"), F.col("bucket"), F.col("key")).alias("grp"))
    return rows.select("event_id", "grp", fn.group_id(F.lit(NAMESPACE), F.col("grp")).alias("group_id"))


@query("SELECT g::INT AS grp FROM unnest(generate_series(-1, 15)) t(g) WHERE g NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)")
def groups_to_add(spark, d):
    wanted = spark.range(-1, 16).select(F.col("id").cast("int").alias("grp"))
    return cluster.groups_to_add(wanted, src.table(spark, d, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").cast("int").alias("grp")))


@query(f"SELECT key, key AS stripped, 'pages' AS object_bucket, key AS object_key FROM ({o.PAGE})")
def key_parts(spark, d):
    """The user's key of an internal key, and the parts of an object's path."""
    path = fn.object_parts(F.concat_ws("/", "bucket", "key"))
    stripped = fn.user_key(fn.internal_key(F.col("bucket"), F.col("key")))
    return src.page_objects(spark, d).select("key", stripped.alias("stripped"), path["bucket"].alias("object_bucket"), path["key"].alias("object_key"))


@query(f"SELECT key, strlen(value) + 8 AS n_bytes, CASE WHEN key NOT LIKE '%1' THEN strlen(value)::BIGINT END AS original_size, CASE WHEN key NOT LIKE '%1' THEN md5(value) END AS data_md5 FROM ({o.TALK})")
def shard_payload(spark, d):
    """Stored shards with their header; those cut under eight bytes (every key that ends in 1) count as missing."""
    rows = q._talks(spark, d).withColumn("payload", fn.shard_payload(F.octet_length("value"), F.col("value").cast("binary")))
    rows = rows.withColumn("stored", F.when(F.col("key").endswith("1"), F.substring("payload", F.lit(1), F.lit(7))).otherwise(F.col("payload")))
    return rows.select("key", F.octet_length("payload").cast("bigint").alias("n_bytes"), fn.payload_size(F.col("stored")).alias("original_size"), F.md5(fn.payload_data(F.col("stored"))).alias("data_md5"))


#: Shards of the documents under a failure pattern that leaves between two and six of each.
BROKEN = f"""
ring AS (SELECT bucket, key, size, value, doc_id, abs({o.h(o.INTERNAL)}) % 6 AS anchor, {o.h(o.codes('key'))} AS kh, 2 + size % 4 AS f FROM ({o.DOC})),
sh AS (SELECT bucket, key, size, value, doc_id, i::INT AS shard_idx, 'n' || ((anchor + i) % 6)::VARCHAR AS node_id FROM ring, unnest(generate_series(0, 5)) t(i) WHERE size % 3 <> 0 AND ((kh + i) % f + f) % f <> 0)"""


def _objects(spark, d):
    return src.doc_objects(spark, d).withColumn("size", F.octet_length("value").cast("bigint"))


def _broken(spark, d):
    """Payloads of shards (bucket, key, shard_idx, payload); objects of a size divisible by three have none."""
    objects = spread(_objects(spark, d).where("size % 3 <> 0"))
    made = erasure.shards_of(objects, q.K, q.M)
    made = made.where(F.pmod(fn.java_hash(F.col("key")) + F.col("shard_idx"), 2 + F.col("original_size") % 4) != 0)
    return made.select("bucket", "key", "shard_idx", fn.shard_payload(F.col("original_size"), F.col("data")).alias("payload"))


def _plain(spark, d):
    return _objects(spark, d).where("size % 6 <> 0").select("bucket", "key", "value")


@query(f"""
WITH {BROKEN}, n AS (SELECT bucket, key, count(*) AS n FROM sh GROUP BY bucket, key)
SELECT bucket, key, (CASE WHEN n >= 4 THEN 200 WHEN n > 0 THEN 503 WHEN size % 6 <> 0 THEN 200 ELSE 404 END)::INT AS status, CASE WHEN n > 0 THEN 'shards' WHEN size % 6 <> 0 THEN 'plain' END AS source,
coalesce(n, 0)::INT AS n_present, CASE WHEN n >= 4 OR n IS NULL AND size % 6 <> 0 THEN md5(value) END AS value_md5 FROM ({o.DOC}) LEFT JOIN n USING (bucket, key)""")
def ec_get(spark, d):
    """Every document by its shards, else its plain copy, else not at all."""
    asked = src.doc_objects(spark, d).select("bucket", "key")
    return erasure.get(asked, _broken(spark, d), _plain(spark, d), q.K, q.M).select("bucket", "key", "status", "source", "n_present", F.md5("value").alias("value_md5"))


@query(f"""
WITH {BROKEN}, n AS (SELECT bucket, key, count(*) AS n FROM sh GROUP BY bucket, key)
SELECT bucket, key, (CASE WHEN n > 0 OR size % 6 <> 0 THEN 200 ELSE 404 END)::INT AS status, CASE WHEN n > 0 OR size % 6 <> 0 THEN size END AS size FROM ({o.DOC}) LEFT JOIN n USING (bucket, key)""")
def ec_head(spark, d):
    return erasure.head(src.doc_objects(spark, d).select("bucket", "key"), _broken(spark, d), _plain(spark, d))


@query(f"WITH {BROKEN} SELECT bucket, key, shard_idx FROM sh WHERE doc_id % 5 <> 0 UNION ALL SELECT bucket, key, -1 AS shard_idx FROM ({o.DOC}) WHERE size % 6 <> 0 AND doc_id % 5 <> 0")
def ec_delete(spark, d):
    """What is left, shards and plain copies (-1), after a DELETE of every fifth document."""
    gone = src.doc_objects(spark, d).where("seq.doc_id % 5 = 0").select("bucket", "key")
    stored = _broken(spark, d).select("bucket", "key", "shard_idx").unionByName(_plain(spark, d).select("bucket", "key", F.lit(-1).alias("shard_idx")))
    return erasure.without(stored, gone)


@query(f"WITH {o.SHARDS} SELECT bucket, key, count(*)::BIGINT AS n_acked, (CASE WHEN count(*) = 6 THEN 200 ELSE 500 END)::INT AS status FROM sh WHERE NOT is_lost GROUP BY bucket, key")
def ec_put_status(spark, d):
    return erasure.put_statuses(q._placed(spark, d).where("not is_lost"), q.K + q.M)


@query(f"""
WITH {BROKEN}, p AS (SELECT bucket, key, size, (anchor + i) % 6 AS node, i::INT AS shard_idx FROM ring, unnest(generate_series(0, 5)) t(i)),
a AS (SELECT bucket, key, size, shard_idx, 'n' || node AS node_id FROM p UNION ALL SELECT bucket, key, size, shard_idx, 'n' || (node + 1) % 6 FROM p)
SELECT a.node_id, a.bucket, a.key, a.shard_idx, (CASE WHEN s.key IS NULL THEN 404 ELSE 200 END)::INT AS status, CASE WHEN s.key IS NOT NULL THEN 8 + (a.size + 3) // 4 END::BIGINT AS n_bytes
FROM a LEFT JOIN sh s USING (node_id, bucket, key, shard_idx)""")
def shard_requests(spark, d):
    """Every shard asked of the node that should have it and of the next one."""
    placed = erasure.placed(src.doc_objects(spark, d), q.NODES, q.K + q.M)
    stored = _broken(spark, d).join(placed, ["bucket", "key", "shard_idx"])
    after = F.concat(F.lit("n"), ((F.substring("node_id", 2, 9).cast("int") + 1) % len(q.NODES)).cast("string"))
    return erasure.shard_requests(placed.unionByName(placed.withColumn("node_id", after)), stored)


SHARD_KEYS = "SELECT '__sys_shards__' AS bucket, bucket || '/' || key || '/' || lpad(shard_idx::VARCHAR, 2, '0') AS key, bucket || '/' || key AS object FROM sh WHERE NOT is_lost"


@query(f"WITH {o.SHARDS} SELECT DISTINCT object AS object_path FROM ({SHARD_KEYS})")
def shard_objects(spark, d):
    present = q._placed(spark, d).where("not is_lost")
    return present.select(fn.object_of_shard(fn.shard_key(F.col("bucket"), F.col("key"), F.col("shard_idx"))).alias("object_path")).distinct()


@query(f"""
WITH {o.SHARDS}, k AS (SELECT *, {o.PART} AS partition_id FROM ({SHARD_KEYS})), b AS (SELECT *, (row_number() OVER (PARTITION BY partition_id ORDER BY key) - 1) // 200 AS batch FROM k),
plan AS (SELECT bucket || '/' || key AS object, count(*) FILTER (NOT is_lost) AS n FROM sh GROUP BY 1),
c AS (SELECT DISTINCT partition_id, batch, object, n FROM b JOIN plan USING (object))
SELECT partition_id, batch::BIGINT AS batch, count(*)::BIGINT AS n_checked, count(*) FILTER (n = 6)::BIGINT AS n_intact, count(*) FILTER (n BETWEEN 4 AND 5)::BIGINT AS n_healed, count(*) FILTER (n < 4)::BIGINT AS n_unrepairable,
any_value(p.checkpoint) AS checkpoint FROM c JOIN (SELECT partition_id, batch, hex(encode(max(key))) || '00' AS checkpoint FROM b GROUP BY ALL) p USING (partition_id, batch) GROUP BY partition_id, batch""")
def repair_batches(spark, d):
    expected = q._placed(spark, d)
    out = erasure.repair_batches(expected.drop("is_lost"), expected.where("not is_lost"), q.K, SHARD_BUCKET)
    return out.withColumn("checkpoint", F.hex(F.encode("checkpoint", "UTF-8")))


@query("""
WITH t AS (SELECT event_type, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY event_type)
SELECT event_type, n, round(us / 1e6, 6) AS seconds, round(n / (us / 1e6), 9) AS per_second FROM t""")
def throughput(spark, d):
    out = cluster.throughput(src.table(spark, d, "events"), "event_type", "ts")
    return out.select("event_type", "n", F.round("seconds", 6).alias("seconds"), F.round("per_second", 9).alias("per_second"))


@query(f"SELECT partition_id, node_id, 'http://host-' || node_id || ':9000' AS address FROM ({o.REPLICAS}) WHERE replica = 0")
def leader_address(spark, d):
    nodes = spark.createDataFrame([(n, f"host-{n}", 9000) for n in q.NODES], "node_id string, host string, http_port int")
    return cluster.leader_addresses(q.replica_assignment(spark, d), nodes)


@query("""
SELECT 'ec' AS mode, (CASE WHEN bool_and(n_regionkey <> 3) THEN 200 ELSE 503 END)::INT AS status,
'{"nodeId":"n0","mode":"ec","status":"' || CASE WHEN bool_and(n_regionkey <> 3) THEN 'ok' ELSE 'degraded' END || '","peers":6,"partitions":16,"ec":{"k":4,"m":2}}' AS json FROM nation
UNION ALL SELECT 'standalone', 200, '{"nodeId":"n0","mode":"standalone","status":"ok","partitions":16}'""")
def health_report(spark, d):
    groups = src.table(spark, d, "nation").select((F.col("n_regionkey") != 3).alias("has_leader"))
    return cluster.health_report(groups, "n0", len(q.NODES), 16, q.K, q.M).unionByName(cluster.health_report(groups, "n0", 0, 16))


def _xml_sql() -> str:
    esc = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""
WITH page AS ({o.page('en', prefix='src1', delimiter='/', n=4)})
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">' || chr(10) || '  <Name>en</Name>' || chr(10) || '  <Prefix>src1</Prefix>' || chr(10)
 || '  <Delimiter>/</Delimiter>' || chr(10) || '  <MaxKeys>4</MaxKeys>' || chr(10) || '  <IsTruncated>' || bool_or(truncated) || '</IsTruncated>' || chr(10) || '  <KeyCount>' || count(*) || '</KeyCount>' || chr(10)
 || CASE WHEN bool_or(truncated) THEN '  <NextContinuationToken>' || max(token) || '</NextContinuationToken>' || chr(10) ELSE '' END
 || coalesce(string_agg('  <Contents>' || chr(10) || '    <Key>' || {esc.format('name')} || '</Key>' || chr(10) || '    <LastModified>2024-01-01T00:00:00.000Z</LastModified>' || chr(10) || '    <ETag>""</ETag>' || chr(10)
   || '    <Size>' || size || '</Size>' || chr(10) || '    <StorageClass>STANDARD</StorageClass>' || chr(10) || '  </Contents>' || chr(10), '' ORDER BY name) FILTER (kind = 'K'), '')
 || coalesce(string_agg('  <CommonPrefixes><Prefix>' || {esc.format('name')} || '</Prefix></CommonPrefixes>' || chr(10), '' ORDER BY name) FILTER (kind = 'P'), '') || '</ListBucketResult>' AS xml FROM page"""


@query(_xml_sql())
def list_xml(spark, d):
    return listing.as_xml(q.list_page1(spark, d), "en", "src1", "/", 4, "2024-01-01T00:00:00.000Z")


@query("""
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ListAllMyBucketsResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">' || chr(10) || '  <Owner><ID>tidelog</ID><DisplayName>tidelog</DisplayName></Owner>' || chr(10)
 || '  <Buckets>' || chr(10) || string_agg('    <Bucket>' || chr(10) || '      <Name>' || event_type || '</Name>' || chr(10) || '      <CreationDate>' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z</CreationDate>' || chr(10)
 || '    </Bucket>' || chr(10), '' ORDER BY event_type) || '  </Buckets>' || chr(10) || '</ListAllMyBucketsResult>' AS xml FROM (SELECT event_type, min(ts) AS ts FROM events GROUP BY event_type)""")
def buckets_xml(spark, d):
    """A bucket for each type of event, made at its first one."""
    made = src.table(spark, d, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.min("ts").cast("timestamp").alias("created"))
    return listing.buckets_as_xml(made, "tidelog")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events")
def iso_millis(spark, d):
    return src.table(spark, d, "events").select("event_id", fn.iso_millis(F.col("ts")).alias("at"))


@query("""
SELECT p_partkey, p_size::INT AS megabytes, (CASE WHEN p_partkey % 3 = 0 THEN 1000 ELSE greatest(0, least(1000, p_partkey * 7 - 100)) END)::INT AS max_keys FROM part""")
def scalar_settings(spark, d):
    """Sizes (5MB, 5M, 5) and page sizes (numbers out of range, and words) as settings."""
    n = F.col("p_partkey")
    text = F.concat(F.col("p_size").cast("string"), F.when(n % 3 == 0, "MB").when(n % 3 == 1, "M").otherwise(""))
    keys = F.when(n % 3 == 0, "many").otherwise((n * 7 - 100).cast("string"))
    return src.table(spark, d, "part").select("p_partkey", fn.megabytes(text).alias("megabytes"), fn.max_keys(keys).alias("max_keys"))


@query("""
SELECT n_nationkey AS id, i::INT AS i, 'n' || (n_nationkey + i) AS node_id, 'h' || i AS host, 9000::INT AS http_port, (6000 + n_nationkey)::INT AS raft_port, (CASE WHEN i = 0 THEN 7000 + n_nationkey ELSE 1 END)::INT AS grpc_port
FROM nation, unnest([0, 1]) t(i)""")
def peer_list(spark, d):
    """Peer lists of two, with and without their last port, blanks and an empty entry among them."""
    n = F.col("n_nationkey")
    text = F.format_string("n%d:h0:9000:%d, n%d:h1:9000:%d:1 ,,", n, 6000 + n, n + 1, 6000 + n)
    return src.table(spark, d, "nation").select(n.alias("id"), F.posexplode(fn.parse_peers(text)).alias("i", "p")).select("id", "i", "p.*")


@query(o.live(o.ITEM, o.ITEM_SEQ))
def sync_import(spark, d):
    """A follower that has the log up to an offset, and imports what is exported from there on."""
    records = q.items(spark, d, values=True)
    at = (3, 2 * q.CAP + 100)
    both = log.imported(log.before_offset(records, *at), log.from_offset(records, *at))
    index = log.live_index(both.withColumn("seq", F.col("record_start")), {"value": F.col("value")})
    return index.select("bucket", "key", F.octet_length("value").cast("bigint").alias("size"), F.md5("value").alias("value_md5"))


LIVE_EVENTS = o.live(o.EVENT, "event_id")


@query(LIVE_EVENTS)
def snapshot_recover(spark, d):
    """A snapshot at the middle of the log, published as a version, and the commands after it."""
    cmd = q.commands(spark, d)
    middle = cmd.agg((F.max("idx") / 2).cast("bigint").alias("idx")).first().idx or 0
    root = f"{work_dir(spark)}/tidelog-snapshot-{uuid.uuid4().hex}"
    store.publish(store.snapshot(cmd, middle // 1000, middle), root)
    tail = cmd.where(F.col("idx") > middle)
    return store.recovered(store.current(spark, root), tail).select("bucket", "key", F.octet_length("value").cast("bigint").alias("size"), F.md5("value").alias("value_md5"))


@query(LIVE_EVENTS)
def stream_apply(spark, d):
    """The events as files of commands, applied by a stream of micro-batches with a checkpoint."""
    root = f"{work_dir(spark)}/tidelog-stream-{uuid.uuid4().hex}"
    q.commands(spark, d).select("term", "idx", "op", "bucket", "key", "value").repartitionByRange(4, "idx").write.parquet(f"{root}/in")
    run = streaming.apply_stream(spark, f"{root}/in", f"{root}/state", f"{root}/checkpoint", merge_every=2)
    run.awaitTermination()
    return streaming.latest_state(spark, f"{root}/state").select("bucket", "key", F.octet_length("value").cast("bigint").alias("size"), F.md5("value").alias("value_md5"))


def _record_sql() -> str:
    """A record's bytes in hex; the check sum folds each bit of the flag, key and value."""
    body = f"(CASE WHEN op = 'DELETE' THEN '01' ELSE '00' END || {HEX.format('bucket')} || '00' || {HEX.format('key')} || CASE WHEN op = 'PUT' THEN {HEX.format('value')} ELSE '' END)"
    bits = "flatten([[('0x' || body[2 * i + 1:2 * i + 2])::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR i IN generate_series(0, len(body) // 2 - 1)])"
    step = "lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)"
    return f"""
WITH r AS (SELECT event_id, strlen(bucket) + 1 + strlen(key) AS nk, CASE WHEN op = 'PUT' THEN strlen(value) ELSE 0 END AS nv, {body} AS body FROM ({o.EVENT})),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT) AS crc FROM r),
e AS (SELECT event_id, '51310002' || body[1:2] || {_be('nk', 4)} || {_be('nv', 16)} || {_be('crc', 8)} || body[3:] || {_be('crc', 8)} AS rec FROM c)
SELECT event_id, (len(rec) // 2)::BIGINT AS n_bytes, md5(unhex(rec)) AS record_md5 FROM e"""


ORACLE_SQL["record_encode"] = _record_sql()
