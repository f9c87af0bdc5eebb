"""The registered queries: operators applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog import sources as src
from tidelog.operators import cluster, compaction, erasure, listing, log
from tidelog.work import spread

NODES = [f"n{i}" for i in range(6)]
CAP = 16_384
K, M = 4, 2


def doc_keys(spark, d):
    return src.doc_objects(spark, d).select("bucket", "key", F.octet_length("value").cast("bigint").alias("size"))


def items(spark, d, values=False):
    return log.in_segments(log.offsets(src.item_log(spark, d), values=values), CAP)


def list_delimited(spark, d):
    return listing.page(doc_keys(spark, d), "en", delimiter="/")


def list_prefix(spark, d):
    return listing.page(doc_keys(spark, d), "en", prefix="src1")


def list_page1(spark, d):
    return listing.page(doc_keys(spark, d), "en", prefix="src1", delimiter="/", max_keys=4)


def list_page2(spark, d):
    return listing.page(doc_keys(spark, d), "en", prefix="src1", delimiter="/", after="src12/", max_keys=4)


def list_maxkeys0(spark, d):
    return listing.page(doc_keys(spark, d), "en", max_keys=0)


def list_buckets(spark, d):
    return src.doc_objects(spark, d).groupBy("bucket").agg(F.count("*").alias("n_objects"))


def continuation_token(spark, d):
    token = fn.encode_token(F.col("key"))
    return src.page_objects(spark, d).select("key", token.alias("token"), (fn.decode_token(token) == F.col("key")).alias("round_trip"))


def _live(log_df):
    return log.live_index(log_df, {"size": F.octet_length("value").cast("bigint"), "value_md5": F.md5("value")})


def live_index_conv(spark, d):
    return _live(src.conv_log(spark, d))


def live_index_events(spark, d):
    return _live(src.event_log(spark, d))


def live_index_items(spark, d):
    return _live(src.item_log(spark, d))


def get_etag(spark, d):
    return src.doc_objects(spark, d).select("bucket", "key", F.octet_length("value").cast("bigint").alias("size"), fn.etag(F.col("value")).alias("etag"))


def _asked(spark, d):
    """Keys asked for: those of all users and letters that exist in the log, and others that can't."""
    real = src.event_log(spark, d).select("bucket", "key").distinct()
    return real.unionByName(real.select("bucket", F.concat("key", F.lit("/none")).alias("key")))


def head_exists(spark, d):
    live = live_index_events(spark, d).select("bucket", "key", "size")
    out = _asked(spark, d).join(live, ["bucket", "key"], "left")
    return out.select("bucket", "key", F.when(F.col("size").isNull(), 404).otherwise(200).alias("status"), "size")


def missing_keys(spark, d):
    return _asked(spark, d).join(live_index_events(spark, d), ["bucket", "key"], "left_anti").select("bucket", "key")


def java_hash(spark, d):
    return src.page_objects(spark, d).select("key", fn.java_hash(F.col("key")).alias("hash"))


def partition_route(spark, d):
    return src.doc_objects(spark, d).select("bucket", "key", fn.partition_of(F.col("bucket"), F.col("key")).alias("partition_id"))


def partition_stats(spark, d):
    records = items(spark, d)
    return cluster.partition_stats(records, compaction.index_of(records))


def replica_assignment(spark, d):
    return cluster.replicas(spark, NODES, 16, 3)


def partition_report(spark, d):
    """Partition statistics with their replicas; replica 0 is the preferred leader."""
    return partition_stats(spark, d).join(F.broadcast(replica_assignment(spark, d)), "partition_id").select("partition_id", "segments", "size", "live_keys", "node_id", (F.col("replica") == 0).alias("leader"))


def ring_placement(spark, d):
    return erasure.placed(src.page_objects(spark, d), NODES, K + M)


def segment_offsets(spark, d):
    return log.offsets(src.conv_log(spark, d)).select("bucket", "key", F.col("seq.turn").alias("turn"), "partition_id", "record_start", "record_length", "value_offset")


def segment_roll(spark, d):
    return log.rolled(log.offsets(src.item_log(spark, d)), CAP)


def segment_live_bytes(spark, d):
    return compaction.live_bytes(items(spark, d)).select("partition_id", "segment_id", "size", "n_records", "live", "n_live", "sealed")


def compaction_candidates(spark, d):
    return compaction.candidates(items(spark, d)).select("partition_id", "segment_id", "size", "live", F.round("dead_ratio", 9).alias("dead_ratio"), "rank")


def compaction_rewrite(spark, d):
    return compaction.rewritten(items(spark, d)).groupBy("partition_id", "segment_id", "op").agg(F.count("*").alias("n_kept"))


def moved_since_1996(spark, d):
    """Entries of the index as of 1996 against the one of today: those overwritten or deleted since are stale."""
    records = items(spark, d)
    old = records.where(F.col("seq.l_shipdate") <= F.lit("1996-01-01").cast("timestamp_ntz"))
    return compaction.freshness(compaction.index_of(old), compaction.index_of(records))


def compaction_freshness(spark, d):
    return moved_since_1996(spark, d).select("bucket", "key", "segment_id", "fresh")


def compaction_summary(spark, d):
    """Per partition: sealed segments, those compacted, and those left as they are."""
    records = items(spark, d)
    sealed = compaction.live_bytes(records).where("sealed").groupBy("partition_id").agg(F.count("*").alias("sealed"))
    chosen = compaction.candidates(records).groupBy("partition_id").agg(F.count("*").alias("compacted"), F.sum("live").alias("live_bytes"))
    out = sealed.join(chosen, "partition_id", "left").na.fill(0)
    return out.select("partition_id", "sealed", "compacted", "live_bytes", F.greatest(F.lit(0), F.col("sealed") - F.col("compacted")).alias("intact"))


def ec_split_sizes(spark, d):
    size = F.octet_length("value").cast("bigint")
    return src.doc_objects(spark, d).select("bucket", "key", size.alias("original_size"), F.ceil(size / K).alias("shard_size"), (F.ceil(size / K) * K - size).alias("padding"))


def _talks(spark, d):
    """Conversation turns as objects of their own: key conv_id/turn."""
    talk = src.table(spark, d, "conversations")
    return talk.select(F.lit("conv").alias("bucket"), F.concat_ws("/", F.lpad(F.col("conv_id").cast("string"), 10, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("key"), F.col("text").alias("value"))


def ec_parity_k2m1(spark, d):
    return _talks(spark, d).select("key", F.md5(erasure.parity_two_one(F.col("value"))).alias("parity_md5"))


def _shards(spark, d):
    return erasure.lost(erasure.shards_of(spread(src.doc_objects(spark, d)), K, M))


def ec_roundtrip(spark, d):
    """Objects read back without their first two shards."""
    back = erasure.read_objects(erasure.shards_of(spread(src.doc_objects(spark, d)), K, M).where("shard_idx >= 2"), K, M)
    return back.select("bucket", "key", "status", F.md5("value").alias("value_md5"))


def ec_degraded_status(spark, d):
    back = erasure.read_objects(_shards(spark, d).where("not is_lost"), K, M)
    return back.select("bucket", "key", "n_present", "status", F.md5("value").alias("value_md5"))


def _placed(spark, d):
    return erasure.lost(erasure.placed(src.doc_objects(spark, d), NODES, K + M))


def ec_missing_shards(spark, d):
    expected = _placed(spark, d)
    return erasure.missing(expected.drop("is_lost"), expected.where("not is_lost"))


def ec_repair_plan(spark, d):
    expected = _placed(spark, d)
    return erasure.repair_plan(expected, expected.where("not is_lost"), K)


def ec_repaired(spark, d):
    """Missing shards made anew: equal to those that were lost."""
    expected = _placed(spark, d).drop("is_lost")
    whole = _shards(spark, d)
    made = erasure.repaired(whole.where("not is_lost").drop("is_lost"), expected, K, M)
    old = whole.where("is_lost").select("bucket", "key", "shard_idx", F.md5("data").alias("was"))
    return made.join(old, ["bucket", "key", "shard_idx"]).select("bucket", "key", "shard_idx", "node_id", (F.md5("data") == F.col("was")).alias("equal"))


def repair_batch_checkpoint(spark, d):
    keys = src.page_objects(spark, d).select("key").distinct()
    return listing.keys_from(keys, "m.", "", 200).select("key", F.hex(F.encode("checkpoint", "UTF-8")).alias("next_checkpoint"))


def ec_listing_union(spark, d):
    keys = doc_keys(spark, d)
    direct = keys.where("size % 3 <> 0")
    sharded = keys.where("size % 2 = 0").select("bucket", "key")
    return listing.union_listing(direct, sharded)


def plain_fallback(spark, d):
    """Shards where any is present, else the plain object."""
    expected = erasure.lost(erasure.placed(src.doc_objects(spark, d), NODES, 2), 2).where("not is_lost")
    there = expected.groupBy("bucket", "key").agg(F.count("*").alias("n_present"))
    out = doc_keys(spark, d).join(there, ["bucket", "key"], "left")
    source = F.when(F.coalesce("n_present", F.lit(0)) == 0, "plain").otherwise("shards")
    return out.select("bucket", "key", F.coalesce("n_present", F.lit(0)).alias("n_present"), source.alias("source"))


def bucket_semi_join(spark, d):
    """Objects of the buckets that exist: two of them were deleted, their objects stay and would show again."""
    keys = doc_keys(spark, d)
    buckets = keys.select("bucket").distinct().where(~F.col("bucket").isin("de", "fr"))
    return keys.join(F.broadcast(buckets), "bucket", "left_semi").select("bucket", "key", "size")  # a registry of names


def internal_bucket_guard(spark, d):
    keys = src.doc_objects(spark, d).select(F.when(F.col("bucket") == "es", "__sys_shards__").otherwise(F.col("bucket")).alias("bucket"), "key")
    return keys.select("bucket", "key", F.when(F.col("bucket").startswith("__sys_"), 403).otherwise(200).alias("status"))


def sync_from_offset(spark, d):
    out = log.from_offset(items(spark, d), 3, 2 * CAP + 100)
    return out.select("key", "partition_id", "segment_id", "record_start", "op")


def commands(spark, d):
    """The events as commands of a replicated log: a new term every 1,000 of them."""
    return src.event_log(spark, d).select("bucket", "key", "op", "value", (F.col("seq.event_id") / 1000).cast("bigint").alias("term"), F.col("seq.event_id").alias("idx"))


def command_apply(spark, d):
    return log.applied(commands(spark, d).select("bucket", "key", F.col("op").alias("type"), F.md5("value").alias("value_md5"), "term", "idx"))


def rebuild_equals_index(spark, d):
    """Live keys of the whole log, and of the log that compaction leaves: equal in every partition."""
    records = items(spark, d)
    part = lambda x: compaction.index_of(x).groupBy("partition_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("bucket", "key", "segment_id", "value_offset", "value_length")).alias("x"))
    a, b = part(records), part(compaction.compacted(records)).withColumnsRenamed({"n": "n_again", "x": "y"})
    return a.join(b, "partition_id").select("partition_id", F.col("n").alias("n_live"), "n_again", (F.col("x") == F.col("y")).alias("equal"))


def latency_percentiles(spark, d):
    samples = src.table(spark, d, "events").select("event_type", (F.col("value") * 1000).alias("micros"))
    return cluster.latencies(samples, "event_type", "micros")


def health_rollup(spark, d):
    groups = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"), (F.col("n_regionkey") != 3).alias("has_leader"))
    return cluster.health(groups)


def xml_escape(spark, d):
    return src.page_objects(spark, d).select("key", F.md5(fn.xml_escape(F.col("value"))).alias("escaped_md5"))


def path_parse(spark, d):
    got = fn.parse_path(F.concat(F.lit("/pages/"), F.col("key")))
    return src.page_objects(spark, d).select("key", got["bucket"].alias("bucket"), got["key"].alias("object_key"), fn.object_of_shard(F.concat("key", F.lit("/03"))).alias("object_path"))


def object_status(spark, d):
    """GET status of keys in existing and missing buckets."""
    asked = _asked(spark, d)
    asked = asked.unionByName(asked.select(F.lit("nowhere").alias("bucket"), "key"))
    live = live_index_events(spark, d).select("bucket", "key", "size")
    known = F.broadcast(live.select("bucket").distinct().withColumn("known", F.lit(True)))  # a registry of names
    out = asked.join(known, "bucket", "left").join(live, ["bucket", "key"], "left")
    status = F.when(F.col("known").isNull(), "404 NoSuchBucket").when(F.col("size").isNull(), "404 NoSuchKey").otherwise("200")
    return out.select("bucket", "key", status.alias("status"))


def record_encode(spark, d):
    """Log records in their binary form, as digests."""
    rec = fn.encode_record(F.col("bucket"), F.col("key"), F.col("value"), F.col("op") == "DELETE")
    return src.event_log(spark, d).select(F.col("seq.event_id").alias("event_id"), F.octet_length(rec).cast("bigint").alias("n_bytes"), F.md5(rec).alias("record_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        list_delimited, list_prefix, list_page1, list_page2, list_maxkeys0, list_buckets, continuation_token, live_index_conv, live_index_events, live_index_items, get_etag, head_exists,
        missing_keys, java_hash, partition_route, partition_stats, replica_assignment, partition_report, ring_placement, segment_offsets, segment_roll, segment_live_bytes,
        compaction_candidates, compaction_rewrite, compaction_freshness, compaction_summary, ec_split_sizes, ec_parity_k2m1, ec_roundtrip, ec_degraded_status, ec_missing_shards,
        ec_repair_plan, ec_repaired, repair_batch_checkpoint, ec_listing_union, plain_fallback, bucket_semi_join, internal_bucket_guard, sync_from_offset, command_apply,
        rebuild_equals_index, latency_percentiles, health_rollup, xml_escape, path_parse, object_status, record_encode,
    )
}
