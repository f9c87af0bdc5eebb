"""Compaction: dead space, candidates, rewriting and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ("partition_id", "segment_id", "value_offset", "value_length")


def index_of(records: DataFrame) -> DataFrame:
    """bucket, key, partition_id, segment_id, value_offset, value_length of every live key.

    A key's records are in one partition, where the log's order is that of record_start, and segments and places in it grow
    along: the last record's are the greatest. Numbers alone, few of them, which aggregate by hash before the shuffle.
    """
    last = [F.max(c).alias(c) for c in ENTRY[:3]]
    length = F.max_by(F.when(F.col("op") == "PUT", F.col("value_length")), "record_start").alias("value_length")  # null: deleted last
    return records.groupBy("bucket", "key").agg(*last, length).where("value_length is not null")


def live_bytes(records: DataFrame) -> DataFrame:
    """Every segment with its size, live value bytes, records, and whether it is sealed (not the last of its partition)."""
    sizes = records.groupBy("partition_id", "segment_id").agg(F.sum("record_length").alias("size"), F.count("*").alias("n_records"), F.sum(F.when(F.col("op") == "PUT", F.col("record_length") - F.col("value_length"))).alias("overhead"))
    live = index_of(records).groupBy("partition_id", "segment_id").agg(F.sum("value_length").alias("live"), F.count("*").alias("n_live"))
    last = F.max("segment_id").over(Window.partitionBy("partition_id"))
    out = sizes.join(live, ["partition_id", "segment_id"], "left")
    return out.select("partition_id", "segment_id", "size", "n_records", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("n_live", F.lit(0)).alias("n_live"), (F.col("segment_id") < last).alias("sealed"))


def candidates(records: DataFrame, threshold: float = 0.5, most: int = 4) -> DataFrame:
    """The sealed segments of most dead space in each partition: share dead over the threshold, `most` at most.

    dead_ratio counts value bytes against the whole segment, so record headers count as dead.
    """
    some = live_bytes(records).where("sealed and size > 0").withColumn("dead_ratio", 1.0 - F.col("live") / F.col("size")).where(F.col("dead_ratio") > threshold)
    rank = F.row_number().over(Window.partitionBy("partition_id").orderBy(F.desc("dead_ratio"), "segment_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= most).drop("sealed")


def kept(records: DataFrame, threshold: float = 0.5, most: int = 4) -> DataFrame:
    """The records of the candidates that compaction keeps: live ones, and tombstones while an older version is left elsewhere.

    Keeping those tombstones is stricter than dropping all: no later rebuild can bring a deleted key back.
    """
    chosen = F.broadcast(candidates(records, threshold, most).select("partition_id", "segment_id"))  # `most` rows a partition
    mine = records.join(chosen, ["partition_id", "segment_id"], "left_semi")
    live = index_of(records).select("partition_id", "segment_id", "value_offset")
    alive = mine.where("op = 'PUT'").join(live, ["partition_id", "segment_id", "value_offset"], "left_semi")
    # a key is in one partition, whose order is that of record_start
    others = records.where("op = 'PUT'").join(chosen, ["partition_id", "segment_id"], "left_anti").groupBy("bucket", "key").agg(F.min("record_start").alias("oldest"))
    dead = mine.where("op = 'DELETE'").join(others, ["bucket", "key"]).where(F.col("oldest") < F.col("record_start")).drop("oldest")
    return alive.select(*records.columns).unionByName(dead.select(*records.columns))


def rewritten(records: DataFrame, threshold: float = 0.5, most: int = 4) -> DataFrame:
    """bucket, key, partition_id, segment_id, op of what kept() keeps, one row a key, segment and kind."""
    return kept(records, threshold, most).select("bucket", "key", "partition_id", "segment_id", "op").distinct()


def compacted(records: DataFrame, threshold: float = 0.5, most: int = 4) -> DataFrame:
    """The log after compaction: the records of segments that aren't candidates, and what kept() keeps of the others.

    record_start still orders them; a segment's bytes close up when it is written (sources.segments).
    """
    chosen = F.broadcast(candidates(records, threshold, most).select("partition_id", "segment_id"))
    return records.join(chosen, ["partition_id", "segment_id"], "left_anti").unionByName(kept(records, threshold, most))


def stats(moved: DataFrame, *by: str) -> DataFrame:
    """kept, skipped and live_bytes of moved entries (of freshness()), in total or for each of `by`.

    live_bytes counts all that was copied, also what turned out stale at the commit.
    """
    return moved.groupBy(*by).agg(F.count_if("fresh").alias("kept"), F.count_if(~F.col("fresh")).alias("skipped"), F.sum("value_length").alias("live_bytes"))


def exact_ratio(records: DataFrame) -> DataFrame:
    """partition_id, segment_id, size, live_size, dead_ratio of every segment, headers and keys of live records counted as live."""
    spots = index_of(records).select("partition_id", "segment_id", "value_offset")
    alive = records.where("op = 'PUT'").join(spots, ["partition_id", "segment_id", "value_offset"], "left_semi")
    live = alive.groupBy("partition_id", "segment_id").agg(F.sum("record_length").alias("live_size"))
    sizes = records.groupBy("partition_id", "segment_id").agg(F.sum("record_length").alias("size"))
    out = sizes.join(live, ["partition_id", "segment_id"], "left").select("partition_id", "segment_id", "size", F.coalesce("live_size", F.lit(0)).alias("live_size"))
    return out.withColumn("dead_ratio", F.when(F.col("size") > 0, 1.0 - F.col("live_size") / F.col("size")).otherwise(0.0))


def referenced(segments: DataFrame, index: DataFrame) -> DataFrame:
    """segments (partition_id, segment_id) with referenced: whether a live entry points into it."""
    used = index.select("partition_id", "segment_id").distinct().withColumn("referenced", F.lit(True))
    return segments.join(used, ["partition_id", "segment_id"], "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))


def freshness(moved: DataFrame, current: DataFrame) -> DataFrame:
    """moved entries with fresh: whether the current index still has exactly the entry that was copied."""
    now = current.select("bucket", "key", *[F.col(c).alias(f"now_{c}") for c in ENTRY])
    same = F.lit(True)
    for c in ENTRY:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return moved.join(now, ["bucket", "key"], "left").select("bucket", "key", *ENTRY, same.alias("fresh"))
