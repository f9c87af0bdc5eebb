"""Partition reports, replicas, health and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replicas(spark: SparkSession, nodes: list[str], partitions: int, factor: int) -> DataFrame:
    """partition_id, replica, node_id: factor consecutive nodes of the sorted ring, from the partition's own number on."""
    ring, n = F.array(*[F.lit(x) for x in sorted(nodes)]), len(nodes)
    parts = spark.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(min(factor or n, n) - 1)), lambda i: F.get(ring, (F.col("partition_id") + i) % n))
    return parts.select("partition_id", F.posexplode(spots).alias("replica", "node_id"))


def partition_stats(records: DataFrame, index: DataFrame) -> DataFrame:
    """partition_id, segments, size, live_keys."""
    sizes = records.groupBy("partition_id").agg(F.countDistinct("segment_id").alias("segments"), F.sum("record_length").alias("size"))
    keys = index.groupBy("partition_id").agg(F.count("*").alias("live_keys"))
    return sizes.join(keys, "partition_id", "left").select("partition_id", "segments", "size", F.coalesce("live_keys", F.lit(0)).alias("live_keys"))


def health(groups: DataFrame) -> DataFrame:
    """One row: ready, status and counts of groups (group_id, has_leader)."""
    out = groups.agg(F.count("*").alias("groups"), F.count_if("has_leader").alias("led"), F.coalesce(F.every("has_leader"), F.lit(True)).alias("ready"))
    return out.withColumn("status", F.when(F.col("ready"), 200).otherwise(503))


def latencies(samples: DataFrame, by: str, micros: str, ranks: tuple[int, ...] = (50, 95, 99), cap: int = 100_000) -> DataFrame:
    """Nearest-rank percentiles of whole microseconds, capped, for each group; counts are summed before the shuffle.

    A histogram of at most cap + 1 buckets a group, as the sorting of all samples of a hot group would land in one task.
    """
    from pyspark.sql import Window

    buckets = samples.select(by, F.least(F.floor(micros), F.lit(cap)).cast("bigint").alias("bucket")).groupBy(by, "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(by))
    seen = buckets.withColumns({"upto": upto, "total": total})
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("total") * p / 100))
    return seen.groupBy(by).agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= rank(p), F.col("bucket"))).alias(f"p{p}") for p in ranks])


def throughput(samples: DataFrame, by: str, at: str) -> DataFrame:
    """by, n, seconds, per_second: rows of each group over the time between its first and its last."""
    out = samples.groupBy(by).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    out = out.withColumn("seconds", (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6)
    return out.select(by, "n", "seconds", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).alias("per_second"))


def leader_addresses(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """partition_id, node_id, address of each partition's leader (replica 0) from nodes (node_id, host, http_port)."""
    leaders = placed.where("replica = 0").select("partition_id", "node_id")
    address = F.concat_ws("", F.lit("http://"), F.col("host"), F.lit(":"), F.col("http_port").cast("string"))
    return leaders.join(F.broadcast(nodes.select("node_id", address.alias("address"))), "node_id", "left").select("partition_id", "node_id", "address")  # a cluster's nodes


def groups_to_add(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """Groups that a node should run and doesn't yet."""
    return wanted.join(loaded, wanted.columns, "left_anti")


def health_report(groups: DataFrame, node: str, nodes: int, partitions: int, k: int = 0, m: int = 0) -> DataFrame:
    """One row, status and json: mode standalone (no nodes; always ready), replication, or ec (k > 0, which needs k nodes)."""
    mode = "standalone" if not nodes else "ec" if k else "replication"
    state = health(groups)
    ready = F.lit(True) if mode == "standalone" else F.col("ready") & F.lit(nodes >= k)
    fields = [F.lit(node).alias("nodeId"), F.lit(mode).alias("mode"), F.when(ready, "ok").otherwise("degraded").alias("status")]
    fields += [F.lit(nodes).alias("peers")] if nodes else []
    fields += [F.lit(partitions).alias("partitions")]
    fields += [F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")).alias("ec")] if mode == "ec" else []
    return state.select(F.lit(mode).alias("mode"), F.when(ready, 200).otherwise(503).alias("status"), F.to_json(F.struct(*fields)).alias("json"))
