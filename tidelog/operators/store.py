"""Requests to the store: reads through the index, statuses, deletes, the bucket registry, versions and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import etag
from tidelog.operators.log import live_index
from tidelog.sources.segments import intact
from tidelog.work import delete, names_in


def get(asked: DataFrame, index: DataFrame, log: DataFrame) -> DataFrame:
    """bucket, key, status, size, etag, verified, value of every key asked for: key, index entry, record.

    index: bucket, key, partition_id, segment_id, record_start; log: the records of scanned segments. A key without an entry is a
    404. An entry whose record is gone, or whose bytes don't have its check sum, is an error of the store and no 404:
    500, without a value.
    """
    at = ["partition_id", "segment_id", "record_start"]
    spots = asked.join(index.select("bucket", "key", *at), ["bucket", "key"], "left")
    found = log.select(*at, "flags", F.col("bucket").alias("_b"), F.col("key").alias("_k"), "value", "crc")
    out = spots.join(found, at, "left")
    sound = (F.col("_b") == F.col("bucket")) & (F.col("_k") == F.col("key")) & intact(F.col("value"), F.col("flags"), F.concat("_b", F.lit("\0"), "_k"), F.col("crc"))
    verified = F.when(F.col("segment_id").isNotNull(), F.coalesce(sound, F.lit(False)))
    status = F.when(F.col("segment_id").isNull(), 404).when(verified, 200).otherwise(500)
    shown = F.when(status == 200, F.col("value"))
    return out.select("bucket", "key", status.alias("status"), F.octet_length(shown).cast("bigint").alias("size"), etag(shown).alias("etag"), verified.alias("verified"), shown.alias("value"))


def statuses(requests: DataFrame, live: DataFrame, buckets: DataFrame, ready: Column | bool = True) -> DataFrame:
    """requests (method, bucket, key) with status and code, as the object interface answers them.

    An internal bucket is denied before anything else, a store that isn't ready answers 503, a missing bucket is a 404 for all
    methods; GET and HEAD of a missing key are a 404, PUT is 200, DELETE 204 whether or not the key is there.
    """
    known = F.broadcast(buckets.select("bucket").distinct().withColumn("_known", F.lit(True)))  # a registry of names
    there = live.select("bucket", "key", F.lit(True).alias("_there"))
    rows = requests.join(known, "bucket", "left").join(there, ["bucket", "key"], "left")
    ready = F.lit(ready) if isinstance(ready, bool) else ready
    code = (
        F.when(F.col("bucket").startswith("__sys_"), "AccessDenied").when(~ready, "ServiceUnavailable").when(F.col("_known").isNull(), "NoSuchBucket")
        .when(F.col("method").isin("GET", "HEAD") & F.col("_there").isNull(), "NoSuchKey")
    )
    status = F.when(code == "AccessDenied", 403).when(code == "ServiceUnavailable", 503).when(code.isNotNull(), 404).when(F.col("method") == "DELETE", 204).otherwise(200)
    return rows.select("method", "bucket", "key", status.alias("status"), code.alias("code"))


def writes(log: DataFrame) -> DataFrame:
    """log with written: whether the command appends a record. A DELETE of a key that isn't there writes no tombstone."""
    before = F.lag("op").over(Window.partitionBy("bucket", "key").orderBy("seq"))
    return log.withColumn("written", (F.col("op") == "PUT") | F.coalesce(before == "PUT", F.lit(False)))


def bucket_commands(commands: DataFrame) -> DataFrame:
    """commands (bucket, op CREATE or DELETE, seq) with status: create 200 also of a bucket that exists; delete 204, or 404 without one."""
    before = F.lag("op").over(Window.partitionBy("bucket").orderBy("seq"))
    return commands.withColumn("status", F.when(F.col("op") == "CREATE", 200).when(before == "CREATE", 204).otherwise(404))


def registry(commands: DataFrame) -> DataFrame:
    """bucket, created (seq) of the buckets that exist after the commands, empty ones too.

    A bucket keeps the time of the first creation since its last deletion. Objects are none of the registry's business: those of a
    deleted bucket stay, and show again if it is made anew.
    """
    gone = commands.where("op = 'DELETE'").groupBy("bucket").agg(F.max("seq").alias("gone"))
    made = commands.where("op = 'CREATE'").join(gone, "bucket", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return made.groupBy("bucket").agg(F.min("seq").alias("created"))


def publish(df: DataFrame, root: str) -> str:
    """Write df as a new version under root and make it the current one; the version's name.

    A version is written whole before the marker that names it, which is one small file: readers see the version before
    or this one, and a writer that dies leaves the version before.
    """
    spark = df.sparkSession
    number = max([int(n.split("-")[1]) for n in names_in(spark, root) if n.startswith("version-")], default=-1) + 1
    name = f"version-{number:010d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current-{number:010d}-{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False).close()
    return name


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version under root; versions without a marker are left aside."""
    marks = [n for n in names_in(spark, root) if n.startswith("current-")]
    if not marks:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(f"{root}/{marks[-1].split('-', 2)[2]}")


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what an interrupted writer left and all versions before the current one; the names deleted. For one writer at a time."""
    names = names_in(spark, root)
    marks = [n for n in names if n.startswith("current-")]
    keep = {marks[-1], marks[-1].split("-", 2)[2]} if marks else set()
    gone = [n for n in names if n not in keep and n.startswith(("version-", "current-"))]
    for n in gone:
        delete(spark, f"{root}/{n}")
    return gone


def snapshot(commands: DataFrame, term: int, idx: int) -> DataFrame:
    """The last command (op, value, term, idx) of each key up to (term, idx), tombstones included."""
    upto = commands.where((F.col("term") < term) | ((F.col("term") == term) & (F.col("idx") <= idx)))
    last = upto.groupBy("bucket", "key").agg(F.max_by(F.struct("op", "value", "term", "idx"), F.struct("term", "idx")).alias("x"))
    return last.select("bucket", "key", "x.*")


def recovered(snapshot: DataFrame, commands: DataFrame) -> DataFrame:
    """bucket, key, value of the live keys from a snapshot and the commands after it. Commands before it do no harm: the last of a key wins."""
    both = snapshot.unionByName(commands.select(*snapshot.columns)).withColumn("seq", F.struct("term", "idx"))
    return live_index(both, {"value": F.col("value")})
