"""Sharding by jump consistent hashing. DataFrame functions only.

Unsigned 64-bit products are built from 32- and 16-bit parts, which fit signed longs, so they hold under ANSI rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import numbered

#: Multiplier of the published algorithm (fixed value), in 32-bit halves.
HIGH, LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
#: Steps tried at once; nearly all keys end within them.
STEPS = 14


def _step(s: Column, shards: int) -> Column:
    """One jump of the state (hi, lo: the key's halves, at: bucket, next: where it jumps; before: last bucket but the newest)."""
    hi, lo = s["hi"], s["lo"]
    times = lambda x, y: (x.bitwiseAND(0xFFFF) * y) + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(0xFFFF), 16)
    low = times(lo, F.lit(LOW)) + 1
    carry = F.shiftright(low, 32) + F.shiftright(F.shiftright(lo, 16) * F.lit(LOW), 16)
    new_hi = (carry + times(lo, F.lit(HIGH)) + times(hi, F.lit(LOW))).bitwiseAND(0xFFFFFFFF)
    jump = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1).cast("double")))
    moved = F.struct(new_hi.alias("hi"), low.bitwiseAND(0xFFFFFFFF).alias("lo"), s["next"].alias("at"), jump.cast("bigint").alias("next"), s["at"].alias("before"))
    return F.when(s["next"] < shards, moved).otherwise(s)


def jump_shards(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """df with shard (of `shards`) and grown_shard (of shards + 1) of a 64-bit key. Both come from one chain of jumps."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(0xFFFFFFFF).alias("lo"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"), F.lit(-1).cast("bigint").alias("before")
    )
    run = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, lambda x, _: _step(x, shards + 1))
    df = df.withColumn("_s", run(start, min(STEPS, shards + 1)))
    if shards + 1 > STEPS:
        df = df.withColumn("_s", F.when(F.col("_s.next") < shards + 1, run(F.col("_s"), shards + 1 - STEPS)).otherwise(F.col("_s")))
    grown = F.col("_s.at")
    return df.withColumns({"shard": F.when(grown < shards, grown).otherwise(F.col("_s.before")).cast("int"), "grown_shard": grown.cast("int")}).drop("_s")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row: law `key`.

    The shard follows from doc_id (as a 64-bit key; null: 0) and the number of shards alone, so rows of one doc_id
    share a shard and a run with one more shard moves rows into the new one only. slot numbers a shard's rows from 0 in order of
    (doc_id, text_crc32, size), nulls first; equal rows in any order. Null text: size 16 and the CRC of nothing, 0.
    Only doc_id and text are read. Empty input: empty result.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw).cast("bigint") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = jump_shards(rows, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), shards)
    ranked = numbered(rows, ["shard", "doc_id", "text_crc32", "size"], "rank", "shards")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), "grown_shard"
    )
