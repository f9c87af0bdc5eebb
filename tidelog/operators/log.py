"""The log and its live index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import RECORD_HEADER, internal_key, partition_of, record_length
from tidelog.work import running_total


def live_index(log: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """bucket, key and the payload of the last PUT of every key that isn't deleted since: last writer wins by seq.

    The payload should be narrow (lengths, digests, positions): values needn't pass through the shuffle. Aggregated
    before the shuffle, so a key with very many versions costs one row a task.
    """
    last = log.select("bucket", "key", "seq", F.struct("op", *[c.alias(n) for n, c in payload.items()]).alias("x"))
    last = last.groupBy("bucket", "key").agg(F.max_by("x", "seq").alias("x"))
    return last.where("x.op = 'PUT'").select("bucket", "key", *[F.col("x")[n].alias(n) for n in payload])


def offsets(log: DataFrame, partitions: int = 16, values: bool = False) -> DataFrame:
    """Records with partition_id, record_start, record_length and value_offset in their partition's log; with their value if asked.

    Running sums of ranges of each partition, so a partition of very many records is many tasks. It is in the shared
    folder, in the log's order by runs, so several uses read it and compute nothing again. Values go through its one shuffle
    only for those that need them: that is less than a later join with the log, which moves both sides.
    """
    value = F.when(F.col("op") == "PUT", F.col("value"))
    sized = log.select("bucket", "key", "op", "seq", *["value"] * values, partition_of(F.col("bucket"), F.col("key"), partitions).alias("partition_id"), record_length(F.col("bucket"), F.col("key"), value).cast("bigint").alias("record_length"), F.octet_length(F.coalesce(value, F.lit(""))).cast("bigint").alias("value_length"))
    placed = running_total(sized, "partition_id", ["seq", "key"], "record_length", "record_start", "log")
    return placed.withColumn("value_offset", F.col("record_start") + RECORD_HEADER + F.octet_length(internal_key(F.col("bucket"), F.col("key"))))


def in_segments(records: DataFrame, cap: int) -> DataFrame:
    """records (of offsets()) with segment_id: ranges of `cap` bytes of the log; see rolled() for rolls by size."""
    return records.withColumn("segment_id", (F.floor(F.col("record_start") / cap) + 1).cast("int"))


def rolled(records: DataFrame, cap: int) -> DataFrame:
    """partition_id, segment_id, n_records, size: a segment is closed before the first record that finds it at `cap` bytes or more.

    Where a segment starts depends on all before it, so each partition is read in order, lengths alone, by one task that
    keeps the open segment and nothing else.
    """
    import pyarrow as pa

    def run(batches):
        at, segment, start, n = None, 0, 0, 0  # the open segment: its partition, number, first byte, records
        end = 0

        for batch in batches:
            part, begin, size = (batch.column(c).to_numpy() for c in ("partition_id", "record_start", "record_length"))
            closed, i = [], 0
            while i < len(part):
                if part[i] != at:
                    if n:
                        closed.append((at, segment, n, end - start))
                    at, segment, start, n = part[i], 1, begin[i], 0
                elif begin[i] - start >= cap:
                    closed.append((at, segment, n, begin[i] - start))
                    segment, start, n = segment + 1, begin[i], 0
                last = int(np.searchsorted(part, at, "right"))  # sorted by partition, then by start
                j = i + max(1, int(np.searchsorted(begin[i:last], start + cap)))
                n, end, i = n + j - i, begin[j - 1] + size[j - 1], j
            yield out(closed)
        yield out([(at, segment, n, end - start)] if n else [])

    def out(rows):
        cols = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64), pa.int64()).cast(t) for c, t in zip(cols, kinds)], ["partition_id", "segment_id", "n_records", "size"])

    narrow = records.select("partition_id", "record_start", "record_length").repartition("partition_id").sortWithinPartitions("partition_id", "record_start")
    return narrow.mapInArrow(run, "partition_id int, segment_id int, n_records bigint, size bigint")


def _exported(records: DataFrame, segment: int, offset: int) -> DataFrame:
    """records with _later: whether an export from (segment, offset) has them. An unknown start segment means all."""
    known = records.agg(F.coalesce(F.bool_or(F.col("segment_id") == segment), F.lit(False)).alias("_known"))  # one row
    later = (F.col("segment_id") > segment) | ((F.col("segment_id") == segment) & (F.col("record_start") >= offset))
    return records.join(F.broadcast(known)).withColumn("_later", later | ~F.col("_known")).drop("_known")


def from_offset(records: DataFrame, segment: int, offset: int) -> DataFrame:
    """The records at or after (segment, offset): an incremental export. An unknown start segment means all."""
    return _exported(records, segment, offset).where("_later").drop("_later")


def before_offset(records: DataFrame, segment: int, offset: int) -> DataFrame:
    """The other records: the log of a follower that asks for an export from (segment, offset)."""
    return _exported(records, segment, offset).where("not _later").drop("_later")


def imported(mine: DataFrame, later: DataFrame) -> DataFrame:
    """A follower's log after it imports exported records: those it has already (by their place) are taken once."""
    new = later.join(mine.select("partition_id", "record_start"), ["partition_id", "record_start"], "left_anti")
    return mine.unionByName(new.select(*mine.columns))


def applied(commands: DataFrame) -> DataFrame:
    """State after an ordered command stream (bucket, key, type, value_md5, term, idx): last command of each key."""
    return live_index(commands.withColumn("seq", F.struct("term", "idx")).withColumnRenamed("type", "op"), {"value_md5": F.col("value_md5")})
