"""Incremental application of a command stream with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.log import live_index
from tidelog.work import delete, names_in

COMMANDS = "term bigint, idx bigint, op string, bucket string, key string, value string"
#: Batches after which the deltas are merged into a new base.
MERGE_EVERY = 8


def _last(df: DataFrame) -> DataFrame:
    """The last command of each key, tombstones included."""
    last = df.groupBy("bucket", "key").agg(F.max_by(F.struct("op", "value", "term", "idx"), F.struct("term", "idx")).alias("x"))
    return last.select("bucket", "key", "x.*")


def _numbers(spark: SparkSession, state: str, kind: str) -> list[int]:
    """Numbers of the whole tables of a kind: those that Spark marked as done."""
    found = [n for n in names_in(spark, state) if n.startswith(f"{kind}-")]
    return [int(n.split("-")[1]) for n in found if "_SUCCESS" in names_in(spark, f"{state}/{n}")]


def _tables(spark: SparkSession, state: str, upto: int | None = None) -> list[str]:
    """The newest base (not after batch `upto`) and the deltas after it."""
    bases = [n for n in _numbers(spark, state, "base") if upto is None or n <= upto]
    base = max(bases, default=-1)
    deltas = [n for n in _numbers(spark, state, "delta") if n > base and (upto is None or n <= upto)]
    return [f"{state}/base-{base:010d}"] * (base >= 0) + [f"{state}/delta-{n:010d}" for n in deltas]


def apply_stream(spark: SparkSession, source: str, state: str, checkpoint: str, per_batch: int = 1, merge_every: int = MERGE_EVERY, every: str | None = None):
    """Read Parquet files of commands as they come and keep the latest command of every key under `state`.

    A batch writes the last command of its own keys, so its cost follows the batch and not the state. Every few batches the
    deltas are merged with the base before them into a new base, and what the one before needed is deleted. A replayed
    batch writes the same tables again: at-least-once delivery gives the state of exactly once. Tombstones stay, as an older
    command may still come. `every` (such as "60 seconds") polls for ever; else the query ends with what is there. Returns the query.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _last(batch.select("bucket", "key", "op", "value", "term", "idx")).write.mode("overwrite").parquet(f"{state}/delta-{number:010d}")
        if (number + 1) % merge_every == 0:
            whole = spark.read.parquet(*_tables(spark, state, number - merge_every), *[f"{state}/delta-{n:010d}" for n in range(max(0, number - merge_every + 1), number + 1)])
            _last(whole).write.mode("overwrite").parquet(f"{state}/base-{number:010d}")
            # the base before and this round's deltas stay: a replay of this batch reads them
            for kind, upto in (("base", number - merge_every), ("delta", number - merge_every + 1)):
                for n in _numbers(spark, state, kind):
                    if n < upto:
                        delete(spark, f"{state}/{kind}-{n:010d}")

    stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", per_batch).parquet(source)
    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**when).start()


def latest_state(spark: SparkSession, state: str) -> DataFrame:
    """bucket, key, value of the live keys: the newest base and the deltas after it."""
    tables = _tables(spark, state)
    rows = spark.read.parquet(*tables) if tables else spark.createDataFrame([], COMMANDS)
    return _last(rows).where("op = 'PUT'").select("bucket", "key", "value")


def batch_state(commands: DataFrame) -> DataFrame:
    """The same from all commands at once."""
    return live_index(commands.withColumn("seq", F.struct("term", "idx")), {"value": F.col("value")})
