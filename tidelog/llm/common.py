"""What the corpus operators share: work tables in the cluster's shared folder and global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.work import dropped, saved, small_batches, spread, work_dir

__all__ = ["BROADCAST_ROWS", "ascii_lower", "dropped", "numbered", "saved", "small", "small_batches", "spread", "work_dir"]

#: A table of at most this many rows (of a few dozen bytes each) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (saved, so that counting is cheap) with a broadcast hint if it has at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of ASCII alone take the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def numbered(df: DataFrame, order: Sequence[str], to: str, tag: str) -> DataFrame:
    """df with a gapless global row number from 0 in ascending order of the given columns (nulls first).

    One range shuffle and a local sort; the offsets come from one row for each partition. Rows equal in all order
    columns are numbered in any order. df should be narrow: it is written once.
    """
    parts = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]
    )
    placed = saved(
        parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        tag,
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # one row for each partition of a shuffle: bounded by the number of tasks, not by the data
    return placed.join(F.broadcast(starts), "_part").withColumn(to, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
