"""Work tables in the folder that driver and executors share, and inputs of few splits dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker gets at once while a work table is written: bounds executors' memory.
ARROW_ROWS, ARROW_BYTES = 2_000, 4_000_000


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, where it is unset, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, plans that run hand Python workers at most ARROW_ROWS rows and ARROW_BYTES bytes at once."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, computes a shared input once, and gives later joins
    exchanges of their own, so that adaptive execution can split skewed partitions.
    """
    path = f"{work_dir(df.sparkSession)}/tidelog-{tag}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by saved() that no later plan reads."""
    delete(df.sparkSession, df._tidelog_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, in order; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to all cores (by hash of the columns, if given) if it comes in fewer splits than there are, else as it is.

    For costly work on small inputs, which may be a single split; a table of many splits passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def running_total(df: DataFrame, group: str, order: list[str], size: str, to: str, tag: str) -> DataFrame:
    """df with `to`, the sum of `size` (a long) over the rows before it in its group (an int), in the given order (which should be total).

    Ranges of (group, order) are summed on their own and the totals of the ranges before are added, so no task holds
    a group. df is computed twice (the shuffle by range samples it) and written once, after that shuffle: in each file
    rows are in order, and readers of the result get runs of consecutive rows. Python sees groups and sizes alone.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql.pandas.functions import ArrowUDFType

    def run(columns):
        last, held = None, 0  # the group at the end of the batch before, and its sum so far
        for g, n in columns:
            g, n = g.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)
            if not len(g):
                yield pa.array([], pa.int64())
                continue
            before = np.cumsum(n) - n
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            base = np.repeat(before[first], np.diff(np.concatenate((first, [len(g)]))))
            sums = before - base
            if g[0] == last:
                sums[: first[1] if len(first) > 1 else len(g)] += held
            last, held = g[-1], int(sums[-1] + n[-1])
            yield pa.array(sums, pa.int64())

    keys = [group, *order]
    sums = F.arrow_udf(run, "bigint", ArrowUDFType.SCALAR_ITER).asNondeterministic()  # depends on the rows before: not to be moved or repeated
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = saved(parts.withColumn("_sum", sums(group, size)), tag)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", group).agg(F.sum(size).alias("_total"))
    # a row for each range and each group that begins in it: bounded by tasks and groups, not by the data
    starts = totals.select("_part", group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), ["_part", group]).withColumn(to, F.col("_start") + F.col("_sum")).drop("_part", "_sum", "_start")
