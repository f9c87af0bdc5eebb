"""Object logs from tables: bucket, key, op (PUT or DELETE), value, seq (order within a key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.work import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), key.alias("key"), F.lit("PUT").alias("op"), F.col("text").alias("value"), F.struct("doc_id").alias("seq"))


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select(F.lit("pages").alias("bucket"), key.alias("key"), F.lit("PUT").alias("op"), F.col("html").alias("value"), F.struct("page_id").alias("seq"))


def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("conv_id").cast("string"), 10, "0")
    return table(spark, sf_dir, "conversations").select(F.lit("conv").alias("bucket"), key.alias("key"), F.lit("PUT").alias("op"), F.col("text").alias("value"), F.struct("turn").alias("seq"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k"))
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    return table(spark, sf_dir, "events").select(F.lit("events").alias("bucket"), key.alias("key"), op.alias("op"), F.col("props").alias("value"), F.struct("ts", "event_id").alias("seq"))


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("l_orderkey").cast("string"), 10, "0")
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")], "l_returnflag", "l_linestatus")
    op = F.when(F.col("l_returnflag") == "R", "DELETE").otherwise("PUT")
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.lit("items").alias("bucket"), key.alias("key"), op.alias("op"), F.when(op == "PUT", value).alias("value"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("seq")
    )
