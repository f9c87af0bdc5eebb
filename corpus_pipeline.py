"""From raw documents to token ids: language ID, near copies, repeated passages, benchmark passages, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, common, langid, neardup, queries, spans, winnow


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid model accepts; it learns from the documents' own labels."""
    return langid.accepted(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words have a similarity of 0.8 or more."""
    return neardup.one_of_each(docs, words=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; documents of which nothing is left go."""
    return spans.dedup(docs).where("text <> ''")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window of 13 words occurs."""
    return winnow.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, as counts and digests, and the digests of the texts that they decode to."""
    return bpe.encode_decode(docs, queries.vocabulary())


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("decontamination", decontamination), ("tokens", tokens)]

#: Models, shingle similarities and merges aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.work_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        with common.small_batches(spark):
            out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
