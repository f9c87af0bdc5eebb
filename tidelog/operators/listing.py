"""Listings: prefix, delimiter, pages and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import NUL, encode_token, iso_millis, xml_escape


def entries(keys: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", after: str = "") -> DataFrame:
    """kind (K key, P common prefix), name, first_key, size of a bucket's listing from key `after` (inclusive) on.

    keys: bucket, key, size. Bucket, prefix and start are filters that reach the scan. Keys below a common prefix are
    summed before the shuffle.
    """
    start = max(after, prefix)
    some = keys.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix) & (F.col("key") >= start))
    if delimiter:
        at = F.locate(delimiter, F.col("key"), len(prefix) + 1)
        name = F.when(at > 0, F.substring(F.col("key"), F.lit(1), at + len(delimiter) - 1)).otherwise(F.col("key"))
        kind = F.when(at > 0, "P").otherwise("K")
    else:
        name, kind = F.col("key"), F.lit("K")
    some = some.select(kind.alias("kind"), name.alias("name"), "key", "size")
    return some.groupBy("kind", "name").agg(F.min("key").alias("first_key"), F.when(F.col("kind") == "K", F.max("size")).alias("size"))


def page(keys: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", after: str = "", max_keys: int = 1000) -> DataFrame:
    """kind, name, size, truncated, next_key, token of one page.

    Keys and common prefixes share max_keys. next_key is the first key that the page doesn't consume: after its last
    entry's first key, so a common prefix can come again on the next page. With max_keys 0 a single row of kind N
    carries the page's own columns.
    """
    all_entries = entries(keys, bucket, prefix, delimiter, after)
    start = max(after, prefix)
    live = keys.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix) & (F.col("key") >= start)).select("key")
    if max_keys == 0:
        tail = live.agg(F.min("key").alias("next_key"))
        return tail.select(F.lit("N").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("size"), F.col("next_key").isNotNull().alias("truncated"), "next_key", encode_token(F.col("next_key")).alias("token"))
    shown = all_entries.orderBy("first_key").limit(max_keys)  # a page: max_keys rows at most
    end = shown.agg(F.max("first_key").alias("end"), F.count("*").alias("n"))
    tail = live.join(F.broadcast(end), F.col("key") > F.col("end")).where(F.col("n") >= max_keys).agg(F.min("key").alias("next_key"))
    out = shown.join(F.broadcast(tail))
    return out.select("kind", "name", "size", F.col("next_key").isNotNull().alias("truncated"), "next_key", encode_token(F.col("next_key")).alias("token"))


def union_listing(direct: DataFrame, shards: DataFrame) -> DataFrame:
    """bucket, key, size of plain objects and of sharded ones (size 0 where there is no plain copy), each once."""
    sharded = shards.select("bucket", "key").distinct()
    return direct.select("bucket", "key", "size").join(sharded, ["bucket", "key"], "full_outer").select("bucket", "key", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def keys_from(keys: DataFrame, start: str, prefix: str, limit: int) -> DataFrame:
    """The next batch of keys from a checkpoint on, with checkpoint, where the batch after it starts: the last key and a NUL."""
    batch = keys.where(F.col("key").startswith(prefix) & (F.col("key") >= max(start, prefix))).orderBy("key").limit(limit)
    return batch.withColumn("checkpoint", F.concat(F.max("key").over(Window.partitionBy()), F.lit(NUL)))  # the batch is `limit` rows


def as_xml(page: DataFrame, bucket: str, prefix: str = "", delimiter: str | None = None, max_keys: int = 1000, modified: str = "", version: int = 2) -> DataFrame:
    """One row, xml: a page (of page(), max_keys rows at most) in the markup of the object interface.

    Version 2 counts keys and carries tokens, version 1 a plain marker. Keys come first, then common prefixes, each in order.
    """
    text = lambda c: xml_escape(c)
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    contents = F.concat(
        F.lit("  <Contents>\n    "), tag("Key", text(F.col("name"))), F.lit(f"\n    <LastModified>{modified}</LastModified>\n    <ETag>\"\"</ETag>\n    "),
        tag("Size", F.col("size").cast("string")), F.lit("\n    <StorageClass>STANDARD</StorageClass>\n  </Contents>\n"),
    )
    common = F.concat(F.lit("  <CommonPrefixes>"), tag("Prefix", text(F.col("name"))), F.lit("</CommonPrefixes>\n"))
    lines = lambda kind, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", c.alias("line"))))), lambda x: x["line"]), "")
    rows = page.agg(
        F.count_if(F.col("kind") != "N").alias("n"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), F.max("next_key").alias("next_key"), F.max("token").alias("token"),
        lines("K", contents).alias("contents"), lines("P", common).alias("prefixes"),
    )
    fixed = lambda s: xml_escape(F.lit(s))
    head = [
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">\n  '), tag("Name", fixed(bucket)), F.lit("\n  "), tag("Prefix", fixed(prefix)), F.lit("\n"),
        *([F.lit("  "), tag("Delimiter", fixed(delimiter)), F.lit("\n")] if delimiter is not None else []),
        F.lit(f"  <MaxKeys>{max_keys}</MaxKeys>\n  "), tag("IsTruncated", F.col("truncated").cast("string")), F.lit("\n"),
    ]
    if version == 2:
        head += [F.lit("  "), tag("KeyCount", F.col("n").cast("string")), F.lit("\n")]
    name, value = ("NextContinuationToken", F.col("token")) if version == 2 else ("NextMarker", text(F.col("next_key")))
    head.append(F.when(F.col("truncated"), F.concat(F.lit("  "), tag(name, value), F.lit("\n"))).otherwise(""))
    return rows.select(F.concat(*head, "contents", "prefixes", F.lit("</ListBucketResult>")).alias("xml"))


def buckets_as_xml(buckets: DataFrame, owner: str) -> DataFrame:
    """One row, xml: the buckets (bucket, created as a timestamp) in order of name. The registry of buckets is small."""
    one = F.concat(F.lit("    <Bucket>\n      <Name>"), xml_escape(F.col("bucket")), F.lit("</Name>\n      <CreationDate>"), iso_millis(F.col("created")), F.lit("</CreationDate>\n    </Bucket>\n"))
    rows = buckets.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", one.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<ListAllMyBucketsResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">\n  <Owner><ID>{owner}</ID><DisplayName>{owner}</DisplayName></Owner>\n  <Buckets>\n'
    return rows.select(F.concat(F.lit(head), "lines", F.lit("  </Buckets>\n</ListAllMyBucketsResult>")).alias("xml"))
