"""Benchmark decontamination by winnowing. DataFrame functions only.

The least of every SPAN - GRAM + 1 neighbouring hashes of GRAM words is a fingerprint, so every shared span of SPAN
words shares one. Documents that share a fingerprint with an item are looked at again: their windows of SPAN words
that occur in items are the extended hits. Items of fewer words are single windows of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, saved, small

SPAN, GRAM = 13, 8


def word_hashes(text: Column) -> Column:
    """Hashes of the words: runs of digits, ASCII letters (A-Z lower-cased) and all that isn't ASCII."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(a: Column, by: int, f) -> Column:
    """f of each entry and the one `by` places on."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(a) - by), F.slice(a, F.lit(1 + by), F.size(a) - by), f)


def with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with an array h of word hashes) with g<n>, the hashes of all runs of n words, for each length; steps double."""
    have = 1
    df = df.withColumn("g1", F.col("h"))
    mix = lambda x, y: F.xxhash64(x, y)
    empty = F.expr("cast(array() as array<bigint>)")
    while 2 * have <= max(lengths):
        g = F.col(f"g{have}")
        df = df.withColumn(f"g{2 * have}", F.when(F.size(g) > have, _joined(g, have, mix)).otherwise(empty))
        have *= 2
    for n in lengths:
        p = 1 << (n.bit_length() - 1)
        if n != p:
            g = F.col(f"g{p}")
            df = df.withColumn(f"g{n}", F.when(F.size(g) > n - p, _joined(g, n - p, mix)).otherwise(empty))
    return df


def with_winnowed(df: DataFrame) -> DataFrame:
    """df (with g8) with fps, the distinct least hashes of 6 neighbouring ones; none for fewer than 13 words."""
    least = lambda x, y: F.least(x, y)
    enough = F.size(f"g{GRAM}") > SPAN - GRAM
    two = F.when(enough, _joined(F.col(f"g{GRAM}"), 1, least))
    df = df.withColumn("m2", two).withColumn("m4", _joined(F.col("m2"), 2, least))
    six = F.zip_with(F.slice("m4", F.lit(1), F.size("m2") - 4), F.slice("m2", F.lit(5), F.size("m2") - 4), least)
    return df.withColumn("fps", F.when(F.size("m2") >= 5, F.array_distinct(six))).drop("m2", "m4")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, text_hash, n_words) and their hits (doc_id, text_hash, start, end, item_id): words start to end - 1."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    items = saved(items, "items")
    # at most SPAN - 1 lengths
    short = sorted(r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect())
    lengths = sorted({SPAN, *short})
    grams = with_winnowed(with_grams(items, [GRAM, *lengths]))
    keys = [F.when(F.size("h") >= SPAN, F.col("fps")), *[F.when(F.size("h") == n, F.col(f"g{n}")) for n in short]]
    probe = small(saved(grams.select(F.explode(F.flatten(F.array_compact(F.array(*keys)))).alias("fp")).distinct(), "probe"))
    windows = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.size("h") == n if n < SPAN else F.size("h") >= n, F.col(f"g{n}")).alias("g")) for n in lengths])
    windows = grams.select("item_id", F.explode(windows).alias("w")).select("item_id", F.col("w.n").alias("n"), F.explode("w.g").alias("g")).distinct()
    windows = small(saved(windows, "windows"))

    base = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    read = base.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("h"))
    mine = with_winnowed(with_grams(read, [GRAM, *short]))
    keys = [F.col("fps"), *[F.array_distinct(f"g{n}") for n in short]]
    found = mine.select("doc_id", "text_hash", F.explode(F.flatten(F.array_compact(F.array(*keys)))).alias("fp"))
    found = saved(found.join(probe, "fp", "left_semi").select("doc_id", "text_hash").distinct(), "candidates")
    again = base.alias("d").join(
        small(found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
        "left_semi",
    )
    again = with_grams(again.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("h")), lengths)
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"g{n}").alias("g")) for n in lengths])
    at = again.select("doc_id", "text_hash", F.explode(grams).alias("w")).select("doc_id", "text_hash", F.col("w.n").alias("n"), F.posexplode("w.g").alias("start", "g"))
    at = at.join(windows, ["n", "g"]).select("doc_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("end"), "item_id").distinct()
    return read.select("doc_id", "text_hash", F.size("h").cast("bigint").alias("n_words")), at


def decontaminate(docs: DataFrame, benchmark: DataFrame, part: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A word is hit if it lies in an occurrence of an item's window (13 words in a row; shorter items whole). Contaminated:
    hit words are a 20th of all or more, and there is one. Null and empty texts have no words; null and empty items no
    windows; an item given twice counts as one if its ids are equal. Rows equal in doc_id and text give equal results.
    Of docs only doc_id and text are read, of benchmark item_id and text. Empty tables: no hits, or no rows.
    """
    return _judged(docs, benchmark, part).drop("text_hash", "holds_span")


def _judged(docs: DataFrame, benchmark: DataFrame, part: int) -> DataFrame:
    """The rows of decontaminate() with text_hash, and holds_span: whether a whole window of SPAN words occurs."""
    read, at = hits(docs, benchmark)
    at = saved(at, "hits")
    per_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    spans = at.groupBy("doc_id", "text_hash", "start").agg(F.max("end").alias("end"))
    whole = F.bool_or(F.col("end") - F.col("start") >= SPAN).alias("holds_span")
    reach = F.coalesce(F.max("end").over(per_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = spans.withColumn("n", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))).groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_hit"), whole)
    of = at.select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = words.join(of, (words.doc_id.eqNullSafe(of.doc_id)) & (words.text_hash == of.text_hash)).select(
        words.doc_id.alias("_id"), words.text_hash.alias("_hash"), "n_hit", "items", "holds_span"
    )
    found = saved(found, "found")
    out = read.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (part * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("holds_span", F.lit(False)).alias("holds_span"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, part: int = 20) -> DataFrame:
    """The rows of docs, all columns, in which no window of SPAN words of an item occurs, however long the text is.

    Items of fewer words may stand in a long text by chance; their hits count where decontaminate() calls the row
    contaminated. Rows go by doc_id and text: a clean row stays though another of its doc_id, or without one, goes.
    Null and empty texts stay.
    """
    bad = _judged(docs, benchmark, part).where("holds_span or contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    bad = saved(bad.distinct(), "contaminated")
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
