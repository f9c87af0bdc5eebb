"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

For term t of weight w (its count) and sample k, r and c are gamma(2, 1) and b is uniform, all drawn by hashing (t, k);
q = floor(ln w / r + b) and ln a = ln c - r (q - b + 1). The sample is the (t, q) of the least a, so two documents
have equal samples with a probability of sum(min) / sum(max) of their weights. ln a depends on t, k and q alone, so
the least value itself stands for the sample, and a running minimum for each k is all that an aggregation keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved

SAMPLES = 32
#: Words: runs between ASCII white space and punctuation.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _sample(term: Column, log_w: Column, k: int) -> Column:
    """ln a of a term (its hash) for sample k."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    # five uniform numbers of bits of their own: 25 each, and 14 of either hash for b
    part = lambda h, at: (F.shiftrightunsigned(h, at).bitwiseAND((1 << 25) - 1) + 1).cast("double") / float(1 << 25)
    r = -F.log(part(one, 0) * part(one, 25)) + 1e-12
    c = -F.log(part(two, 0) * part(two, 25)) + 1e-12
    b = (F.shiftleft(F.shiftrightunsigned(one, 50), 14) + F.shiftrightunsigned(two, 50)).cast("double") / float(1 << 28)
    return F.log(c) - r * (F.floor(log_w / r + b).cast("double") - b + 1)


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint of each text, 4 hex digits a sample; zeros for a text without words. keys name a row.

    Where texts is partitioned by a key, nothing is shuffled; else terms are counted before the shuffle. A text's
    distinct words are groups, so no task keeps a text whole while it aggregates.
    """
    # the last part of the split is empty: it keeps texts without words among the groups, and is no term
    words = texts.select(*keys, F.explode(F.split(F.concat(F.lower("text"), F.lit(" ")), BREAK, -1)).alias("word"))
    terms = words.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counts = terms.groupBy(*keys, "term").agg(F.count("*").alias("w"))
    counts = counts.select(*keys, "term", F.log(F.col("w").cast("double")).alias("log_w"))
    least = counts.groupBy(*keys).agg(*[F.min(F.when(F.col("term").isNotNull(), _sample(F.col("term"), F.col("log_w"), k))).alias(f"s{k}") for k in range(samples)])
    digits = [F.when(F.col(f"s{k}").isNull(), "0000").otherwise(F.lower(F.lpad(F.hex(F.xxhash64(f"s{k}").bitwiseAND(0xFFFF)), 4, "0"))) for k in range(samples)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints, an estimate of the generalised Jaccard similarity."""
    n = (F.length(a) / 4).cast("int")
    same = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: a.substr(4 * i + 1, F.lit(4)) == b.substr(4 * i + 1, F.lit(4))))
    return same.cast("double") / n


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """block, doc_id, text_hash, text, next_text, next_id, next_hash: every row with the row after it in order of (doc_id, text_hash).

    Rows equal in both are one row here, with its number n_rows. After the last row comes the first. Texts are shuffled
    once, into blocks between quantiles of doc_id; a block's last row gets the first row of the next block by a join.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or 4 * n
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # a fixed number of quantiles; they need not be exact
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks)).first()[0]
    cuts = F.array(*[F.lit(x).cast("bigint") for x in sorted(set(cuts or [0]))])
    block = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda x: x <= F.col("doc_id"))))
    base = base.withColumn("block", block.cast("int"))
    heads = saved(base.groupBy("block").agg(F.min(F.struct("doc_id", "text_hash")).alias("h")).select("block", "h.*"), "heads")
    after = Window.orderBy("block")  # one row a block
    turn = heads.select("block", F.lead("doc_id").over(after).alias("doc_id"), F.lead("text_hash").over(after).alias("text_hash"), F.lead("block").over(after).isNull().alias("last"))
    first = heads.orderBy("block").limit(1).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"))
    turn = turn.join(F.broadcast(first)).select("block", F.when(F.col("last"), F.col("f_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("last"), F.col("f_hash")).otherwise(F.col("text_hash")).alias("text_hash"))
    want = F.broadcast(turn.withColumnsRenamed({"block": "to", "doc_id": "_id", "text_hash": "_hash"}))  # one row a block
    heads = base.join(want, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    heads = saved(heads.groupBy("to").agg(F.first("doc_id").alias("h_id"), F.first("text_hash").alias("h_hash"), F.first("text").alias("h_text")), "heads")
    dealt = base.repartition(blocks, "block")
    order = Window.partitionBy("block").orderBy("doc_id", "text_hash")
    dealt = dealt.withColumns({"p_id": F.lag("doc_id").over(order), "p_hash": F.lag("text_hash").over(order), "l_id": F.lead("doc_id").over(order), "l_hash": F.lead("text_hash").over(order), "l_text": F.lead("text").over(order)})
    again = F.col("p_hash").isNotNull() & F.col("p_id").eqNullSafe(F.col("doc_id")) & (F.col("p_hash") == F.col("text_hash"))
    copy = F.col("l_hash").isNotNull() & F.col("l_id").eqNullSafe(F.col("doc_id")) & (F.col("l_hash") == F.col("text_hash"))
    # equal rows stand together: the last of them has the next text, and how many they are
    nth = F.sum(F.when(again, 0).otherwise(1)).over(order)
    dealt = dealt.withColumn("nth", nth).withColumn("n_rows", F.row_number().over(Window.partitionBy("block", "nth").orderBy("doc_id", "text_hash"))).where(~copy)
    out = dealt.join(heads.withColumnRenamed("to", "block").hint("shuffle_hash"), "block", "left")
    end = F.col("l_hash").isNull()
    return out.select(
        "block", "doc_id", "text_hash", "text", "n_rows",
        F.when(end, F.col("h_text")).otherwise(F.col("l_text")).alias("next_text"),
        F.when(end, F.col("h_id")).otherwise(F.col("l_id")).alias("next_id"),
        F.when(end, F.col("h_hash")).otherwise(F.col("l_hash")).alias("next_hash"),
    )


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text ends in as many code points from the start of the next row's text instead of the last half of its
    own. Null texts are empty; a text without words has a fingerprint of zeros, equal to that of another such text
    alone. Rows equal in doc_id and text have the same next row, which is another one, and come out as often as they
    went in. Only doc_id and text are read. Empty input: empty result.
    """
    pairs = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.char_length("text") - half), F.col("next_text").substr(F.lit(1), half))
    pairs = pairs.withColumn("edited", edited)
    keys = ["block", "doc_id", "text_hash", "next_id", "next_hash", "n_rows", "n_chars", "sha", "edit"]
    both = pairs.select(
        "block", "doc_id", "text_hash", "next_id", "next_hash", "n_rows", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("edit"), "text"), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("x"),
    ).select(*keys[:-1], "x.*")
    prints = saved(fingerprints(both, keys, samples), "prints")
    own, edits = prints.where("edit = 0").drop("block"), prints.where("edit = 1").select(F.col("doc_id").alias("e_id"), F.col("text_hash").alias("e_hash"), F.col("fingerprint").alias("edited_fingerprint"))
    follow = prints.where("edit = 0").select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), F.col("fingerprint").alias("f_print"))
    out = own.join(edits, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_hash") == F.col("e_hash")))
    out = out.join(follow, F.col("next_id").eqNullSafe(F.col("f_id")) & (F.col("next_hash") == F.col("f_hash")))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("f_print")).alias("near_next"),
    )
