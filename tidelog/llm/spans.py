"""Substring dedup by sliding sentence spans.

From every sentence goes the shortest run of at least MIN_SENTENCES sentences and MIN_WORDS words, forwards and backwards; runs are
hashed and joined globally. A sentence goes if a run that covers it occurred before: the first occurrence, by doc_id, hash of
the text and position, stays. With runs in both directions, a passage repeated between sentence borders is covered whole if it has that many
sentences and words; a sentence of LONG words or more is a run by itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import saved

MIN_SENTENCES, MIN_WORDS, LONG = 2, 16, 40
#: A sentence ends after its closing marks or at a line end; white space between sentences belongs to the one before.
SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…]+(?!\s|\Z)[^.!?…\n]*)*(?:[.!?…]+\s*|\n\s*|\Z)")


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they are the text."""
    return [s for s in SENTENCE.findall(text) if s]


def runs(parts: list[str], min_sentences: int, min_words: int, long: int) -> list[tuple[int, int]]:
    """start, end of the runs of sentences, without repeats."""
    n = len(parts)
    words = np.concatenate(([0], np.cumsum([len(p.split()) for p in parts]))) if n else np.zeros(1, np.int64)
    at = np.arange(n)
    ends = np.maximum(np.searchsorted(words, words[:-1] + min_words), at + min_sentences)
    starts = np.minimum(np.searchsorted(words, words[1:] - min_words, "right") - 1, at + 1 - min_sentences)
    alone = np.flatnonzero(np.diff(words) >= long)
    out = np.concatenate(
        [np.stack([at, ends], 1)[ends <= n], np.stack([starts, at + 1], 1)[(starts >= 0) & (words[1:] >= min_words)], np.stack([alone, alone + 1], 1)]
    )
    return np.unique(out, axis=0).tolist() if len(out) else []


def _hash(parts: list[str]) -> int:
    """XXH64 of the words of a run, as a signed long; white space and case don't count."""
    return int(np.uint64(xxhash.xxh64_intdigest(" ".join(" ".join(parts).lower().split()).encode("utf-8", "replace"))).astype(np.int64))


def spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long: int = LONG) -> DataFrame:
    """doc_id, text_hash, hash, start, end of every run of every text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                row, hashes, starts, ends = [], [], [], []
                for k, text in enumerate(part.column("text")):
                    if not (t := text.as_py()):
                        continue
                    parts = sentences(t)
                    clean = [" ".join(p.lower().split()) for p in parts]
                    for i, j in runs(clean, min_sentences, min_words, long):
                        row.append(k)
                        hashes.append(xxhash.xxh64_intdigest(" ".join(clean[i:j]).encode("utf-8", "replace")))
                        starts.append(i)
                        ends.append(j)
                of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of), part.column("text_hash").take(of), pa.array(np.array(hashes, np.uint64).astype(np.int64)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    ["doc_id", "text_hash", "hash", "start", "end"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash bigint, hash bigint, start int, end int")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_hash, starts, ends of the runs of each document that occurred before, in order of (doc_id, text_hash, start)."""
    found = saved(spans(docs, **how), "spans")
    # one row a hash and task goes into the shuffle, however often a run stands
    many = found.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).where("n > 1")
    many = saved(many.select("hash", F.when(F.col("nulls") == 0, F.col("doc")).alias("first")), "many")
    again = saved(found.join(many, "hash"), "again")
    own = again.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("hash", "text_hash").agg(F.min("start").alias("at"))
    own = own.groupBy("hash").agg(F.min(F.struct("text_hash", "at")).alias("x")).select("hash", F.col("x.text_hash").alias("first_hash"), F.col("x.at").alias("at"))
    own = saved(own, "own")
    before = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("start") <= F.col("at"))
    later = again.join(own, "hash").where(~before)
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("cut"))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with text without the sentences that a repeated run covers.

    Left are all rows, texts without repeats as they are, null texts null. Text that becomes blank is empty. Rows
    equal in doc_id and text count as one document (a run at one place of both isn't repeated); rows of one doc_id and
    other texts are documents of their own, in order of the hash of the text. Null doc_ids come first. n_chars, where there is such a column of longs, is set anew. Empty input: empty result.
    """
    return _without(docs, repeated(docs, **how)).drop("n_removed")


def dedup_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text (without repeated passages), n_removed (sentences) of every row; see dedup()."""
    return _without(docs.select("doc_id", "text"), repeated(docs, **how))


def _without(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    names = docs.columns
    cuts = saved(cuts, "cuts").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    keyed = docs.withColumns({"_key": F.col("doc_id"), "_text": F.xxhash64("text")})
    both = keyed.join(cuts, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").select(*names, "cut")

    def run(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts, gone = batch.column("text").to_pylist(), [0] * batch.num_rows
            for k, cut in enumerate(batch.column("cut")):
                if cut.is_valid and texts[k]:
                    parts, away = sentences(texts[k]), set()
                    for x in cut.as_py():
                        away.update(range(x["start"], min(x["end"], len(parts))))
                    texts[k] = "".join(p for i, p in enumerate(parts) if i not in away).strip()
                    gone[k] = len(away)
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols and pa.types.is_int64(cols["n_chars"].type):
                cols["n_chars"] = pa.array([c if g == 0 else len(t) for c, g, t in zip(cols["n_chars"].to_pylist(), gone, texts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(gone, pa.int64())], [*names, "n_removed"])

    out = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())])
    return both.mapInArrow(run, out)
