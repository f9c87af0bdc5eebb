"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved

#: Training documents of a language at most: those of the least hash. The only sample; texts are taken whole.
TRAIN_DOCS = 300
#: Dimensions of the hashed vectors, byte lengths of the n-grams, centroids of a language.
DIMS, SIZES, CENTROIDS = 1 << 13, (2, 3, 4), 4
#: Rejected: a best cosine under this part of the least that is usual (a 200th) for excerpts of the training documents of about the text's size.
REJECT, USUAL = 0.9, 0.005
#: Lengths of those excerpts, and how many a size needs (a size with fewer takes the limit of the one before).
EXCERPTS, ENOUGH = (8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384), 50
#: Bytes of a text hashed at once.
BLOCK = 1 << 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Bytes that are no letters become blanks.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
BLANKS = re.compile(rb"  +")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of a text's lower-cased letters, words framed by blanks."""
    raw = BLANKS.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" ")
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw[at : at + BLOCK + max(SIZES) - 1], np.uint8).astype(np.uint32)
        mixed = np.zeros(len(b), np.uint32)
        for n in range(1, max(SIZES) + 1):
            m = len(b) - n + 1
            if m <= 0:
                break
            mixed = mixed[:m] + b[n - 1 :] * np.uint32(MULTIPLIERS[n - 1])
            if n in SIZES:
                h = (mixed[: min(m, BLOCK)] ^ (mixed[: min(m, BLOCK)] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out += np.bincount(h >> np.uint32(32 - 13), minlength=DIMS)
    return out


def sizes(x: np.ndarray) -> np.ndarray:
    """The power of two of the size of texts, in bytes of letters and blanks, from their counts."""
    return np.log2(np.maximum(1, x.sum(axis=1) // len(SIZES))).astype(int)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts as sublinear term frequencies, weighted and normalised."""
    x = np.log1p(x.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest points."""
    mean = x.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-9)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (near == i).any():
                m = x[near == i].sum(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-9)
    return c


class Model:
    """Centroids (rows), their languages, the idf weights and rejection limits by size of text."""

    def __init__(self, langs: list[str], x: np.ndarray):
        self.langs = sorted(set(langs))
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
        x, of = weighted(x, self.idf), np.array([self.langs.index(lang) for lang in langs])
        groups = [clustered(x[of == i], CENTROIDS) for i in range(len(self.langs))]
        self.centroids = np.concatenate(groups).astype(np.float32) if groups else np.zeros((0, DIMS), np.float32)
        self.owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        self.limit = np.zeros(64)

    def calibrate(self, size: np.ndarray, cosine: np.ndarray) -> None:
        """Set the limits from the sizes (powers of two) and best cosines of excerpts; sizes under the least excerpt have none."""
        for k in range(int(np.log2(EXCERPTS[0])), len(self.limit)):
            mine = cosine[size == k]
            self.limit[k] = REJECT * np.quantile(mine, USUAL) if len(mine) >= ENOUGH else self.limit[k - 1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language (by number) of the nearest centroid to each row of counts, and the cosine (0 to 1)."""
        near = weighted(x, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        return self.owner[best], np.clip(near[np.arange(len(x)), best].astype(np.float64), 0, 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines to the nearest centroids, and whether they are too far away for a text of that size."""
        if not len(self.centroids):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x = np.stack([counts(t) for t in texts])
        lang, score = self.nearest(x)
        return [self.langs[i] for i in lang], score, score < self.limit[sizes(x)]


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of doc_id as text, modulo 4, is 2. A null doc_id isn't held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Model:
    """A model of the labelled rows that aren't held out: per_lang of each language at most, picked by a hash of doc_id.

    Rows equal in doc_id, text and language count once. Texts are counted where they are: the driver gets at most DIMS
    counts of each picked row, and of its excerpts a size and a cosine each.
    """
    pool = held_out(docs.select("doc_id", "text", "lang")).where("not held_out and lang is not null").where(F.col("text").rlike(r"\pL"))
    pool = pool.select("doc_id", "text", "lang", F.xxhash64("text").alias("hash"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash")
    # rows equal in all of these have one rank, so none is picked twice over
    ids = pool.select("lang", "doc_id", "hash").withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= per_lang)
    ids = ids.groupBy("lang", "doc_id", "hash").agg(F.first("nth").alias("nth"))
    ids = ids.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    picked = pool.join(F.broadcast(ids), same, "left_semi")  # at most per_lang rows a language
    picked = saved(picked.dropDuplicates(["lang", "doc_id", "hash"]).select("lang", "hash", "text"), "training")

    def count(batches):
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("text")]
            at = [np.flatnonzero(x) for x in found]
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64())]
            cols = [[k.tolist() for k in at], [x[k].tolist() for x, k in zip(found, at)]]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["lang", "hash", "at", "n"])

    rows = sorted(picked.mapInArrow(count, "lang string, hash bigint, at array<int>, n array<bigint>").collect(), key=lambda r: (r.lang, r.hash))
    x = np.zeros((len(rows), DIMS), np.int64)
    for k, r in enumerate(rows):
        x[k, r.at] = r.n
    model = Model([r.lang for r in rows], x)
    if not rows:
        return model

    def measure(batches):
        for batch in batches:
            size, cosine = [], []
            for t in batch.column("text"):
                t = t.as_py()
                x = np.stack([counts(t[:n]) for n in EXCERPTS if n <= len(t)] + [counts(t)])
                size += sizes(x).tolist()
                cosine += model.nearest(x)[1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(cosine, pa.float64())], ["size", "cosine"])

    found = picked.mapInArrow(measure, "size int, cosine double").collect()
    model.calibrate(np.array([r["size"] for r in found]), np.array([r.cosine for r in found]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs, from its text alone.

    Null texts and those without a letter are `und` with score 0, and rejected. A model without languages rejects
    all. Repeated rows come out as they went in; a null doc_id isn't held out. Empty input: empty result.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text")
                read = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False))
                lang, score, out = np.full(len(part), "und", object), np.zeros(len(part)), np.ones(len(part), bool)
                if len(read):
                    lang[read], score[read], out[read] = model.predict(texts.take(pa.array(read)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(out)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return held_out(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns and duplicates, whose text the model doesn't reject."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(at, 256)
                read = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False))
                if len(read):
                    keep[at + read] = ~model.predict(texts.take(pa.array(read)).to_pylist())[2]
            yield batch.filter(pa.array(keep))

    return docs.select(*names).mapInArrow(run, docs.schema)
