"""Token ids in fixed-width bit packing.

An image holds the ids of consecutive documents: a header, the documents' ends, the offsets of the blocks, and the
blocks, in which every id takes the fewest bits that hold the vocabulary, lowest bit first. A block of 4,096 ids begins
at a byte, so that numpy unpacks any block, and with it any document, without the ones before it. Images are rows
of Parquet, so that every store that Spark writes can hold them, in ascending order of (part, seq).
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.bpe import ODD, PIECES, PieceCoder, per_worker, text_batches
from tidelog.llm.common import BROADCAST_ROWS

#: Pieces that can be lines of a text without a change to their ids, and how many make a text.
LINE, LINES = re.compile(r" ?\S+"), 1_000
MAGIC, BLOCK = b"TLPK", 4096
HEAD = "<4sHHIQI"  # magic, version, bits, documents, ids, ids in a block
#: Ids in an image before the next one begins; one longer document is an image of its own.
IMAGE_IDS = 1_000_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def to_image(docs: list[np.ndarray], bits: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    ends = np.cumsum([len(d) for d in docs], dtype=np.uint64)
    offsets = np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    head = struct.pack(HEAD, MAGIC, 1, bits, len(docs), len(ids), BLOCK)
    return b"".join([head, ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Image:
    """A packed image, read without copying what isn't asked for."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.n_docs, self.n_ids, self.block = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a packed image")
        blocks = -(-self.n_ids // self.block)
        self.ends = np.frombuffer(data, "<u8", self.n_docs, struct.calcsize(HEAD))
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, struct.calcsize(HEAD) + 8 * self.n_docs)
        self.data, self.base = memoryview(data), struct.calcsize(HEAD) + 8 * (self.n_docs + blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start to end of the image; only the blocks that hold them are unpacked."""
        first, last = start // self.block, -(-end // self.block)
        parts = [
            unpack(self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])], min(self.block, self.n_ids - k * self.block), self.bits)
            for k in range(first, last)
        ]
        got = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return got[start - first * self.block : end - first * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class Library(PieceCoder):
    """The tokenizers library's encoder behind a cache of pieces at whose borders its pre-tokenizer always splits."""

    young = 200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.break_ids = self.plain(["\n"])[0]
        super().__init__()

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without offsets

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Pieces without white space (but a leading blank) are encoded as the lines of texts, the rest one by one."""
        lines = list(filter(LINE.fullmatch, pieces))
        told = dict(zip(lines, self.of_lines(lines)))
        rest = [p for p in pieces if p not in told]
        told.update(zip(rest, (x.tobytes() for x in self.plain(rest))))
        return list(map(told.__getitem__, pieces))

    def of_lines(self, lines: list[str]) -> list[bytes]:
        if len(self.break_ids) != 1:
            return []
        out = []
        for at, ids in zip(range(0, len(lines), LINES), self.plain(["\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)])):
            some = lines[at : at + LINES]
            ends = [*(4 * np.flatnonzero(ids == self.break_ids[0])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            if len(ends) == len(some):
                out += [raw[i:j] for i, j in zip([0, *(e + 4 for e in ends)], ends)]
            else:
                out += [x.tobytes() for x in self.plain(some)]
        return out

    def cut(self, text: str) -> list[str]:
        return [text] if ODD.search(text) else PIECES.findall(text)


def write_images(docs: DataFrame, tokenizer: str, to: str, end_id: int | None = 0) -> None:
    """Encode texts (null: empty) in ascending order of (doc_id, text), nulls first, and write them as images to a folder.

    end_id is appended to every document. One range shuffle of the texts; a task writes its images as it goes.
    """

    def run(batches):
        lib = per_worker(Library, tokenizer)
        bits, part, seq = max(1, int(lib.size - 1).bit_length()), TaskContext.get().partitionId(), 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        names, held, n = [], [], 0

        def image():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([to_image(held, bits)], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "image"],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, some in text_batches(batch):
                for k, x in enumerate(lib.encode_batch(some)):
                    x = np.concatenate((x, tail))
                    if held and n + len(x) > IMAGE_IDS:
                        yield image()
                        names, held, n, seq = [], [], 0, seq + 1
                    names.append(ids[at + k])
                    held.append(x)
                    n += len(x)
        if held:
            yield image()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    ranged.mapInArrow(run, "part int, seq int, n_ids bigint, doc_ids array<bigint>, image binary").write.parquet(to)


def read_images(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, with ids also ids array<int>, from a folder of images."""

    def run(batches):
        for batch in batches:
            for part, seq, names, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "image"))):
                img, at = Image(data), 0
                whole, ends = img.ids(0, img.n_ids), img.ends.tolist()
                starts = [0, *ends[:-1]]
                cols = [
                    pa.array([part] * len(names), pa.int32()),
                    pa.array([seq] * len(names), pa.int32()),
                    pa.array(names, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                    pa.array([zlib.crc32(whole[s:e].astype("<u4")) for s, e in zip(starts, ends)], pa.int64()),
                ]
                if ids:
                    cols.append(pa.array([whole[s:e].astype(np.int32) for s, e in zip(starts, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "_from", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    files = spark.read.schema("part int, seq int, n_ids bigint, doc_ids array<bigint>, image binary").parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # parts are tasks of one shuffle, so their number is bounded by the cluster's settings
    starts = sizes.withColumn("lead", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("lead")).alias("base"))
    if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    docs = files.select("part", "seq", "doc_ids", "image").mapInArrow(
        run, "part int, seq int, doc_id bigint, _from bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    )
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("_from")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
