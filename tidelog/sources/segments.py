"""Segment files read with Spark: read_segments(spark, path).

A file is read whole by one task. Strict by default: a bad magic number, check sum or a short record is an error; with drop_tail
a record cut short at the end is left out without one.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import RECORD_FOOTER, RECORD_HEADER, RECORD_MAGIC
from tidelog.work import saved

def _records(data: bytes, drop_tail: bool = False):
    """(start, flags, start of the name, its length, that of the value, crc) of the records of a segment, each checked."""
    at, view, size = 0, memoryview(data), len(data)
    while at < size:
        if size - at < RECORD_HEADER:
            if drop_tail:
                return
            raise ValueError(f"record cut short at {at}")
        magic, flags, n_key, n_value, crc = struct.unpack_from(">IBHQI", data, at)
        if magic != RECORD_MAGIC:
            raise ValueError(f"bad magic number at {at}")
        body = at + RECORD_HEADER
        foot = body + n_key + n_value
        if foot + RECORD_FOOTER > size:
            if drop_tail:
                return
            raise ValueError(f"record cut short at {at}")
        if zlib.crc32(view[body:foot], FLAG_CRC[flags]) != crc or struct.unpack_from(">I", data, foot)[0] != crc:
            raise ValueError(f"bad check sum at {at}")
        yield at, flags, body, n_key, n_value, crc
        at = foot + RECORD_FOOTER


def scan(data: bytes, drop_tail: bool = False):
    """(start, flags, internal key, value, crc) of the records of a segment."""
    for at, flags, body, n_key, n_value, crc in _records(data, drop_tail):
        yield at, flags, data[body : body + n_key].decode(), data[body + n_key : body + n_key + n_value], crc


#: The check sum of each flag, which those of records go on from.
FLAG_CRC = [zlib.crc32(bytes([f])) for f in range(256)]
#: Records, and bytes of values, that a scan hands on at once.
ROWS, BYTES = 10_000, 1 << 22


def _columns(data: bytes, found: list):
    """Arrays record_start, flags, bucket, key, value, crc of records found in data by _records(): bytes are gathered, not cut one by one."""
    import numpy as np
    import pyarrow as pa

    start, flags, body, n_key, n_value, crc = np.array(found, np.int64).T
    raw = np.frombuffer(data, np.uint8)

    def gathered(kind, first, n):
        offsets = np.concatenate(([0], np.cumsum(n)))
        places = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], n)
        return pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[places])])

    nul = np.flatnonzero(raw == 0)
    cut = nul[np.minimum(np.searchsorted(nul, body), len(nul) - 1)] if len(nul) else body - 1
    if ((cut < body) | (cut >= body + n_key)).any():
        raise ValueError("a name without a bucket")
    bucket, key = gathered(pa.string(), body, cut - body), gathered(pa.string(), cut + 1, body + n_key - cut - 1)
    bucket.validate(full=True)
    key.validate(full=True)
    return [pa.array(start), pa.array(flags, pa.int64()).cast(pa.int32()), bucket, key, gathered(pa.binary(), body + n_key, n_value), pa.array(crc)]


def _scanned(files: DataFrame, names: list[str], kinds: str, drop_tail: bool) -> DataFrame:
    """The records of the segments in column content, after the named columns of their rows."""
    import pyarrow as pa

    fields = ["record_start", "flags", "bucket", "key", "value", "crc"]

    def run(batches):
        for batch in batches:
            made, of, held = [], [], [0, 0]  # columns of records, the rows they are from, records and bytes held

            def out():
                cols = [pa.concat_arrays(c) for c in zip(*made)]
                rows = pa.concat_arrays(of)
                made.clear(), of.clear()
                held[:] = 0, 0
                return pa.RecordBatch.from_arrays([*(batch.column(n).take(rows) for n in names), *cols], [*names, *fields])

            for at in range(batch.num_rows):
                data, found = batch.column("content")[at].as_py(), []

                def add():
                    made.append(_columns(data, found))
                    of.append(pa.repeat(pa.scalar(at, pa.int64()), len(found)))
                    found.clear()

                for record in _records(data, drop_tail):
                    found.append(record)
                    held[0] += 1
                    held[1] += record[4]
                    if held[0] >= ROWS or held[1] >= BYTES:
                        add()
                        yield out()
                if found:
                    add()
            if made:
                yield out()

    return files.select(*names, "content").mapInArrow(run, f"{kinds}, record_start bigint, flags int, bucket string, key string, value binary, crc bigint")


def read_segments(spark: SparkSession, path: str, drop_tail: bool = False) -> DataFrame:
    """The records of segment files, whatever store they are in: a file is a row of Spark's binary reader."""
    return _scanned(spark.read.format("binaryFile").load(path), ["path"], "path string", drop_tail)


def images(records: DataFrame) -> DataFrame:
    """partition_id, segment_id, name, n_records, content (the bytes of its file) of each segment, without gaps.

    records: bucket, key, op, value, partition_id, segment_id, record_start. Each task puts consecutive records of a segment together,
    and writes such pieces to the shared folder. A piece between two records that touch it and are of other segments
    is a whole segment; only the other pieces, those at the ends of tasks and of the log and at gaps, are dealt by
    segment and joined. So records in the log's order, as offsets() has them, go through no shuffle; others do. The
    images are rows, so any store that Spark writes to holds them; read_images() scans them.
    """
    import numpy as np
    import pyarrow as pa

    from tidelog.functions import encode_record, segment_name

    fields = ["partition_id", "segment_id", "first", "n_records", "whole", "content"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def batch_of(rows):
        cols = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], fields)

    def pieces(batches):
        at, end, parts, n, first, begun = None, None, [], 0, 0, False  # the open piece: its segment, end, bytes, records, start
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            p, s, start = (batch.column(c).to_numpy() for c in ("partition_id", "segment_id", "record_start"))
            record = batch.column("record").cast(pa.large_binary())
            if record.null_count:
                raise ValueError("a record without bucket or key")
            offsets = np.frombuffer(record.buffers()[1], np.int64)[record.offset : record.offset + rows + 1]
            data, ends = memoryview(record.buffers()[2]), start + np.diff(offsets)
            touches = np.concatenate(([at is not None and at[0] == p[0] and end == start[0]], (p[1:] == p[:-1]) & (ends[:-1] == start[1:])))
            same = touches & np.concatenate(([at is not None and at[1] == s[0]], s[1:] == s[:-1]))
            cuts = [0, *(np.flatnonzero(~same[1:]) + 1).tolist(), rows]
            closed = []
            for i, j in zip(cuts, cuts[1:]):
                if not same[i]:
                    if n:
                        closed.append((*at, first, n, begun and bool(touches[i]), b"".join(parts)))
                    at, parts, n, first, begun = (p[i], s[i]), [], 0, int(start[i]), bool(touches[i]) or start[i] == 0
                parts.append(bytes(data[offsets[i] : offsets[j]]))
                n += j - i
            end = int(ends[-1])
            yield batch_of(closed)
        yield batch_of([(*at, first, n, False, b"".join(parts))] if n else [])

    def joined(batches):
        at, n, parts = None, 0, []
        for batch in batches:
            closed = []
            for p, s, k, part in zip(*(batch.column(c).to_pylist() for c in ("partition_id", "segment_id", "n_records", "content"))):
                if (p, s) != at:
                    if n:
                        closed.append((*at, 0, n, True, b"".join(parts)))
                    at, n, parts = (p, s), 0, []
                n += k
                parts.append(part)
            yield batch_of(closed)
        yield batch_of([(*at, 0, n, True, b"".join(parts))] if n else [])

    schema = "partition_id int, segment_id int, first bigint, n_records bigint, whole boolean, content binary"
    record = encode_record(F.col("bucket"), F.col("key"), F.col("value"), F.col("op") == "DELETE")
    written = saved(records.select("partition_id", "segment_id", "record_start", record.alias("record")).mapInArrow(pieces, schema), "images")
    rest = written.where("not whole").repartition("partition_id", "segment_id").sortWithinPartitions("partition_id", "segment_id", "first")
    made = written.where("whole").unionByName(rest.mapInArrow(joined, schema))
    return made.select("partition_id", "segment_id", segment_name(F.col("segment_id")).alias("name"), "n_records", "content")


def read_images(files: DataFrame, drop_tail: bool = False) -> DataFrame:
    """The records of segment images: partition_id, segment_id, record_start (in the file), flags, bucket, key, value, crc."""
    return _scanned(files, ["partition_id", "segment_id"], "partition_id int, segment_id int", drop_tail)


def intact(record: Column, flags: Column, name: Column, crc: Column) -> Column:
    """Whether a record's stored check sum is that of its flag, name and value."""
    return F.crc32(F.concat(F.unhex(F.lpad(F.hex(flags), 2, "0")), F.encode(name, "UTF-8"), record)) == crc
