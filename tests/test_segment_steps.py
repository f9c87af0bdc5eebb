"""Steps that the queries on written segments share."""

import random
import zlib

from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog import sources, work
from tidelog.operators import compaction, log
from tidelog.sources import segments
from tidelog.work import saved

SF = "/root/testdata/sf0.001"


def test_hash_of_short_and_long_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in range(3 * fn.SHORT) for letters in ("az09~", "aß", "é€字￿", "a😀")]

    def units(t, h=0):
        raw = t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.java_hash(F.col("t")).alias("h"), fn.java_hash(F.col("t"), F.concat("t", F.lit("\0"))).alias("twice")).collect()
    assert [(r.h, r.twice) for r in got] == [(units(r.t), units(r.t + "\0" + r.t)) for r in got]


def test_whole_segments_of_the_log_go_through_no_shuffle(spark, monkeypatch):
    written = []
    monkeypatch.setattr(segments, "saved", lambda df, tag: written.append(saved(df, tag)) or written[-1])
    records = log.in_segments(log.offsets(sources.item_log(spark, SF), values=True), 1024)
    monkeypatch.setattr(work, "ARROW_ROWS", 7)
    got = {(r.partition_id, r.segment_id): (r.n_records, bytes(r.content)) for r in segments.images(records).collect()}
    rec = fn.encode_record(F.col("bucket"), F.col("key"), F.col("value"), F.col("op") == "DELETE")
    want = {}
    for r in records.select("partition_id", "segment_id", "record_start", rec.alias("rec")).orderBy("partition_id", "record_start").collect():
        n, raw = want.get((r.partition_id, r.segment_id), (0, b""))
        want[r.partition_id, r.segment_id] = n + 1, raw + bytes(r.rec)
    assert got == want and len(got) > 250
    assert written[0].where("not whole").count() < 60  # ends of partitions and of splits


def test_images_of_records_with_gaps_and_in_any_order(spark):
    records = log.in_segments(log.offsets(sources.item_log(spark, SF), values=True), 1024).where(F.xxhash64("record_start") % 5 != 0)
    want = sorted((r.partition_id, r.segment_id, bytes(r.content)) for r in segments.images(records).collect())
    mixed = saved(records, "mixed").repartition(5, "key")
    assert sorted((r.partition_id, r.segment_id, bytes(r.content)) for r in segments.images(mixed).collect()) == want
    back = segments.read_images(segments.images(mixed))
    assert back.count() == records.count() and back.select("partition_id", "segment_id").distinct().count() == len(want)


def test_scans_hand_on_parts_of_large_segments(spark, monkeypatch):
    df = spark.createDataFrame([("b", f"k{i}é", "x" * (i % 50), i % 7 == 0) for i in range(100)], "bucket string, key string, value string, gone boolean").coalesce(1)
    data = b"".join(bytes(r.r) for r in df.select(fn.encode_record(F.col("bucket"), F.col("key"), F.col("value"), F.col("gone")).alias("r")).collect())
    files = spark.createDataFrame([(1, 1, data), (1, 2, b""), (1, 3, data[:-5])], "partition_id int, segment_id int, content binary").coalesce(1)
    monkeypatch.setattr(segments, "ROWS", 9)
    got = [(r.segment_id, r.record_start, r.flags, r.bucket, r.key, bytes(r.value), r.crc) for r in segments.read_images(files, drop_tail=True).collect()]
    want = [(s, at, flags, *key.split("\0", 1), value, crc) for s, d in ((1, data), (3, data[:-5])) for at, flags, key, value, crc in segments.scan(d, drop_tail=True)]
    assert got == want and len(got) == 199
    assert want[1][-1] == zlib.crc32(b"\0" + "b\0k1é".encode() + b"x")


def test_an_export_and_the_log_before_it_are_the_whole_log(spark):
    records = log.in_segments(log.offsets(sources.item_log(spark, SF)), 4096)
    place = lambda df: sorted(tuple(r) for r in df.select("partition_id", "record_start").collect())
    for segment in (3, 999):
        mine, later = log.before_offset(records, segment, 9000), log.from_offset(records, segment, 9000)
        assert place(mine) + place(later) != place(records) or segment == 999
        assert sorted(place(mine) + place(later)) == place(records)
        assert place(log.imported(records, later)) == place(records)


def test_index_takes_one_ordered_column(spark):
    index = compaction.index_of(log.in_segments(log.offsets(sources.item_log(spark, SF)), 4096))
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") == 1
