import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog import registry, sources, streaming, work
from tidelog.operators import cluster, compaction, erasure, listing, log, store
from tidelog.sources import segments

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple("" if r[c] is None else str(r[c]) for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in cur.fetchall())
    assert dict(got.dtypes) == {x[0]: KINDS[str(x[1])] for x in cur.description}
    assert rows(got) == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_hash_and_route(spark):
    texts = ["emails\0msg-42", "bucket\0key1", "b\0k", "", "é😀x", "Aa"]
    want = [-190421997, 195790344, 94285]

    def units(t):
        raw = t.encode("utf-16-be")
        h = 0
        for i in range(0, len(raw), 2):
            h = (h * 31 + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.java_hash(F.col("t")).alias("h")).collect()}
    assert got == {t: units(t) for t in texts}
    assert [got[t] for t in texts[:3]] == want


def test_record_bytes(spark):
    df = spark.createDataFrame([("b", "k", "v")], "bucket string, key string, value string")
    rec = df.select(fn.encode_record(F.col("bucket"), F.col("key"), F.col("value"), F.lit(False)).alias("r")).first().r
    assert rec.hex() == "5131000200000300000000000000016862aef062006b766862aef0"
    assert list(segments.scan(bytes(rec)))[0][:4] == (0, 0, "b\0k", b"v")


def test_segments_strict_and_lenient(spark, tmp_path):
    df = spark.createDataFrame([("b", "k1", "AAA", False), ("b", "k2", "", False), ("b", "k3", None, True)], "bucket string, key string, value string, gone boolean").coalesce(1)
    recs = [bytes(r.r) for r in df.select(fn.encode_record(F.col("bucket"), F.col("key"), F.col("value"), F.col("gone")).alias("r")).collect()]
    (tmp_path / "a.seg").write_bytes(b"".join(recs))
    got = segments.read_segments(spark, str(tmp_path)).orderBy("record_start").collect()
    assert [(r.flags, r.key, bytes(r.value)) for r in got] == [(0, "k1", b"AAA"), (0, "k2", b""), (1, "k3", b"")]
    whole = b"".join(recs)
    for cut in (1, 5, 22):
        assert len(list(segments.scan(whole[:-cut], drop_tail=True))) == 2
        with pytest.raises(ValueError):
            list(segments.scan(whole[:-cut]))
    with pytest.raises(ValueError):
        list(segments.scan(whole[:-1] + bytes([whole[-1] ^ 0xFF]), drop_tail=True))


def test_field_and_matrices():
    # fixed values: published known answers of the field
    assert [int(erasure.PRODUCT[a, b]) for a, b in ((3, 4), (7, 7), (23, 45), (2, 128))] == [12, 21, 41, 29]
    with pytest.raises(ZeroDivisionError):
        erasure.divide(1, 0)
    m = np.array([[56, 23, 98], [3, 100, 200], [45, 201, 123]], np.uint8)
    assert erasure.inverse(m).tolist() == [[175, 133, 33], [130, 13, 245], [112, 35, 126]]
    assert erasure.times(np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])).tolist() == [[11, 22], [19, 42]]
    assert erasure.generator(4, 2)[4:].tolist() == [[27, 28, 18, 20], [28, 27, 20, 18]]
    assert erasure.generator(2, 1)[2:].tolist() == [[3, 2]]
    with pytest.raises(ValueError):
        erasure.inverse(np.zeros((2, 2), np.uint8))


@pytest.mark.parametrize("k,m", [(2, 1), (3, 1), (4, 2)])
def test_codec_survives_any_losses(k, m):
    for n in (0, 1, 5, 512, 1025):
        data = bytes(i * 7 & 255 for i in range(n))
        parts = dict(enumerate(erasure.encode(data, k, m)))
        assert {len(p) for p in parts.values()} == {-(-n // k)}
        for keep in itertools.combinations(range(k + m), k):
            assert erasure.decode({i: parts[i] for i in keep}, k, m, n) == data
    with pytest.raises(ValueError):
        erasure.decode({0: b""}, 2, 1, 0)


def test_pages_join_to_the_whole_listing(spark):
    keys = spark.createDataFrame([("b", k, 1) for k in ("a/1", "a/2", "b", "c/x/1", "c/y", "d", "é")], "bucket string, key string, size bigint")
    after, names = "", []
    for _ in range(10):
        got = listing.page(keys, "b", after=after, max_keys=2).collect()
        names += sorted(r.name for r in got)
        after = got[0].next_key
        if after is None:
            break
    assert names == ["a/1", "a/2", "b", "c/x/1", "c/y", "d", "é"]
    assert {r.name for r in listing.page(keys, "b", delimiter="/").collect()} == {"a/", "b", "c/", "d", "é"}
    assert listing.page(keys, "none").count() == 0


def test_tokens_and_parsers(spark):
    df = spark.createDataFrame([("ü>?ÿ", "1:h:80:90, 2:h:81:91:99,,", "32MB", "/b/k/x")], "k string, p string, m string, u string")
    r = df.select(fn.decode_token(fn.encode_token(F.col("k"))).alias("k"), fn.decode_token(F.lit("!!not base64")).alias("raw"), fn.parse_peers(F.col("p")).alias("p"), fn.megabytes(F.col("m")).alias("m"), fn.parse_path(F.col("u")).alias("u"), fn.max_keys(F.lit("x")).alias("n"), fn.max_keys(F.lit("5000")).alias("big"), fn.object_of_shard(F.lit("a/b/03")).alias("o"), fn.object_of_shard(F.lit("nope")).alias("no")).first()
    assert (r.k, r.raw, r.m, r.u.bucket, r.u.key, r.n, r.big, r.o, r.no) == ("ü>?ÿ", "!!not base64", 32, "b", "k/x", 1000, 1000, "a/b", None)
    assert [(p.node_id, p.grpc_port) for p in r.p] == [("1", 1090), ("2", 99)]


def test_compaction_keeps_the_live_index(spark):
    records = log.in_segments(log.offsets(sources.item_log(spark, SF)), 4096)
    kept = compaction.rewritten(records)
    chosen = compaction.candidates(records).select("partition_id", "segment_id")
    live = compaction.index_of(records).join(chosen, ["partition_id", "segment_id"], "left_semi")
    assert kept.where("op = 'PUT'").count() == live.count()


def test_health_and_replicas(spark):
    assert rows(cluster.replicas(spark, ["3", "1", "2"], 2, 2)) == [("1", "0", "0"), ("2", "0", "1"), ("2", "1", "0"), ("3", "1", "1")]
    assert cluster.health(spark.createDataFrame([], "group_id int, has_leader boolean")).first().status == 200


def test_stream_equals_batch(spark, tmp_path):
    cmds = [(1, i, "DELETE" if i % 5 == 0 else "PUT", "b", f"k{i % 7}", f"v{i}") for i in range(40)]
    for n in range(4):
        spark.createDataFrame(cmds[n * 10 : n * 10 + 10], streaming.COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = rows(streaming.batch_state(spark.createDataFrame(cmds, streaming.COMMANDS)))
    for every in (1, 2, 3, 8):
        state = str(tmp_path / f"state{every}")
        q = streaming.apply_stream(spark, str(tmp_path / "in"), state, str(tmp_path / f"cp{every}"), merge_every=every)
        assert q.awaitTermination(120)
        assert rows(streaming.latest_state(spark, state)) == want
    assert streaming.latest_state(spark, str(tmp_path / "none")).count() == 0


def test_versions_survive_an_interrupted_writer(spark, tmp_path):
    root = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        store.current(spark, root)
    store.publish(spark.range(3), root)
    spark.range(9).write.parquet(f"{root}/version-0000000007-left")  # written, never made current
    assert store.current(spark, root).count() == 3
    store.publish(spark.range(5), root)
    assert store.current(spark, root).count() == 5 and len(store.vacuum(spark, root)) == 3
    assert store.current(spark, root).count() == 5 and work.names_in(spark, root)[0].startswith("current-0000000008")


def test_reads_check_the_bytes(spark):
    log_rows = spark.createDataFrame([("b", f"k{i}", "PUT", f"value {i}", 0, 1, 100 * i) for i in range(3)], "bucket string, key string, op string, value string, partition_id int, segment_id int, record_start bigint")
    image = segments.images(log_rows)
    raw = bytearray(image.first().content)
    back = segments.read_images(image)
    index = back.select("bucket", "key", "partition_id", "segment_id", "record_start")
    asked = spark.createDataFrame([("b", k) for k in ("k0", "k1", "k2", "none")], "bucket string, key string")
    got = {r.key: (r.status, r.verified, r.value and bytes(r.value)) for r in store.get(asked, index, back).collect()}
    assert got == {"k0": (200, True, b"value 0"), "k1": (200, True, b"value 1"), "k2": (200, True, b"value 2"), "none": (404, None, None)}
    bad = back.withColumn("value", F.when(F.col("key") == "k1", F.lit(b"valuf 1")).otherwise(F.col("value"))).where("key <> 'k2'")
    got = {r.key: (r.status, r.verified) for r in store.get(asked, index, bad).collect()}
    assert got == {"k0": (200, True), "k1": (500, False), "k2": (500, False), "none": (404, None)}
    raw[-1] ^= 1
    with pytest.raises(ValueError):
        list(segments.scan(bytes(raw), drop_tail=True))


def test_rolls_equal_a_fold_across_batches(spark):
    import random

    rng, data = random.Random(3), []
    for p in range(3):
        at = 0
        for _ in range(400):
            n = rng.choice([1, 30, 100, 900])
            data.append((p, at, n))
            at += n
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(log.rolled(spark.createDataFrame(data, "partition_id int, record_start bigint, record_length bigint").repartition(4), 1000))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, state = {}, {}
    for p, _, n in data:
        seg, size = state.get(p, (1, 0))
        seg, size = (seg + 1, 0) if size >= 1000 else (seg, size)
        state[p] = seg, size + n
        k, total = want.get((p, seg), (0, 0))
        want[p, seg] = k + 1, total + n
    assert got == sorted((str(k), str(p), str(s), str(t)) for (p, s), (k, t) in want.items())


def test_work_tables_need_a_shared_folder(spark, monkeypatch):
    class Far:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("sc", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError):
        work.work_dir(Far)


def test_commands_decode_to_themselves(spark):
    cmds = [("PUT", "b", "k", "v"), ("PUT", "é", "ключ", ""), ("DELETE", "b", "k", None), ("CREATE_BUCKET", "b", None, None), ("DELETE_BUCKET", "b", None, None)]
    df = spark.createDataFrame(cmds, "kind string, bucket string, key string, value string")
    raw = df.select("*", fn.encode_command(F.col("kind"), F.col("bucket"), F.col("key"), F.col("value")).alias("raw"))
    got = raw.select(fn.decode_command(F.col("raw")).alias("c")).select("c.kind", "c.bucket", "c.key", F.col("c.value").cast("string").alias("value")).collect()
    assert [tuple(r) for r in got] == cmds
    assert bytes(raw.first().raw).hex() == "01000162" + "00016b" + "0000000000000001" + "76"
    with_group = raw.select(fn.command_group(F.col("kind"), F.col("bucket"), F.col("key")).alias("g")).collect()
    assert [r.g for r in with_group][3:] == [-1, -1]
