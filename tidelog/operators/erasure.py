"""Reed-Solomon shards over GF(256). The numeric kernel runs on Arrow batches; placement and counting are column work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import internal_key, java_hash, partition_of, payload_data, payload_size, shard_key
from tidelog.work import running_total

#: Reduction polynomial of the field (fixed value).
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    return exp, log


EXP, LOG = _tables()
#: All products of two bytes.
PRODUCT = np.where(np.outer(np.arange(256) > 0, np.arange(256) > 0), EXP[LOG[:, None] + LOG[None, :]], 0).astype(np.uint8)


def divide(a: int, b: int) -> int:
    if not b:
        raise ZeroDivisionError("division by zero in the field")
    return int(EXP[LOG[a] - LOG[b] + 255]) if a else 0


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices over the field."""
    return np.bitwise_xor.reduce(PRODUCT[a[:, :, None], b[None, :, :]], axis=1)


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a square matrix by Gauss-Jordan elimination; raises for singular ones."""
    n = len(m)
    if m.shape != (n, n):
        raise ValueError("not square")
    wide = np.concatenate((m.astype(np.uint8), np.eye(n, dtype=np.uint8)), axis=1)
    for c in range(n):
        pivots = np.flatnonzero(wide[c:, c])
        if not len(pivots):
            raise ValueError("singular")
        p = c + int(pivots[0])
        wide[[c, p]] = wide[[p, c]]
        wide[c] = PRODUCT[divide(1, int(wide[c, c]))][wide[c]]
        for r in range(n):
            if r != c and wide[r, c]:
                wide[r] ^= PRODUCT[wide[r, c]][wide[c]]
    return wide[:, n:]


def vandermonde(rows: int, cols: int) -> np.ndarray:
    """Powers r ** c of the row numbers (0 ** 0 is 1)."""
    out = np.zeros((rows, cols), np.uint8)
    for r in range(rows):
        x = 1
        for c in range(cols):
            out[r, c] = x
            x = int(PRODUCT[x, r])
    return out


def generator(k: int, m: int) -> np.ndarray:
    """Systematic generator: its first k rows are the identity."""
    v = vandermonde(k + m, k)
    return times(v, inverse(v[:k]))


#: Generators by (k, m) and matrices that restore missing data shards by (k, m, shards at hand), made once a process.
_MADE: dict[tuple, np.ndarray] = {}
#: Bytes of each row multiplied at once (they stay in a core's cache), and bytes of values that are coded together.
BLOCK, TOGETHER = 1 << 15, 1 << 22
_HIGH, _FOLD = np.uint64(0x8080808080808080), np.uint64(POLYNOMIAL & 0xFF)


def parity_rows(k: int, m: int) -> np.ndarray:
    """The rows of the generator that make parity shards."""
    if (k, m) not in _MADE:
        _MADE[k, m] = generator(k, m)[k:]
    return _MADE[k, m]


def restoring(k: int, m: int, have: tuple[int, ...]) -> np.ndarray:
    """The rows that make the data shards not in `have` (k shard numbers) of the shards in it."""
    if (k, m, have) not in _MADE:
        whole = np.concatenate((np.eye(k, dtype=np.uint8), parity_rows(k, m)))
        _MADE[k, m, have] = inverse(whole[list(have)])[[d for d in range(k) if d not in have]]
    return _MADE[k, m, have]


def product(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """matrix (r, k) times rows (k, 8 n) of bytes over the field, eight bytes an operation.

    By Horner's rule over the bits of the coefficients: double what is there, then add the rows whose coefficient has the
    bit. A doubling adds each byte to itself and folds the bit that leaves it back with the polynomial.
    """
    words = np.ascontiguousarray(rows).view(np.uint64)
    out = np.zeros((len(matrix), words.shape[1]), np.uint64)
    bits = [[(r, d) for r in range(len(matrix)) for d in range(len(rows)) if matrix[r, d] >> b & 1] for b in range(8)]
    top = max((b for b in range(8) if bits[b]), default=-1)
    width = min(BLOCK // 8, words.shape[1])
    space, xor = np.empty((len(matrix), width), np.uint64), np.bitwise_xor
    for at in range(0, words.shape[1], width or 1):
        part, some = out[:, at : at + width], words[:, at : at + width]
        over, narrow = space[:, : part.shape[1]], part.view(np.uint8)
        lines, adds = list(part), list(some)
        for b in range(top, -1, -1):
            if b < top:
                np.bitwise_and(part, _HIGH, out=over)
                np.add(narrow, narrow, out=narrow)  # the high bit of each byte falls off
                np.right_shift(over, 7, out=over)
                np.multiply(over, _FOLD, out=over)
                xor(part, over, out=part)
            for r, d in bits[b]:
                xor(lines[r], adds[d], out=lines[r])
    return out.view(np.uint8)


def encode_all(values: list[bytes], k: int, m: int) -> list[list[bytes]]:
    """For each value k data and m parity shards of ceil(len / k) bytes, the last data shards padded with zeros."""
    out, at = [], 0
    while at < len(values):
        end, total = at, 0
        while end < len(values) and (end == at or total + len(values[end]) <= TOGETHER):
            total += len(values[end])
            end += 1
        some = values[at:end]
        at = end
        sizes = [-(-len(v) // k) for v in some]
        parts = [[v[d * n : d * n + n].ljust(n, b"\0") for d in range(k)] for v, n in zip(some, sizes)]
        width = sum(sizes)
        if len(some) == 1 and len(some[0]) == k * width and width % 8 == 0:
            whole = some[0]
        else:
            whole = b"".join(p[d] if p is not None else b"\0" * (-width % 8) for d in range(k) for p in (*parts, None))
        parity, start = [x.tobytes() for x in product(parity_rows(k, m), np.frombuffer(whole, np.uint8).reshape(k, -1))], 0
        for p, n in zip(parts, sizes):
            out.append(p + [x[start : start + n] for x in parity])
            start += n
    return out


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    """The shards of one value; see encode_all()."""
    return encode_all([data], k, m)[0]


def decode_all(shards: list[dict[int, bytes]], k: int, m: int, sizes: list[int]) -> list[bytes]:
    """The values of any k of the shards of each; those that miss the same data shards are restored together."""
    out: list[bytes] = [b""] * len(shards)
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, s in enumerate(shards):
        if len(s) < k:
            raise ValueError("too few shards")
        have = tuple(sorted(s)[:k])
        if have[-1] == k - 1:
            out[i] = b"".join(s[d] for d in have)[: sizes[i]]
        else:
            groups.setdefault(have, []).append(i)
    for have, members in groups.items():
        lost = [d for d in range(k) if d not in have]
        while members:
            some, total = [], 0
            while members and (not some or total < TOGETHER):
                some.append(members.pop())
                total += sizes[some[-1]]
            width = sum(len(shards[i][have[0]]) for i in some)
            pad = b"\0" * (-width % 8)
            rows = np.frombuffer(b"".join(x for d in have for x in (*(shards[i][d] for i in some), pad)), np.uint8).reshape(k, -1)
            made, start = [x.tobytes() for x in product(restoring(k, m, have), rows)], 0
            for i in some:
                n = len(shards[i][have[0]])
                back = {d: x[start : start + n] for d, x in zip(lost, made)}
                out[i] = b"".join(back[d] if d in back else shards[i][d] for d in range(k))[: sizes[i]]
                start += n
    return out


def decode(shards: dict[int, bytes], k: int, m: int, size: int) -> bytes:
    """The value of any k of its shards."""
    return decode_all([shards], k, m, [size])[0]


def shards_of(objects: DataFrame, k: int, m: int) -> DataFrame:
    """bucket, key, shard_idx, original_size, data of every object (bucket, key, value): k + m rows each, no shuffle."""

    def run(batches):
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            values = batch.column("value").to_pylist()
            parts = [x for v in encode_all(values, k, m) for x in v]
            of = pa.array(np.repeat(np.arange(len(values)), k + m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket").take(of), batch.column("key").take(of), pa.array(np.tile(np.arange(k + m, dtype=np.int32), len(values))), pa.array(np.repeat([len(v) for v in values], k + m), pa.int64()), pa.array(parts, pa.binary())],
                ["bucket", "key", "shard_idx", "original_size", "data"],
            )

    rows = objects.select("bucket", "key", F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
    return rows.mapInArrow(run, "bucket string, key string, shard_idx int, original_size bigint, data binary")


def read_objects(shards: DataFrame, k: int, m: int) -> DataFrame:
    """bucket, key, n_present, status, value of every object with a shard: intact, decoded, or unavailable (under k).

    An object has k + m shards at most, so its group is bounded. The size is that of the first shard present.
    """
    rows = shards.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(F.struct("shard_idx", "original_size", "data"))).alias("parts"))

    def run(batches):
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            rows = batch.column("parts").to_pylist()
            have, sizes = [{p["shard_idx"]: p["data"] for p in x} for x in rows], [x[0]["original_size"] for x in rows]
            enough = [i for i, h in enumerate(have) if len(h) >= k]
            values: list[bytes | None] = [None] * len(have)
            for i, v in zip(enough, decode_all([have[i] for i in enough], k, m, [sizes[i] for i in enough])):
                values[i] = v
            status = ["unavailable" if len(h) < k else "intact" if all(i in h for i in range(k)) else "decoded" for h in have]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("key"), pa.array([len(h) for h in have], pa.int32()), pa.array(status, pa.string()), pa.array(values, pa.binary())], ["bucket", "key", "n_present", "status", "value"]
            )

    return rows.mapInArrow(run, "bucket string, key string, n_present int, status string, value binary")


def parity_two_one(value: Column) -> Column:
    """The one parity shard of two data shards, in column functions: 3 a + 2 b for each pair of bytes, as lower-case hex."""
    raw = value.cast("binary")
    size = F.ceil(F.octet_length(raw) / 2).cast("int")
    at = lambda i: F.coalesce(F.conv(F.nullif(F.hex(F.substring(raw, i + 1, F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))
    double = lambda x: F.when(x >= 128, F.shiftleft(x, 1).bitwiseXOR(POLYNOMIAL)).otherwise(F.shiftleft(x, 1))
    byte = lambda i: F.lower(F.lpad(F.hex(double(at(i)).bitwiseXOR(at(i)).bitwiseXOR(double(at(i + size)))), 2, "0"))
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), "")).otherwise("")


def placed(objects: DataFrame, nodes: list[str], width: int) -> DataFrame:
    """bucket, key, shard_idx, node_id: `width` consecutive nodes of the sorted ring from the object's anchor."""
    ring = sorted(nodes)
    if len(ring) < width:
        raise ValueError("fewer nodes than shards")
    anchor = (F.abs(java_hash(internal_key(F.col("bucket"), F.col("key")))) % len(ring)).cast("int")
    ring_of = F.array(*[F.lit(n) for n in ring])
    spots = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(ring_of, (F.col("anchor") + i) % len(ring)))
    return objects.select("bucket", "key", anchor.alias("anchor")).select("bucket", "key", F.posexplode(spots).alias("shard_idx", "node_id"))


def lost(shards: DataFrame, modulus: int = 7) -> DataFrame:
    """shards with is_lost, a fixed failure pattern for tests and reports: (hash of key + index) mod modulus is 0."""
    return shards.withColumn("is_lost", F.pmod(java_hash(F.col("key")) + F.col("shard_idx"), F.lit(modulus)) == 0)


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected shards (bucket, key, shard_idx, node_id) that aren't present."""
    return expected.join(present.select("bucket", "key", "shard_idx"), ["bucket", "key", "shard_idx"], "left_anti")


def repair_plan(expected: DataFrame, present: DataFrame, k: int) -> DataFrame:
    """bucket, key, n_expected, n_present, action (none, repair, unrepairable) of every object."""
    there = present.select("bucket", "key", "shard_idx", F.lit(1).alias("here"))
    both = expected.join(there, ["bucket", "key", "shard_idx"], "left").groupBy("bucket", "key").agg(F.count("*").alias("n_expected"), F.count("here").alias("n_present"))
    action = F.when(F.col("n_present") == F.col("n_expected"), "none").when(F.col("n_present") < k, "unrepairable").otherwise("repair")
    return both.withColumn("action", action)


def repaired(present: DataFrame, expected: DataFrame, k: int, m: int) -> DataFrame:
    """The missing shards of every repairable object, made anew, with the node that each belongs to."""
    whole = read_objects(present, k, m).where("status <> 'unavailable'").select("bucket", "key", "value")
    gone = missing(expected, present)
    return shards_of(whole.join(gone.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi"), k, m).join(gone, ["bucket", "key", "shard_idx"])


def put_statuses(acks: DataFrame, width: int) -> DataFrame:
    """bucket, key, n_acked, status of writes by the shards that nodes have acknowledged: 200 for all `width`, else 500."""
    n = acks.select("bucket", "key", "shard_idx").distinct().groupBy("bucket", "key").agg(F.count("*").alias("n_acked"))
    return n.withColumn("status", F.when(F.col("n_acked") == width, 200).otherwise(500))


def get(asked: DataFrame, payloads: DataFrame, plain: DataFrame, k: int, m: int) -> DataFrame:
    """bucket, key, status, source (shards, plain or null), n_present, value of every key asked for.

    payloads: bucket, key, shard_idx, payload; one shorter than its header counts as missing. Shards come first, decoded where
    any k are there, 503 where fewer; the plain object (bucket, key, value) only stands in where there is no shard at all.
    """
    data, size = payload_data(F.col("payload")), payload_size(F.col("payload"))
    shards = payloads.select("bucket", "key", "shard_idx", size.alias("original_size"), data.alias("data")).where("original_size is not null")
    shards = shards.join(asked.select("bucket", "key"), ["bucket", "key"], "left_semi")
    read = read_objects(shards, k, m).withColumnRenamed("value", "decoded")
    out = asked.select("bucket", "key").join(read, ["bucket", "key"], "left").join(plain.select("bucket", "key", F.col("value").cast("binary").alias("plain"), F.lit(True).alias("there")), ["bucket", "key"], "left")
    none = F.col("n_present").isNull()
    source = F.when(~none, "shards").when(F.col("there"), "plain")
    status = F.when(F.col("status") == "unavailable", 503).when(source.isNotNull(), 200).otherwise(404)
    return out.select("bucket", "key", status.alias("status"), source.alias("source"), F.coalesce("n_present", F.lit(0)).alias("n_present"), F.when(none, F.col("plain")).otherwise(F.col("decoded")).alias("value"))


def head(asked: DataFrame, payloads: DataFrame, plain: DataFrame) -> DataFrame:
    """bucket, key, status, size of every key asked for: 200 if any shard is there, without decoding; else as the plain object."""
    shards = payloads.withColumn("original_size", payload_size(F.col("payload"))).where("original_size is not null")
    first = shards.groupBy("bucket", "key").agg(F.min_by("original_size", "shard_idx").alias("original_size"))
    sizes = plain.select("bucket", "key", F.octet_length("value").cast("bigint").alias("plain_size"))
    out = asked.select("bucket", "key").join(first, ["bucket", "key"], "left").join(sizes, ["bucket", "key"], "left")
    size = F.coalesce("original_size", "plain_size")
    return out.select("bucket", "key", F.when(size.isNull(), 404).otherwise(200).alias("status"), size.alias("size"))


def without(objects: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows (plain objects or shards) of all but the deleted keys: a DELETE takes an object's shards and its plain copy."""
    return objects.join(deleted.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti")


def shard_requests(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (node_id, bucket, key, shard_idx) with status and n_bytes: a node answers for the shards that it stores, else 404."""
    on = ["node_id", "bucket", "key", "shard_idx"]
    out = asked.join(stored.select(*on, F.octet_length("payload").cast("bigint").alias("n_bytes")), on, "left")
    return out.select(*on, F.when(F.col("n_bytes").isNull(), 404).otherwise(200).alias("status"), "n_bytes")


def repair_batches(expected: DataFrame, present: DataFrame, k: int, bucket: str, size: int = 200, partitions: int = 16) -> DataFrame:
    """partition_id, batch, n_checked, n_intact, n_healed, n_unrepairable, checkpoint of a repair pass over all shard keys.

    Each partition's shard keys, in order, are taken in batches of `size`; a batch checks its distinct objects against the
    state at the start of the pass. checkpoint is where the next batch starts: the batch's last key and a NUL.
    """
    name = shard_key(F.col("bucket"), F.col("key"), F.col("shard_idx"))
    keys = present.select("bucket", "key", name.alias("shard_key"), F.lit(1).cast("bigint").alias("one"))
    keys = keys.withColumn("partition_id", partition_of(F.lit(bucket), F.col("shard_key"), partitions))
    keys = running_total(keys, "partition_id", ["shard_key"], "one", "at", "repair").withColumn("batch", F.floor(F.col("at") / size))
    last = keys.groupBy("partition_id", "batch").agg(F.concat(F.max("shard_key"), F.lit("\0")).alias("checkpoint"))
    objects = keys.select("partition_id", "batch", "bucket", "key").distinct().join(repair_plan(expected, present, k), ["bucket", "key"])
    count = lambda a: F.count_if(F.col("action") == a)
    counts = objects.groupBy("partition_id", "batch").agg(F.count("*").alias("n_checked"), count("none").alias("n_intact"), count("repair").alias("n_healed"), count("unrepairable").alias("n_unrepairable"))
    return counts.join(last, ["partition_id", "batch"])
