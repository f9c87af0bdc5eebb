"""Column functions of the object log: hashing, routing, tokens, digests, parsing. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"
RECORD_HEADER, RECORD_FOOTER = 19, 4
RECORD_MAGIC = 0x51310002


def internal_key(bucket: Column, key: Column) -> Column:
    """bucket, NUL, key: the one string that hashes and records use."""
    return F.concat(bucket, F.lit(NUL), key)


#: Texts of up to so many code points are hashed as one sum; the inverse of 31 to the power of a place is the weight of its unit.
SHORT = 24
_INVERSE = pow(31, -1, 1 << 32)


def _folded(text: Column, start: Column) -> Column:
    """`start` carried on over the UTF-16 units of text: times 31, plus the unit, in 32 bits.

    Code points are UTF-16 units but for supplementary ones, whose texts are read from their UTF-16 bytes. A short text is
    the sum of its units by weight, times 31 to the power of its length: compiled, where a fold is a call for each unit.
    """
    step = lambda a, x: (a * 31 + x).bitwiseAND(0xFFFFFFFF)
    by_point = F.aggregate(F.split(text, ""), start, lambda a, c: step(a, F.ascii(c)))
    unit = lambda u, i: F.conv(F.hex(F.substring(u, i * 2 - 1, F.lit(2))), 16, 10).cast("bigint")
    of = lambda u: F.aggregate(F.sequence(F.lit(1), (F.octet_length(u) / 2).cast("int")), start, lambda a, i: step(a, unit(u, i)))
    units = F.encode(text, "UTF-16BE")
    plain = (F.octet_length(text) == F.char_length(text)) | (F.octet_length(units) == 2 * F.char_length(text))
    # places after the end have no unit (ascii('') is 0); units of 16 bits by weights of 32 and signed factors of 32 bits stay within a long
    total = start
    for i in range(1, SHORT + 1):
        total = total + F.ascii(F.substring(text, i, 1)).cast("bigint") * F.lit(pow(_INVERSE, i, 1 << 32)).cast("bigint")
    signed = lambda n: (n & 0xFFFFFFFF ^ 1 << 31) - (1 << 31)
    power = F.array(*[F.lit(signed(pow(31, n, 1 << 32))).cast("bigint") for n in range(SHORT + 1)])[F.char_length(text)]
    short = ((total.bitwiseAND(0xFFFFFFFF).bitwiseXOR(1 << 31) - (1 << 31)) * power).bitwiseAND(0xFFFFFFFF)
    return F.when(plain & (F.char_length(text) <= SHORT), short).when(plain, by_point).otherwise(F.transform(F.array(units), of)[0])


def java_hash(text: Column, before: Column | None = None) -> Column:
    """The 31-polynomial over UTF-16 units with 32-bit wrap-around, as a signed int (kept in a long), of `before` and text.

    `before` is folded first; as a literal, once for all rows.
    """
    start = F.lit(0).cast("bigint")
    return _folded(text, _folded(before, start) if before is not None else start).bitwiseXOR(1 << 31) - (1 << 31)


def partition_of(bucket: Column, key: Column, n: int = 16) -> Column:
    """Partition of an object. abs() is taken as a long, so the least hash is not negative."""
    return (F.abs(java_hash(key, F.concat(bucket, F.lit(NUL)))) % n).cast("int")


def etag(value: Column) -> Column:
    return F.concat(F.lit('"'), F.md5(value), F.lit('"'))


def encode_token(key: Column) -> Column:
    """Continuation token: URL-safe Base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(key, "UTF-8")), "+/", "-_"), F.lit("="))


def decode_token(token: Column) -> Column:
    """The key of a token; a token that can't be decoded is taken as the key itself."""
    plain = F.translate(token, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), (4 - F.length(plain) % 4) % 4))
    return F.coalesce(F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), token)


def xml_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    return out


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def max_keys(raw: Column) -> Column:
    """A page size from its parameter: 0 to 1000; 1000 if it can't be read."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.coalesce(raw.try_cast("int"), F.lit(1000))))


def megabytes(raw: Column) -> Column:
    """32MB, 32M or 32 as 32."""
    return F.regexp_extract(raw, r"^\s*(\d+)", 1).try_cast("int")


def parse_path(path: Column) -> Column:
    """struct(bucket, key) of a request path: key null for /b and /b/."""
    bucket, key = F.regexp_extract(path, r"^/([^/]*)", 1), F.regexp_extract(path, r"^/[^/]*/(.*)$", 1)
    return F.struct(bucket.alias("bucket"), F.when(key != "", key).alias("key"))


def parse_peers(peers: Column) -> Column:
    """Structs (node_id, host, http_port, raft_port, grpc_port) of a comma list; the last port is the one before plus 1000 if missing."""
    fields = lambda p: F.split(F.trim(p), ":")
    node = lambda p: F.struct(
        fields(p)[0].alias("node_id"), fields(p)[1].alias("host"), fields(p)[2].cast("int").alias("http_port"), fields(p)[3].cast("int").alias("raft_port"),
        F.coalesce(F.get(fields(p), F.lit(4)).cast("int"), fields(p)[3].cast("int") + 1000).alias("grpc_port"),
    )
    return F.transform(F.filter(F.split(peers, ","), lambda p: F.trim(p) != ""), node)


def object_of_shard(shard_key: Column) -> Column:
    """The object's path of a shard key (all before the last slash); null if it isn't one."""
    path = F.regexp_extract(shard_key, r"^(.+)/\d{2,}$", 1)
    return F.when(path != "", path)


def record_length(bucket: Column, key: Column, value: Column) -> Column:
    return F.octet_length(internal_key(bucket, key)) + F.octet_length(F.coalesce(value, F.lit(""))) + RECORD_HEADER + RECORD_FOOTER


def encode_record(bucket: Column, key: Column, value: Column, delete: Column) -> Column:
    """One record: magic, flag, key length, value length, CRC, key, value, CRC again; big-endian."""
    name = F.encode(internal_key(bucket, key), "UTF-8")
    body = F.when(delete, F.encode(F.lit(""), "UTF-8")).otherwise(F.coalesce(value.cast("binary"), F.encode(F.lit(""), "UTF-8")))
    flag = F.unhex(F.when(delete, "01").otherwise("00"))
    crc = _big_endian(F.crc32(F.concat(flag, name, body)), 4)
    return F.concat(_big_endian(F.lit(RECORD_MAGIC), 4), flag, _big_endian(F.octet_length(name), 2), _big_endian(F.octet_length(body), 8), crc, name, body, crc)


def user_key(internal: Column) -> Column:
    """The key of an internal key: all after the first NUL."""
    return F.substring(internal, F.locate(NUL, internal) + 1, F.length(internal))


def object_parts(path: Column) -> Column:
    """struct(bucket, key) of an object's path: parted at the first slash; null without one."""
    at = F.locate("/", path)
    return F.when(at > 0, F.struct(F.substring(path, F.lit(1), at - 1).alias("bucket"), F.substring(path, at + 1, F.length(path)).alias("key")))


def shard_key(bucket: Column, key: Column, index: Column) -> Column:
    return F.concat_ws("/", bucket, key, F.lpad(index.cast("string"), 2, "0"))


def segment_name(number: Column) -> Column:
    """File name of a segment: its number in ten digits."""
    return F.concat(F.lit("segment-"), F.lpad(number.cast("string"), 10, "0"), F.lit(".log"))


def segment_number(name: Column) -> Column:
    """The number of a segment's file, being written anew (.compact) or not; null for other names."""
    return F.regexp_extract(name, r"^segment-(\d+)\.log(?:\.compact)?$", 1).try_cast("int")


def group_id(namespace: Column, number: Column) -> Column:
    """UUID of a consensus group: the namespace's high half and the group's number (-1: the group of bucket commands)."""
    low = F.lower(F.lpad(F.hex(number.cast("bigint")), 16, "0"))
    return F.concat(F.substring(namespace, 1, 18), F.lit("-"), F.substring(low, 1, 4), F.lit("-"), F.substring(low, 5, 12))


def _big_endian(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"))


def _number(raw: Column, at: Column | int, size: int) -> Column:
    """The unsigned big-endian number of `size` bytes at a place (from 1) of a binary column."""
    return F.conv(F.hex(F.substring(raw, F.lit(at) if isinstance(at, int) else at, F.lit(size))), 16, 10).cast("bigint")


#: Bytes before a shard's data: the size of its object.
SHARD_HEADER = 8


def shard_payload(size: Column, data: Column) -> Column:
    """A shard as it is stored: the object's size, big-endian, then the shard."""
    return F.concat(_big_endian(size, SHARD_HEADER), data)


def payload_size(payload: Column) -> Column:
    """The object's size from a stored shard; null if it is shorter than its header, which counts as missing."""
    return F.when(F.octet_length(payload) >= SHARD_HEADER, _number(payload, 1, SHARD_HEADER))


def payload_data(payload: Column) -> Column:
    return F.when(F.octet_length(payload) >= SHARD_HEADER, F.substring(payload, F.lit(SHARD_HEADER + 1), F.octet_length(payload)))


#: Codes of the commands of the replicated log (fixed values).
COMMANDS = {"PUT": 1, "DELETE": 2, "CREATE_BUCKET": 3, "DELETE_BUCKET": 4}


def encode_command(kind: Column, bucket: Column, key: Column, value: Column) -> Column:
    """A command in binary: code, bucket and key with lengths of two bytes, for PUT the value with one of eight; null for other kinds."""
    none = F.lit("").cast("binary")
    text = lambda c: F.coalesce(F.encode(c, "UTF-8"), none)
    short = lambda b: F.concat(_big_endian(F.octet_length(b), 2), b)
    code = F.coalesce(*[F.when(kind == k, F.lit(bytes([n]))) for k, n in COMMANDS.items()])
    body = F.coalesce(value.cast("binary"), none)
    return F.concat(code, short(text(bucket)), short(text(key)), F.when(kind == "PUT", F.concat(_big_endian(F.octet_length(body), 8), body)).otherwise(none))


def decode_command(raw: Column) -> Column:
    """struct(kind, bucket, key, value) of a binary command; an empty key is null, as is the value of all but PUT."""
    kind = F.coalesce(*[F.when(F.substring(raw, 1, 1) == F.lit(bytes([n])), F.lit(k)) for k, n in COMMANDS.items()])
    n_bucket = _number(raw, 2, 2).cast("int")
    n_key = _number(raw, n_bucket + 4, 2).cast("int")
    text = lambda at, n: F.decode(F.substring(raw, at, n), "UTF-8")
    value = F.substring(raw, n_bucket + n_key + 14, F.octet_length(raw))
    return F.struct(
        kind.alias("kind"), text(F.lit(4), n_bucket).alias("bucket"), F.nullif(text(n_bucket + 6, n_key), F.lit("")).alias("key"), F.when(kind == "PUT", value).alias("value")
    )


def command_group(kind: Column, bucket: Column, key: Column, n: int = 16) -> Column:
    """The group that a command goes to: -1 for bucket commands, else the object's partition."""
    return F.when(kind.isin("CREATE_BUCKET", "DELETE_BUCKET"), -1).otherwise(partition_of(bucket, key, n))
