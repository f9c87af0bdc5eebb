"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of max_bits + 1 ring segments are compared by chains: a pair that differs in at most max_bits bits has a
segment i from which every chain of l consecutive segments differs in at most l * max_bits / segments bits (rounded
down): none in the first, one in the first two, and so on. The first two lengths are an index: a key holds segment i
and its successor with one bit left out. Longer chains prune the pairs of a key before the whole distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import dropped, saved
from tidelog.llm.components import components

SEED = 42
#: Keys shared by more fingerprints than this are linked by the ball join instead of inside one task.
HOT_KEY = 50_000
#: Shingles hashed at once: bounds memory on very long texts.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a text with A-Z lower-cased, repeats included, in blocks."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space alone
    if not got:
        return
    flat = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(got) - words + 1)
    first, last = starts[:n].tolist(), ends[len(ends) - n :].tolist()
    for at in range(0, n, BLOCK):
        some = map(flat.__getitem__, map(slice, first[at : at + BLOCK], last[at : at + BLOCK]))
        yield np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, min(BLOCK, n - at))


def majority(blocks: Iterator[np.ndarray], lanes: int = 1) -> np.ndarray:
    """Fingerprint of 64 * lanes bits: those set in over half the hashes. Further lanes remix the same hashes."""
    ones, n = np.zeros(64 * lanes, np.int64), 0
    for h in blocks:
        n += len(h)
        for lane in range(lanes):
            mixed = h if lane == 0 else _remix(h, lane)
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """An independent 64-bit mix of each hash (multiply and xor-shift)."""
    x = h + np.uint64((lane * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row. Null and empty texts have fingerprint zero."""

    def run(batches):
        for b in batches:
            out = [int(majority(shingle_hashes(x, words))[0].astype(np.int64)) if x else 0 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _chains_fit(x: np.ndarray, start: np.ndarray, width: int, max_bits: int) -> np.ndarray:
    """Whether the differences x stay within the proportional budget along every chain from ring segment start."""
    turn = (start * width).astype(np.uint64)
    ring = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63))))
    segments, ok = 64 // width, np.ones(len(x), bool)
    for length in range(1, segments + 1):
        part = ring if length == segments else ring & np.uint64((1 << (width * length)) - 1)
        ok &= np.bitwise_count(part) <= length * max_bits // segments
        if not ok.any():
            break
    return ok


def _forest(fps: np.ndarray, start: int, width: int, max_bits: int) -> tuple[list, list]:
    """Edges of a spanning forest of the links among fps that share a key: breadth first, a row of distances at a time."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            x = fps[left] ^ fps[at]
            hit = _chains_fit(x, np.full(len(x), start), width, max_bits)
            found = left[hit]
            a += [fps[at]] * len(found)
            b += fps[found].tolist()
            queue += found.tolist()
            left = left[~hit]
    return a, b


def _scan(max_bits: int, hot_key: int):
    """Over rows sorted by key: links within each run of equal keys, or the key itself if its run is too long."""
    width = 64 // (max_bits + 1)

    def run(batches):
        keys, fps, over = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def link(keys, fps):
            cut = np.flatnonzero(np.diff(keys)) + 1
            first, size = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(keys)])))
            two = first[size == 2]
            x = fps[two] ^ fps[two + 1]
            two = two[_chains_fit(x, (keys[two] >> (2 * width)) // width, width, max_bits)]
            a, b, hot = fps[two].tolist(), fps[two + 1].tolist(), []
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                if n > hot_key:
                    hot.append(int(keys[s]))
                    continue
                more = _forest(fps[s : s + n], int(keys[s] >> (2 * width)) // width, width, max_bits)
                a += more[0]
                b += more[1]
            left = [np.array(v, np.uint64).astype(np.int64) for v in (a, b)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(left[0]), pa.nulls(len(hot), pa.int64())]),
                    pa.concat_arrays([pa.array(left[1]), pa.nulls(len(hot), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(hot, pa.int64())]),
                ],
                ["a", "b", "hot"],
            )

        for batch in batches:
            k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if over is not None:  # the rest of a run that is already known to be too long
                rest = k != over
                k, f = k[rest], f[rest]
            if not len(k):
                continue
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            done = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if len(keys) - done > hot_key:
                over, done = int(keys[-1]), len(keys)
            if done:
                yield link(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield link(keys, fps)

    return run


def ring_keys(fps: DataFrame, max_bits: int) -> DataFrame:
    """key, fp: 64 keys for each fingerprint, of a segment and its successor without one bit."""
    w = 64 // (max_bits + 1)
    mask = (1 << w) - 1
    return fps.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("s")).selectExpr(
        f"shiftleft(cast(s as bigint), {2 * w})"
        f" | shiftleft(shiftrightunsigned(fp, s - s % {w}) & {mask}L, {w})"
        f" | (shiftrightunsigned(fp, (s - s % {w} + {w}) % 64) & {mask}L & ~shiftleft(1L, s % {w})) as key",
        "fp",
    )


def ball_links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect all fps within three bits, without pairs: points at distance 1 of one and 2 of the other meet.

    Every two fingerprints at a point, one of them within distance 1, differ in at most three bits; so each point links
    its members to the least of the near ones. 2,081 rows for each fingerprint; used for the members of hot keys only.
    """
    near = fps.select("fp", F.explode(F.expr("concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))")).alias("flip"))
    near = near.select((F.col("fp").bitwiseXOR(F.col("flip"))).alias("point"), "fp")
    hub = near.groupBy("point").agg(F.min("fp").alias("a"))
    pairs = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    far = fps.select("fp", F.explode(F.expr(pairs)).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    return near.unionByName(far).join(hub, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = 3, hot_key: int = HOT_KEY) -> DataFrame:
    """a, b: links between distinct fingerprints that connect exactly those within max_bits (3 or 7) bits of another.

    Not all pairs: a spanning forest of each key's links, which has the same components.
    """
    keyed = ring_keys(fps, max_bits).repartition("key").sortWithinPartitions("key")
    found = saved(keyed.mapInArrow(_scan(max_bits, hot_key), "a bigint, b bigint, hot bigint"), "links")
    out = found.where("hot is null").select("a", "b")
    hot = found.where("hot is not null").select(F.col("hot").alias("key"))
    if hot.limit(1).count():
        if max_bits != 3:
            raise ValueError("hot keys need max_bits = 3")
        members = ring_keys(fps, max_bits).join(hot, "key", "left_semi").select("fp").distinct()
        out = out.unionByName(ball_links(saved(members, "hot")))
    return out


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 3, hot_key: int = HOT_KEY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most max_bits bits).

    Null and empty texts: fingerprint zero, linked like any other. Rows of equal fingerprint are one class, whatever
    their number, so copies are never paired. A null doc_id counts only where a component has no other. Repeated rows
    come out as often as they went in. Columns other than doc_id and text are not read. Empty input: empty result.
    """
    fps = saved(fingerprints(docs, words), "fps")
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("root")), "classes")
    edges = links(classes.select("fp"), max_bits, hot_key)
    member = components(edges)
    least = classes.join(member.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "root", F.coalesce("component", "fp").alias("component")
    )
    least = saved(least, "least")
    roots = least.groupBy("component").agg(F.min("root").alias("component_id"))
    by_fp = saved(least.join(roots, "component").select("fp", "component_id"), "roots")
    out = fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    dropped(least)
    return out
