"""One document of each group of near copies, by wide SimHash fingerprints.

Documents whose word shingles have a Jaccard similarity of 0.8 differ in about 15 % of the bits of a SimHash, far more
than a pigeonring budget can index exactly. So fingerprints here have 256 bits, a ring of 32 segments; a key is a
chain of two segments without a difference, one of STEPS apart on the ring; for very many documents the ring and the chains are longer. Pairs of a key must stay within the
budget of half the ring; the pairs that remain are compared exactly by their shingles, a forest of them first and
then every pair within the budget between what these leave apart. At a similarity of exactly 0.8
a pair of independent bits shares a key with a probability of about 0.98.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import saved, small
from tidelog.llm.components import components
from tidelog.llm.simhash import BLOCK as HASHES, SEED, majority, shingle_hashes

LANES, STEPS = 4, (1, 5, 11, 14)
#: Chains by the segments of a key: lanes of 64 bits, and the steps from a chain's first segment to its others. More bits in a
#: key take more keys for the same chance of 0.98 that a pair at 0.8 shares one.
CHAINS = {
    2: (LANES, tuple((s,) for s in STEPS)),
    3: (8, ((1, 3), (5, 12), (9, 22), (14, 31), (17, 40), (7, 26), (19, 29))),
    4: (16, ((1, 4, 13), (6, 17, 40), (10, 29, 63), (15, 36, 88), (21, 47, 100), (26, 60, 95), (31, 73, 110), (38, 81, 119), (43, 90, 107), (50, 78, 121), (55, 70, 114), (18, 44, 116))),
}
#: Members of a key on average beyond which keys take another segment, so that pairs compared don't grow with the square of the documents.
MEMBERS = 512
#: Differences that the compared half (128 bits) may have: 15.2 % of them are expected at 0.8, and 36 is 4 deviations
#: more; unrelated texts differ in 64 of them, and 36 is 5 deviations less.
HALF_BUDGET = 36
#: Members of a key that are compared by offsets; keys with more by blocks of rows, of at most BLOCK distances.
RUN, BLOCK = 64, 250_000
#: Pairs of all keys that are thinned together to a forest, in one task.
FOREST = 250_000
#: Classes of a family, and bytes of their texts, that are compared together, by twos of such groups.
GROUP, GROUP_BYTES = 512, 16_000_000
#: Classes whose keys are made at once.
STEP = 256
#: Pairs within the budget for each member from which a key is spanned row by row, in memory linear in its members.
DENSE = 8


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted: the set whose similarity counts."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)]))


def segments_of_a_key(documents: int) -> int:
    """How many segments a key takes: the fewest (2 to 4) with at most MEMBERS documents a key on average."""
    return next((n for n in CHAINS if documents <= MEMBERS << (8 * n)), max(CHAINS))


def wide_fingerprint(text: str | None, words: int, lanes: int = LANES) -> np.ndarray:
    """64 bits a lane by majority of the distinct shingles, however often each stands."""
    h = distinct_shingles(text, words)
    return majority((h[at : at + HASHES] for at in range(0, len(h), HASHES)), lanes)


def wide_fingerprints(docs: DataFrame, words: int, lanes: int = LANES) -> DataFrame:
    """doc_id, text_hash, node (hash of the text with A-Z lower-cased and white space made one blank), f0, f1 and on, one a lane."""
    names = [f"f{i}" for i in range(lanes)]
    normal = lambda t: b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())

    def run(batches):
        for b in batches:
            node = np.array([xxhash.xxh64_intdigest(normal(x.as_py()), SEED) for x in b.column("text")], np.uint64).view(np.int64)
            out = np.stack([wide_fingerprint(x.as_py(), words, lanes) for x in b.column("text")]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(node), *[pa.array(np.ascontiguousarray(out[:, i])) for i in range(lanes)]],
                ["doc_id", "text_hash", "node", *names],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(lambda bs: run(b for b in bs if b.num_rows), f"doc_id {kind}, text_hash bigint, node bigint, " + ", ".join(f"{n} bigint" for n in names))


def forest(i, j, d):
    """Kruskal: the pairs that join what nearer ones leave apart."""
    order = np.argsort(d, kind="stable")
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    a, b, c = [], [], []
    for x, y, z in zip(i[order].tolist(), j[order].tolist(), d[order].tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[ry] = rx
            a.append(x)
            b.append(y)
            c.append(z)
    return a, b, c


def _pairs(budget: int):
    """Over rows sorted by key: a minimum spanning forest of the pairs within the budget, for each key."""

    def brief_pairs(key, f):
        """i, j, d of the pairs within the budget in short runs, all runs of a batch at once."""
        i_all, j_all, d_all = [], [], []
        for o in range(1, min(RUN, len(key))):
            i = np.flatnonzero(key[o:] == key[:-o])
            if not len(i):
                break
            d = np.bitwise_count(f[i] ^ f[i + o]).sum(axis=1)
            ok = d <= budget
            i_all.append(i[ok])
            j_all.append(i[ok] + o)
            d_all.append(d[ok])
        return tuple(map(np.concatenate, (i_all, j_all, d_all))) if i_all else (np.empty(0, np.int64),) * 3

    def long_pairs(f):
        """The same in one long run; None if they are dense."""
        n, total, found = len(f), 0, []
        step = max(1, BLOCK // n)
        for at in range(0, n, step):
            some = f[at : at + step, None]
            d = np.bitwise_count(some[..., 0] ^ f[at:, 0]) + np.bitwise_count(some[..., 1] ^ f[at:, 1])  # 128 at most
            i, j = np.nonzero(d <= budget)
            i, j = i[j > i], j[j > i]
            total += len(i)
            if total > DENSE * n:
                return None
            found.append((i + at, j + at, d[i, j]))
        return tuple(map(np.concatenate, zip(*found)))

    def tree(f):
        """Prim: a row of distances at a time, so memory stays linear in the run."""
        n = len(f)
        best, by, left = np.full(n, 1 << 14, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        at, a, b, c = 0, [], [], []
        for _ in range(n - 1):
            left[at] = False
            d = np.bitwise_count(f ^ f[at]).sum(axis=1).astype(np.int64)
            closer = left & (d < best)
            best[closer], by[closer] = d[closer], at
            at = int(np.argmin(np.where(left, best, 1 << 15)))
            if best[at] <= budget:
                a.append(int(by[at]))
                b.append(at)
                c.append(int(best[at]))
        return a, b, c

    def run(batches):
        held: list[pa.RecordBatch] = []

        def link(table):
            key = table.column("key").to_numpy()
            node = table.column("node").to_numpy()
            f = np.stack([table.column(c).to_numpy() for c in ("f0", "f1")], 1).view(np.uint64)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            size = np.diff(cut)
            brief = np.repeat((size <= RUN) & (size > 1), size)
            at = np.flatnonzero(brief)
            a, b, c = forest(*brief_pairs(key[at], f[at]))
            a, b = at[np.array(a, np.int64)].tolist(), at[np.array(b, np.int64)].tolist()
            for s, n in zip(cut[:-1][size > RUN].tolist(), size[size > RUN].tolist()):
                near = long_pairs(f[s : s + n])
                x, y, z = tree(f[s : s + n]) if near is None else forest(*near)
                a += [s + k for k in x]
                b += [s + k for k in y]
                c += z
            a, b = node[np.array(a, np.int64)], node[np.array(b, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c, pa.int32())], ["a", "b", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = batch.column("key")
            if key[0].as_py() != key[-1].as_py():
                table = pa.concat_batches(held)
                keys = table.column("key").to_numpy()
                done = int(np.searchsorted(keys, keys[-1]))
                yield link(table.slice(0, done))
                held = [table.slice(done)]
        if held:
            yield link(pa.concat_batches(held))

    return run


def keyed(classes: DataFrame, segments: int = 2) -> DataFrame:
    """node, f0, f1, key: a row for each key of each class, in order of (key, node) within partitions by key."""
    lanes, steps = CHAINS[segments]
    chains = np.array([(i, *((i + step) % (8 * lanes) for step in more)) for more in steps for i in range(8 * lanes)])
    kept, prints = ["node", "f0", "f1"], [f"f{i}" for i in range(lanes)]

    def run(batches):
        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            parts = np.stack([batch.column(c).to_numpy() for c in prints], 1).view(np.uint8)  # little-endian: a lane's lowest byte first
            key = np.broadcast_to(np.arange(len(chains)), (len(parts), len(chains)))
            for k in range(segments):
                key = key << 8 | parts[:, chains[:, k]]
            of = [np.repeat(batch.column(c).to_numpy(), len(chains)) for c in kept]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*of, key.reshape(-1))], [*kept, "key"])

    rows = classes.select("node", *prints).mapInArrow(run, ", ".join(f"{c} bigint" for c in (*kept, "key")))
    return rows.repartition("key").sortWithinPartitions("key", "node")


def _thin(batches):
    """A minimum spanning forest of a partition's pairs."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.concat_batches(held)
        a, b, d = (table.column(c).to_numpy() for c in ("a", "b", "d"))
        order = np.lexsort((b, a))
        kept = forest(a[order], b[order], d[order])
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int32())], ["a", "b", "d"])


def thinned(pairs: DataFrame) -> DataFrame:
    """Pairs that join what the pairs a, b, d join: a minimum spanning forest of each FOREST of them.

    The forests of the keys repeat each other: a family of n classes that share their keys has up to n - 1 pairs a key.
    What a family is does not depend on which of them stay, nor how they fall to parts.
    """
    return saved(pairs.coalesce(ceil(pairs.count() / FOREST) or 1).mapInArrow(_thin, "a bigint, b bigint, d int"), "pairs")


def candidates(classes: DataFrame, budget: int, segments: int = 2) -> DataFrame:
    """a, b, d: pairs of classes (by node) that share a key and differ in at most `budget` of 128 bits; a forest of them.

    Members are read in order of node, so that ties between pairs fall alike in every run.
    """
    found = keyed(classes, segments=segments).mapInArrow(_pairs(budget), "a bigint, b bigint, d int")
    return thinned(saved(found.groupBy("a", "b").agg(F.min("d").alias("d")), "pairs"))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of shingles have at least that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * max(1, len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b whose texts' sets of word shingles have at least that Jaccard similarity."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            keep, last, mine = [], None, None
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, mine = x, distinct_shingles(x, words)
                keep.append(alike(mine, distinct_shingles(y, words), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint")


def _across(budget: int, words: int, similarity: float):
    """Over rows sorted by (family, i, j): verified links between parts, from every pair of the groups i and j within the budget.

    A link is left out if others of the same two groups already join its parts.
    """

    def links(node, part, side, f, sets):
        order = np.argsort(side, kind="stable")
        first = int((side == 0).sum())
        size = np.array([len(x) for x in sets])
        # one group is compared with itself, two groups with each other
        left, right = (order[:first], order[first:]) if first < len(order) else (order, order)
        root: dict[int, int] = {}

        def find(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        step = max(1, BLOCK // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step, None]
            d = np.bitwise_count(f[some, 0] ^ f[right, 0]) + np.bitwise_count(f[some, 1] ^ f[right, 1])  # 128 at most
            ok = (d <= budget) & (part[some] != part[right])
            ok &= np.minimum(size[some], size[right]) >= similarity * np.maximum(size[some], size[right]) - 1e-9
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
                i, j = int(left[at + i]), int(right[j])
                if (x := find(int(part[i]))) != (y := find(int(part[j]))) and alike(sets[i], sets[j], similarity):
                    root[y] = x
                    yield min(node[i], node[j]), max(node[i], node[j])

    def run(batches):
        at, held = None, []

        def close():
            node, part, side, f0, f1 = (np.array([r[k] for r in held], np.int64) for k in range(5))
            found = list(links(node, part, side, np.stack([f0, f1], 1).view(np.uint64), [r[5] for r in held]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "node", "part", "side", "f0", "f1")), batch.column("text"))
            for family, i, j, *row, text in rows:
                if at != (family, i, j):
                    if held:
                        yield close()
                    at, held = (family, i, j), []
                held.append((*row, distinct_shingles(text.as_py(), words)))
        if held:
            yield close()

    return run


def apart(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """a, b, ca, cb: the pairs whose ends lie in different components `at`, which has all ends, and those components."""
    place = lambda side: at.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    return pairs.select("a", "b").join(place("a"), "a").join(place("b"), "b").where("ca <> cb")


def merged(at: DataFrame, links: DataFrame) -> DataFrame:
    """The components `at`, joined where links a, b join them: each link between two components counts once."""
    crossing = saved(apart(links, at).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    to = components(crossing).select(F.col("component").alias("to"), F.col("node").alias("component"))
    return saved(at.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "at")


def between(classes: DataFrame, pairs: DataFrame, at: DataFrame, texts: DataFrame, words: int, similarity: float, budget: int) -> DataFrame:
    """a, b: verified pairs that join all classes of a family which the components `at` leave apart.

    Components are contracted first: a family is what candidate pairs between components join, so a group whose pairs are
    all verified leaves nothing, and only members of families are read again. A family is dealt to groups of about GROUP
    classes and GROUP_BYTES of text, and a task compares two groups. No pair is a row unless it is verified; a class is a
    row for each group of its family.
    """
    ends = apart(pairs, at).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    families = components(saved(ends.distinct(), "between")).select(F.col("node").alias("part"), F.col("component").alias("family"))
    parts = classes.select("node", "f0", "f1").join(at.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    members = saved(parts.join(families, "part").join(texts, "node"), "members")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = saved(sizes.select("family", F.ceil(F.greatest(F.col("n") / GROUP, F.col("bytes") / GROUP_BYTES, F.lit(1.0))).alias("groups")), "families")
    dealt = members.join(small(sizes), "family").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("groups")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
    dealt = dealt.select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("bigint").alias("side"), "node", "part", "f0", "f1", "text")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return dealt.mapInArrow(_across(budget, words, similarity), "a bigint, b bigint")


def duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = HALF_BUDGET, segments: int | None = None) -> DataFrame:
    """doc_id, text_hash, component_id (least doc_id of the group) of every row.

    Texts equal but for case and white space are one class; equal fingerprints alone join nothing. Classes are linked by verified pairs: first
    each class's nearest, then those of the forest between what is still apart, then all pairs within the budget
    of families that are apart after that, whether or not they share a key; so no pair that shares a key within the budget goes unchecked. Texts without words are one class.
    Keys take as many segments as the number of documents asks for, or as given.
    """
    segments = segments or segments_of_a_key(docs.count())
    lanes = CHAINS[segments][0]
    fps = saved(wide_fingerprints(docs, words, lanes), "wide")
    rows = fps.select("doc_id", "text_hash", "node")
    prints = [F.min(f"f{i}").alias(f"f{i}") for i in range(lanes)]  # equal within a class
    classes = fps.groupBy("node").agg(F.min("doc_id").alias("root"), F.min("text_hash").alias("sample"), *prints)
    classes = saved(classes, "classes")
    pairs = candidates(classes, budget, segments)
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "sample"), "ends")
    mine = docs.select("text", F.xxhash64("text").alias("sample")).join(small(ends), "sample")
    texts = saved(mine.groupBy("node").agg(F.first("text").alias("text")), "texts")
    sides = pairs.select("a", "b", "d", F.explode(F.array("a", "b")).alias("node"))
    nearest = sides.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    at = ends.select("node", F.col("node").alias("component"))
    at = merged(at, saved(verified(nearest, texts, words, similarity), "verified"))
    # pairs within a component stay within it, so the later steps read these alone; nearest ones that failed are among them
    still = saved(apart(pairs, at).select("a", "b"), "apart")
    at = merged(at, saved(verified(still.join(nearest, ["a", "b"], "left_anti"), texts, words, similarity), "verified"))
    more = saved(between(classes, still, at, texts, words, similarity, budget), "verified")
    if more.limit(1).count():
        at = merged(at, more)
    joined = classes.select("node", "root").join(at, "node", "left").select("node", "root", F.coalesce("component", "node").alias("component"))
    joined = saved(joined, "joined")
    least = joined.groupBy("component").agg(F.min("root").alias("component_id"))
    named = saved(joined.join(least, "component").select("node", "component_id"), "named")
    return rows.join(named, "node").select("doc_id", "text_hash", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, of the least doc_id of each group of near copies.

    Rows that are equal in doc_id and text are copies too: one stays. Rows without a doc_id go if their group has one, else
    they stay. Null and empty texts, and those of white space alone, are one group. Empty input: empty result.
    """
    found = saved(duplicates(docs, words, similarity), "groups")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = small(saved(gone, "gone"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        whole = docs.columns
        out = out.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).select(*whole)
    return out
