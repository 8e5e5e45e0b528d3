"""Classes of alike sets, found bucket by bucket without listing the pairs of a class.

A node is a distinct set of hashes: id, size, bits (one bit per minimum hash, as longs) and members
(the set). Buckets hold nodes that may be alike. Each node first meets a leader of its bucket, at a
price linear in the rows. What then stays in different classes is compared in blocks: the nodes
outside a bucket's largest class against the bucket, by sketch at first, by whole sets for those that
pass. A block returns a spanning forest of its links, so its rows never outgrow its nodes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.llm.common import settle

#: Most nodes that a leader meets in one bucket.
FOLLOWERS = 1_000
#: A block holds about so many hashes, and counts a node as at least ROW of them.
BLOCK, ROW = 1_000_000, 1_000
WIDTH = 5


def packed(s: np.ndarray) -> bytes:
    """Sorted distinct 64-bit hashes as their upper 40 bits.

    Two sets of a thousand hashes share one by chance in one of a million pairs, and that decides
    only where their similarity lies within a thousandth of the limit."""
    top = np.unique(s >> np.uint64(64 - 8 * WIDTH))
    return top.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").ravel()


def most_differ(percent: int, bits: int) -> int:
    """Most sketch bits that may differ: 4.5 standard deviations above the mean at the limit."""
    share = (100 - percent) / 200
    return math.ceil(bits * share + 4.5 * math.sqrt(bits * share * (1 - share)))


def differ(a: str, b: str, longs: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)), F.lit(0))


def node_table(sketched: DataFrame, name: str) -> DataFrame:
    """One row per set (hi, lo: its 128-bit digest), with an id, in buckets of the id.

    The id is hi, moved on by one in the rare case of two sets with one hi."""
    spark = sketched.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    rank = F.row_number().over(W.partitionBy("hi").orderBy("lo"))
    rest = [c for c in sketched.columns if c not in ("hi", "lo")]
    once = sketched.repartition(n, "hi").groupBy("hi", "lo").agg(*[F.first(c).alias(c) for c in rest])
    (once.withColumn("id", F.col("hi") + rank - 1).write.bucketBy(n, "id").sortBy("id")
     .option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def named(prints: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """hi, lo, id, root, class_id: the smallest doc_id of the rows (doc_id, hi, lo) of a set's class,
    null if none has an id."""
    own = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"))
    sets = own.join(nodes.select("hi", "lo", "id"), ["hi", "lo"]).join(classes, "id")
    ids = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    return sets.join(ids, "root").select("hi", "lo", "id", "root", "class_id")


def shared(rows: DataFrame) -> DataFrame:
    """The rows (key, id) of buckets with several nodes."""
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return settle(rows.join(many, "key").select("key", "id"), "shared")


def leader_pairs(rows: DataFrame, percent: int, longs: int) -> DataFrame:
    """a, b: each node (key, id, bits) with a leader of its bucket, and leaders with the first."""
    heads = rows.groupBy("key").agg(F.min(F.struct("id", "bits")).alias("head"),
                                    F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FOLLOWERS))
    met = rows.join(heads, "key").select("key", "id", "bits", "head", part.alias("part"))
    leaders = met.groupBy("key", "part").agg(F.min(F.struct("id", "bits")).alias("leader"),
                                             F.first("head").alias("head"))
    pairs = met.join(leaders.drop("head"), ["key", "part"]).select(
        "id", F.col("leader.id").alias("other"), "bits", F.col("leader.bits").alias("bits_2")).union(
        leaders.select("leader.id", "head.id", "leader.bits", "head.bits"))
    return pairs.where((F.col("id") != F.col("other"))
                       & (differ("bits", "bits_2", longs) <= most_differ(percent, 64 * longs))).select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose sets (id, members) are alike."""
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(unpacked(x), unpacked(y), percent)
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of batches sorted by whole-number keys, one key each, and whether a new key begins."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        at = [0, *edges.tolist(), b.num_rows]
        for s, e in zip(at, at[1:]):
            key = tuple(int(c[s]) for c in columns)
            yield key != last, b.slice(s, e - s)
            last = key


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    for new, part in runs(batches, keys):
        if new and rest:
            yield whole(rest)
            rest = []
        rest.append(part)
    if rest:
        yield whole(rest)


def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def deal(rows: DataFrame) -> DataFrame:
    """rows (key, id, root, size, bits) of buckets with several classes, in blocks (key, i, j): those
    outside the largest class (left) against all of the bucket."""
    weight = F.greatest(F.col("size"), F.lit(ROW))
    top = (rows.groupBy("key", "root").agg(F.sum(weight).alias("w")).groupBy("key")
           .agg(F.max(F.struct("w", "root")).alias("top"), F.sum("w").alias("every"),
                F.count("*").alias("classes")).where("classes > 1")
           .select("key", F.col("top.root").alias("major"), "every",
                   (F.col("every") - F.col("top.w")).alias("outside")))

    def parts(n: str) -> tuple[Column, Column]:
        blocks = F.ceil(F.col(n) / BLOCK).cast("int")
        return F.pmod(F.xxhash64("id"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)

    (i, every_i), (j, every_j) = parts("outside"), parts("every")
    left = F.transform(every_j, lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(True).alias("left")))
    right = F.transform(every_i, lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(False).alias("left")))
    minor = F.col("root") != F.col("major")
    return rows.join(top, "key").select(
        "key", "id", "root", "size", "bits", minor.alias("minor"),
        F.inline(F.when(minor, F.concat(left, right)).otherwise(right)))


def _sides(b: pa.RecordBatch) -> tuple[dict, dict]:
    side = b.column("left").to_numpy(zero_copy_only=False)
    plain = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "size", "minor")}
    longs = b.column("bits")
    width = len(longs[0])
    plain["bits"] = longs.flatten().to_numpy().reshape(-1, width)
    return tuple({**{c: v[at] for c, v in plain.items()}, "at": at}
                 for at in (np.flatnonzero(side), np.flatnonzero(~side)))


def close_pairs(b: pa.RecordBatch, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a block, left and right, that may be alike by size and sketch; by slices of the left.

    Two nodes outside the largest class meet twice, so one order of them is left out."""
    x, y = _sides(b)
    longs = x["bits"].shape[1]
    most, step = most_differ(percent, 64 * longs), 128
    for at in range(0, len(x["id"]), step):
        u = {c: v[at:at + step, None] for c, v in x.items() if c != "bits"}
        ok = (u["root"] != y["root"]) & (~y["minor"] | (u["id"] < y["id"]))
        ok &= 100 * np.minimum(u["size"], y["size"]) >= percent * np.maximum(u["size"], y["size"])
        bits = x["bits"][at:at + step]
        gap = sum(np.bitwise_count((bits[:, k, None] ^ y["bits"][:, k]).view(np.uint64)) for k in range(longs))
        p, q = np.nonzero(ok & (gap <= most))
        yield x["at"][at + p], y["at"][q]


BLOCK_ROW = "key long, id long, root long, size int, bits array<long>, minor boolean, i int, j int, left boolean"


def screened(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks that may be alike to another class's row there."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(batches, ["key", "i", "j"]):
            used = np.zeros(b.num_rows, bool)
            for p, q in close_pairs(b, percent):
                used[p] = used[q] = True
            if used.any():
                yield b.filter(pa.array(used))

    return sorted_blocks(blocks).mapInArrow(find, BLOCK_ROW)


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def forest_of(names: np.ndarray) -> Callable[[int, int], bool]:
    """Joins two of the rows; tells whether their names' trees were apart until then."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(p: int, q: int) -> bool:
        a, b = top(int(names[p])), top(int(names[q]))
        if a == b:
            return False
        up[max(a, b)] = min(a, b)
        return True

    return join


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all classes with alike nodes in one bucket of rows (key, id, root, size,
    bits). A block tests what its earlier links haven't joined yet."""
    passed = settle(screened(deal(rows), percent), "screened")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(batches, ["key", "i", "j"]):
            members, ids = b.column("members"), b.column("id").to_numpy()
            sets_ = [unpacked(m.as_py()) for m in members]
            join, found = forest_of(b.column("root").to_numpy()), []
            for p, q in close_pairs(b, percent):
                order = np.argsort(p, kind="stable")
                edges = np.r_[np.flatnonzero(np.diff(p[order], prepend=-1)), len(p)]
                for s, e in zip(edges, edges[1:]):
                    own = sets_[p[order[s]]]
                    hits = overlapping(own, [sets_[k] for k in q[order[s:e]]], percent)
                    for k in q[order[s:e]][hits].tolist():
                        if join(int(p[order[s]]), k):
                            found.append((ids[p[order[s]]], ids[k]))
            if found:
                a, c = np.array(found).T
                yield pa.record_batch([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    full = passed.join(sets, "id").select(*[f.split()[0] for f in BLOCK_ROW.split(", ")], "members")
    return sorted_blocks(full).mapInArrow(find, "a long, b long")


def overlapping(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the others are alike to one set; hashes are looked up for all of them at once."""
    sizes = np.array([len(s) for s in others])
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    hit = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == flat)
    common = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)[:-1]])
    return 100 * common >= percent * (len(own) + sizes - common)


def merged(classes: DataFrame, links: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """classes (id, root) after the links (a, b). components: v, root of each end of edges (a, b)."""
    edges = (links.join(classes.toDF("a", "ra"), "a").join(classes.toDF("b", "rb"), "b")
             .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
             .distinct())
    edges = settle(edges, "links")
    if edges.isEmpty():
        return classes
    up = components(edges).toDF("root", "top")
    return settle(classes.join(up, "root", "left").select(
        "id", F.coalesce("top", "root").alias("root")), "classes")
