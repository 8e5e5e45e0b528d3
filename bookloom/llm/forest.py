"""Similarity join of documents by n-gram Jaccard with a MinHash LSH forest.

A document is the set of its runs of five words (lower case, letters and digits; fewer words are
one run). Equal sets are one node from the start. Each node has `TREES` signatures of `DEPTH` minimum
hashes; a signature is a path in a trie of its own. The tries are kept as one table of the paths that
share their shortest used prefix with another node's; its levels are read from the longest prefix on, sorted and
merged by prefix.

Walking down a level at a time, each node meets a leader of its trie node, and matches contract to
classes before the prefixes are shortened by one: near copies merge where prefixes are long and few nodes
share them, and later meet as one class. Shortening ends at the first length d with
1 - (1 - least**d)**TREES >= `RECALL`, the share of pairs of `least` similarity that meet in some tree
(six hashes at 0.95, four at 0.8). On that level all that still differs is compared: the nodes outside a
trie node's largest class with all of it, in blocks, by sketch and by set. Every candidate is verified on
its whole set. No pairs of a class are listed and a block returns a spanning forest of its links (see
`clusters`), so rows follow nodes, not pairs.

Links are then counted exactly within each class, in blocks of texts against blocks; the price
grows with the square of a class's different texts, copies count once, and no pair leaves a task.

Null, empty and wordless texts have no set: each is a class of its own without links. Repeated rows
count as copies, and rows without an id take part like others; a class of such rows only has a null
class_id. Ties go to the smallest id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm import clusters
from bookloom.llm.clusters import packed, unpacked
from bookloom.llm.common import settle
from bookloom.llm.minhash import components
from bookloom.llm.wordhash import cut, encoded, mix, portions

TREES, DEPTH = 24, 6
#: The sketch has one bit of each of the first hashes, in so many longs.
LONGS = 2
#: Least share of the pairs of `least` similarity that meet in some tree.
RECALL = 0.99999
#: Sets that a task remembers; bytes of text that it takes at once.
SEEN, PORTION = 50_000, 500_000
WORD = 5
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_rng = np.random.default_rng(7)
FLIP = _rng.integers(0, 2**32, TREES * DEPTH, np.uint32)
TIMES = _rng.integers(0, 2**31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes], n: int = WORD) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of n words."""
    w = cut([t.lower() for t in texts], NOT_WORD)
    runs, out = w.runs(n), []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            found = runs[a:b - n + 1]
        elif b > a:
            found = mix(np.array([np.bitwise_xor.reduce(
                mix(w.hashes[a:b] + np.arange(b - a, dtype=np.uint64)))]))
        else:
            found = runs[:0]
        out.append(np.unique(found))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of the set under each hash function."""
    h = (mix(s) >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(best, ((h[at:at + 1024, None] ^ FLIP) * TIMES).min(axis=0), out=best)
    return best


def prefixes(sig: np.ndarray) -> np.ndarray:
    """Hash of each tree's prefix of each length: DEPTH rows of TREES."""
    key = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = []
    for v in sig.reshape(TREES, DEPTH).T.astype(np.uint64):
        key = mix(key * np.uint64(31) + v + np.uint64(1))
        rows.append(key.view(np.int64))
    return np.array(rows)


def least_depth(least: float) -> int:
    """Hashes of the longest prefix at which pairs of `least` similarity meet with RECALL."""
    fit = [d for d in range(1, DEPTH + 1) if 0 < least <= 1 and 1 - (1 - least**d)**TREES >= RECALL]
    if not fit:
        raise ValueError(f"{TREES} trees don't find pairs of similarity {least}")
    return fit[-1]


def digest(s: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.md5(s.tobytes()).digest(), "<i8").tolist()


def prints(docs: DataFrame) -> DataFrame:
    """The columns of docs other than text, with _size (of the set), _hi, _lo (its digest)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    more = [T.StructField(n, T.LongType()) for n in ("_size", "_hi", "_lo")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, b.num_columns - 1, PORTION):
                sets = shingle_sets(encoded(part.column(b.num_columns - 1)))
                hi, lo = zip(*(digest(s) for s in sets))
                yield pa.record_batch(
                    [*part.columns[:-1], *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], hi, lo))],
                    [*[f.name for f in kept], "_size", "_hi", "_lo"])

    return docs.select(*[f.name for f in kept], "text").mapInArrow(find, T.StructType([*kept, *more]))


def sketches(docs: DataFrame, depth: int) -> DataFrame:
    """hi, lo, size, paths (for each tree its prefixes of `depth` to DEPTH hashes, longest first), bits,
    members of the sets that aren't empty; a task tells most sets it meets again only once."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, seen = pa.list_(pa.int64()), set()
        types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(many), many, pa.binary())
        for b in batches:
            for part in portions(b, 0, PORTION):
                rows = []
                for s in shingle_sets(encoded(part.column(0))):
                    hi, lo = digest(s)
                    if not len(s) or (hi, lo) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add((hi, lo))
                    sig = signature(s)
                    bits = np.packbits((sig[:64 * LONGS] >> 7 & 1).astype(np.uint8)).view("<i8")
                    paths = prefixes(sig)[depth - 1:][::-1].T
                    rows.append((hi, lo, len(s), list(paths), bits, packed(s)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          ["hi", "lo", "size", "paths", "bits", "members"])

    return docs.select("text").mapInArrow(
        find, "hi long, lo long, size int, paths array<array<long>>, bits array<long>, members binary")


def classes_of(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """prints of docs; nodes (id, hi, lo, members, …); classes (id, root)."""
    percent, depth = round(100 * least), least_depth(least)
    every = settle(prints(docs.select("doc_id", "text")), "prints")
    nodes = clusters.node_table(sketches(docs, depth), "forest")
    sets, classes = nodes.select("id", "members"), nodes.select("id", F.col("id").alias("root"))
    paths = nodes.select("id", F.explode("paths").alias("path"))
    levels = DEPTH - depth + 1
    many = paths.groupBy(F.col("path")[levels - 1].alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    tries = settle(paths.withColumn("key", F.col("path")[levels - 1]).join(many.select("key"), "key").select(
        "id", "path"), "tries")
    bits = nodes.select("id", "bits")
    for level in range(levels):
        rows = tries.select("id", F.col("path")[level].alias("key")).join(classes, "id")
        mixed = rows.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q")
        met = rows.join(mixed.select("key"), "key").select("key", "id").join(bits, "id")
        led = clusters.leader_pairs(met, percent, LONGS)
        if level:
            led = led.join(classes.toDF("a", "ra"), "a").join(classes.toDF("b", "rb"), "b").where(
                "ra <> rb").select("a", "b")
        classes = clusters.merged(classes, clusters.verified(led, sets, percent), components)
    rows = tries.select("id", F.col("path")[levels - 1].alias("key")).join(
        nodes.select("id", "size", "bits"), "id").join(classes, "id")
    classes = clusters.merged(classes, clusters.block_links(rows, sets, percent), components)
    return every, nodes, classes


def near_duplicates(docs: DataFrame, least: float = 0.8, count_links: bool = True) -> DataFrame:
    """doc_id, class_id (smallest id of its class), class_size, n_links (other rows that are at
    least `least` alike, a whole number of hundredths)."""
    every, nodes, classes = classes_of(docs, least)
    some = every.where("_size > 0").select("doc_id", F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))
    weights = some.groupBy("hi", "lo").agg(F.count("*").alias("weight"))
    members = clusters.named(some, nodes, classes).join(weights, ["hi", "lo"])
    sizes = members.groupBy("root").agg(F.sum("weight").alias("class_size"), F.count("*").alias("texts"))
    found = members.join(sizes, "root")
    if count_links:
        links = link_counts(found.where("texts > 1").join(nodes.select("id", "members"), "id"), least)
        found = found.join(links, "id", "left")
    else:
        found = found.withColumn("links", F.lit(0))
    found = found.select("hi", "lo", "class_id", "class_size",
                         (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    lone = every.where("_size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"))
    return some.join(found, ["hi", "lo"]).select(
        "doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"),
        F.col("n_links").cast("long").alias("n_links")).unionByName(lone)


def link_counts(rows: DataFrame, least: float, block: int = 200) -> DataFrame:
    """id, links: rows (id, root, texts, weight, members) of its class that are alike."""
    percent = round(100 * least)
    n = F.ceil(F.col("texts") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other).select(
        "id", "root", "weight", "members", "own", F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"))

    def count(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        side = t.column("own").to_numpy()
        sets = [unpacked(m) for m in t.column("members").to_pylist()]
        weight, size = t.column("weight").to_numpy(), np.array([len(s) for s in sets])
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        common = overlaps([sets[k] for k in left], [sets[k] for k in right])
        alike = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        if i == j:
            np.fill_diagonal(alike, False)
            links = alike @ weight[right]
            at = left
        else:
            links = np.r_[alike @ weight[right], alike.T @ weight[left]]
            at = np.r_[left, right]
        return pa.table({"id": t.column("id").to_numpy()[at], "links": links.astype(np.int64)})

    return (dealt.groupBy("root", "i", "j").applyInArrow(count, "id long, links long")
            .groupBy("id").agg(F.sum("links").alias("links")))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    values = np.intersect1d(a, b)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    for at in range(0, len(values), width):
        part, dense = values[at:at + width], []
        for flat, row, s in ((a, rows[0], left), (b, rows[1], right)):
            m = np.zeros((len(s), len(part)), np.float32)
            col = np.searchsorted(part, flat)
            hit = (col < len(part)) & (part[np.minimum(col, len(part) - 1)] == flat)
            m[row[hit], col[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def keep(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of docs for each class, unchanged: that whose id is the class's. Of a class without any id
    one row stays; rows without words all stay."""
    every, nodes, classes = classes_of(docs, least)
    some = every.where("_size > 0").select("doc_id", F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))
    names = clusters.named(some, nodes, classes)
    lone = every.where("_size = 0").select(F.col("doc_id").alias("_id"))
    stay = names.where("class_id is not null").select(F.col("class_id").alias("_id")).union(lone).distinct()
    # the digests tell which rows without an id belong together; docs may have a column of any name
    nameless = docs.where("doc_id is null")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    marked = prints(nameless.select(whole.alias("_row"), "text"))
    roots = names.where("class_id is null").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "root")
    one = marked.join(roots, ["_hi", "_lo"]).groupBy("root").agg(
        F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    wordless = marked.where("_size = 0").select("_row.*")
    kept = docs.where("doc_id is not null").join(stay, F.col("doc_id") == F.col("_id"), "left_semi")
    return kept.union(one).union(wordless)
