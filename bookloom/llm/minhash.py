"""Near duplicates by MinHash with banding, and components by alternating large-star and small-star.

Words are what stands between blanks and the characters 09 to 0D, with A-Z in lower case. A document
is the set of its runs of two words; a single word is a set of one. Equal sets are one node from the
start. A node has `BANDS` x `ROWS` minima of universal hash functions x -> a * x + b; each band of
`ROWS` of them is a bucket key. A pair at the limit of 80 % shares no band once in twenty million
cases: (1 - 0.8**4)**32.

Candidates are verified on the signature (one bit of each minimum; a pair at the limit fails that in
3 of a million cases), then on the whole sets. Pairs inside a group of copies are not listed: each
node meets a leader of each of its buckets, links become classes, and only nodes of different classes
are compared in the end, in blocks (see `clusters`).

Classes are joined by large-star steps (each larger neighbour of a node is tied to the smallest one)
and small-star steps (each smaller neighbour), until no edge changes; the edges are then stars around
the smallest ids. Each step is written to shared storage.

Null, empty and wordless texts have an empty set: a component of their own, kept. Repeated rows are
one node; rows with the same id and different texts are compared one by one. Rows without an id take
part: their component is the smallest id they reach, or null, and they are kept where it is null. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm import clusters
from bookloom.llm.common import settle
from bookloom.llm.wordhash import cut, encoded, mix, portions

BANDS, ROWS = 32, 4
LONGS = BANDS * ROWS // 64
#: Sets that a task remembers; bytes of text that it takes at once.
SEEN, PORTION = 50_000, 500_000
_rng = np.random.default_rng(12)
A = _rng.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32)


def shingles(texts: list[bytes], n: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of n words."""
    w = cut([t.lower() for t in texts])  # of bytes: A-Z only
    runs, out = w.runs(n), []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if 0 < b - a < n:
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            found = mix(np.array([np.bitwise_xor.reduce(mix(w.hashes[a:b] + place))]))
        else:
            found = runs[a:max(a, b - n + 1)]
        out.append(np.unique(found))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    h = (mix(s) >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(best, (h[at:at + 1024, None] * A + B).min(axis=0), out=best)
    return best


def digest(s: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.md5(s.tobytes()).digest(), "<i8").tolist()


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, size (of the set), hi, lo (digest of the set) of every row."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1, PORTION):
                sets = shingles(encoded(part.column(1)))
                hi, lo = zip(*(digest(s) for s in sets))
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array(hi, pa.int64()), pa.array(lo, pa.int64())],
                                      ["doc_id", "size", "hi", "lo"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, size long, hi long, lo long")


def sketches(docs: DataFrame) -> DataFrame:
    """hi, lo, size, bands, bits, members of the sets that aren't empty; a task tells most sets it
    meets again only once."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        many, seen = pa.list_(pa.int64()), set()
        types = (pa.int64(), pa.int64(), pa.int32(), many, many, pa.binary())
        for b in batches:
            for part in portions(b, 0, PORTION):
                rows = []
                for s in shingles(encoded(part.column(0))):
                    hi, lo = digest(s)
                    if not len(s) or (hi, lo) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add((hi, lo))
                    sig, key = minima(s), start
                    for v in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
                        key = mix(key * np.uint64(31) + v + np.uint64(1))
                    bits = np.packbits((sig >> 7 & 1).astype(np.uint8)).view("<i8")
                    rows.append((hi, lo, len(s), key.view(np.int64), bits, clusters.packed(s)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          ["hi", "lo", "size", "bands", "bits", "members"])

    return docs.select("text").mapInArrow(
        find, "hi long, lo long, size int, bands array<long>, bits array<long>, members binary")


def large_star(edges: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(least, "b")
    return met.select(F.col("m").alias("a"), "b").union(
        met.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest id that each end of the edges (a, b) reaches."""
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .where("a <> b").distinct(), "edges")
    known = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if state == known:
            break
        known = state
        edges = settle(small_star(large_star(edges)), "edges")
    stars = edges.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return stars.union(edges.select("a", F.col("a")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. percent: least share of common runs, 80 or more."""
    if percent < 80:
        raise ValueError(f"{BANDS} bands of {ROWS} don't find pairs of {percent} %")
    every = settle(prints(docs), "prints")
    nodes = clusters.node_table(sketches(docs), "minhash")
    sets, classes = nodes.select("id", "members"), nodes.select("id", F.col("id").alias("root"))
    shared = clusters.shared(nodes.select("id", F.explode("bands").alias("key")))
    led = clusters.leader_pairs(shared.join(nodes.select("id", "bits"), "id"), percent, LONGS)
    classes = clusters.merged(classes, clusters.verified(led, sets, percent), components)
    rows = shared.join(nodes.select("id", "size", "bits"), "id").join(classes, "id")
    classes = clusters.merged(classes, clusters.block_links(rows, sets, percent), components)
    some = every.where("size > 0")
    names = clusters.named(some, nodes, classes).select("hi", "lo", F.col("class_id").alias("component_id"))
    found = some.join(names, ["hi", "lo"]).select("doc_id", "size", "component_id")
    return found.union(every.where("size = 0").select(
        "doc_id", "size", F.col("doc_id").alias("component_id"))).select(
        "doc_id", F.col("size").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
    JOIN n ON n.doc_id = x.doc_id JOIN n m ON m.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, n.n, m.n HAVING 100 * count(*) >= 80 * (n.n + m.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id,
  doc_id <= coalesce(c.least, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) c USING (doc_id)"""
