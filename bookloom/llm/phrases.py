"""Phrases that stand out from the frequencies of their parts, counted by vertical partitioning.

Each place of a piece of text begins a suffix, truncated to three words; the counts of all phrases of
two and three words are the nodes of the tree of these suffixes. It is built in parts. A word is the
prefix of a part of its own; one with more than a 10,000th of all words (`FREQUENT`) is extended by its
next word, and by two where that is frequent as well, so no part holds much of the text. Parts
are dealt to tasks by prefix, sorted, and taken in groups of prefixes of up to `BUDGET` suffixes: as
many as memory holds at once, a larger prefix being cut at its longer ones. Each group's truncated
subtrees are built by themselves, and counts are sums of leaf totals. A node that lies above several
parts is summed over them. Equal suffixes are summed before they move.

Texts are lower-cased (A-Z), null is empty; pieces end at . , ; : ! ? and line breaks, words are what
stands between blanks and tabs. Languages are counted apart (null: `und`); repeated rows count again.
Empty tables give no rows; ids and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.llm.common import settle
from bookloom.llm.wordhash import BYTE, Q1, Q2, Words, cut, encoded, mix, portions, spans_hash

#: A word with more than one in so many of all words is frequent; there are at most so many.
FREQUENT = 10_000
#: Suffixes in a group of prefixes.
BUDGET = 200_000
#: Bytes of text that are summed at once.
PORTION = 6_000_000
#: Parts in which a language's phrases are ranked at first.
RANKED = 64
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, what ends a piece as a line break, tabs as blanks.
TABLE = bytes(10 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.isin(np.arange(256), [10, 32])


def joined(w: Words, parts: list[np.ndarray]) -> pa.Array:
    """Strings made of words, joined by blanks. parts: for each place in a string, word numbers."""
    n, k = len(parts[0]), 2 * len(parts) - 1
    at, size = np.zeros((n, k), np.int64), np.ones((n, k), np.int64)  # the data begins with a blank
    for i, p in enumerate(parts):
        at[:, 2 * i], size[:, 2 * i] = w.starts[p], w.ends[p] - w.starts[p]
    size = size.ravel()
    end = np.cumsum(size)
    place = np.repeat(at.ravel() - (end - size), size) + np.arange(end[-1] if n else 0)
    offsets = np.r_[0, end[k - 1::k]].astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(w.data[place]))


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of first members, and sizes, of the groups of equal pairs of hashes."""
    order = np.argsort(one, kind="stable")
    new = np.ones(len(one), bool)
    new[1:] = one[order][1:] != one[order][:-1]
    if (two[order][1:][~new[1:]] != two[order][:-1][~new[1:]]).any():
        order = np.lexsort((two, one))
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    edges = np.flatnonzero(new)
    return order[edges], np.diff(np.r_[edges, len(one)])


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for b in batches:
        for part in portions(b, 1, PORTION):
            texts: dict[str, list[bytes]] = {}
            for lang, t in zip(part.column(0).to_pylist(), encoded(part.column(1))):
                texts.setdefault(lang, []).append(t.translate(TABLE) + b"\n")
            for lang, own in texts.items():
                w = cut(own, BLANK)
                if len(w.starts):
                    yield lang, w


def second_hash(w: Words) -> np.ndarray:
    return spans_hash(BYTE[w.data] ^ np.uint64(0x5BF03635A5A5), w.starts, w.ends, Q2)


def source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word), f."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in by_language(batches):
            at, n = distinct(w.hashes, second_hash(w))
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), joined(w, [at]),
                                   pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return source(docs).mapInArrow(find, "lang string, phrase string, n long").groupBy(
        "lang", "phrase").agg(F.sum("n").alias("f"))


def suffixes(docs: DataFrame, frequent: set[tuple[str, str]]) -> DataFrame:
    """suffix (language, tab, two words, blank, third word or nothing), depth (words of the prefix that
    decides its part), n."""
    hot: dict[str, list[str]] = {}
    for lang, word in frequent:
        hot.setdefault(lang, []).append(word)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in by_language(batches):
            n = len(w.starts)
            if n < 2:
                continue
            line = np.cumsum(w.data == 10)[w.starts]
            i = np.flatnonzero(line[1:] == line[:-1])
            third = np.zeros(n, bool)
            third[:n - 2] = line[2:] == line[:-2]
            one, two = w.hashes, second_hash(w)

            def key(h: np.ndarray, times: int) -> np.ndarray:
                last = np.where(third[i], h[np.minimum(i + 2, n - 1)], np.uint64(0))
                return mix((h[i] * np.uint64(times) + h[i + 1]) * np.uint64(times) + last)

            first, count = distinct(key(one, Q1), key(two, Q2))
            order = np.lexsort((one[i[first] + 1], one[i[first]]))  # like rows stand together, which packs well
            i, count = i[first][order], count[order]
            tail = pc.if_else(pa.array(third[i]), joined(w, [np.minimum(i + 2, n - 1)]), "")
            own = words_hash(hot.get(lang, []))
            common, common_2 = np.isin(one[i], own), np.isin(one[i + 1], own)
            depth = (1 + common + (common & common_2)).astype(np.int8)
            yield pa.record_batch(
                [pc.binary_join_element_wise(pc.binary_join_element_wise(
                    lang, joined(w, [i, i + 1]), "\t"), tail, " "),
                 pa.array(depth), pa.array(count, pa.int64())], ["suffix", "depth", "n"])

    return source(docs).mapInArrow(find, "suffix string, depth byte, n long")


#: A suffix's language, head (two words) and tail; words hold neither tabs nor blanks.
ROW = ["suffix", "depth", "n"]
SUFFIX = r"(?s)^(?P<lang>.*)\t(?P<head>[^ ]* [^ ]*) (?P<tail>[^ ]*)$"


def words_hash(words: list[str]) -> np.ndarray:
    return cut([x.encode() for x in words], BLANK).hashes


def groups(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted rows (suffix, depth, n), equal ones summed, in groups of whole heads with up to about
    `budget` rows: lang, head, tail, depth, n. False: the last head of the group goes on in the next."""
    rest: list[pa.Table] = []
    held = 0

    def joint() -> pa.Table:
        return pa.concat_tables(rest).combine_chunks()

    for b in batches:
        rest.append(pa.Table.from_batches([b]).select(ROW))
        held += b.num_rows
        if held < budget:
            continue
        t = parsed(joint())
        edge = np.flatnonzero(new_heads(t))
        # a prefix beyond the budget is cut at longer ones
        whole_heads = len(edge) > 1
        at = int(edge[-1]) if whole_heads else t.num_rows - 1
        if at:
            yield t.slice(0, at).drop_columns("suffix"), whole_heads
        rest = [t.slice(at).select(ROW)]
        held = rest[0].num_rows
    if rest and held:
        yield parsed(joint()).drop_columns("suffix"), True


def parsed(t: pa.Table) -> pa.Table:
    leaf = np.flatnonzero(changes(t, "suffix"))
    sums = np.add.reduceat(t.column("n").to_numpy(), leaf)
    t = t.take(leaf).set_column(ROW.index("n"), "n", pa.array(sums)).combine_chunks()
    parts = pc.extract_regex(t.column("suffix").combine_chunks(), SUFFIX)
    for name in ("lang", "head", "tail"):
        t = t.append_column(name, pc.struct_field(parts, name))
    return t


def changes(t: pa.Table, column: str) -> np.ndarray:
    c = t.column(column).combine_chunks()
    out = np.ones(len(c), bool)
    if len(c) > 1:
        out[1:] = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def new_heads(t: pa.Table) -> np.ndarray:
    return changes(t, "lang") | changes(t, "head")


def tree_counts(parts: DataFrame, least: int, budget: int) -> DataFrame:
    """lang, phrase, k (its words), f: counts of the tree's nodes, from suffixes dealt by prefix and
    sorted; those under `least` only where other groups may add to them."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_head = None
        for t, ended in groups(batches, budget):
            n = t.column("n").to_numpy()  # of leaves
            node = np.flatnonzero(new_heads(t))
            sums = np.add.reduceat(n, node)
            heads = t.select(["lang", "head"]).take(node)
            ends = [(heads.column("lang")[k].as_py(), heads.column("head")[k].as_py()) for k in (0, -1)]
            shared = t.column("depth").to_numpy()[node] == 3
            shared[0] |= ends[0] == open_head
            shared[-1] |= not ended
            open_head = None if ended else ends[1]
            keep = (sums >= least) | shared
            two = heads.filter(pa.array(keep))
            deep = (n >= least) & pc.not_equal(t.column("tail"), "").to_numpy()
            three = t.filter(pa.array(deep))
            for rows, phrase, k, f in (
                    (two, two.column("head"), 2, sums[keep]),
                    (three, pc.binary_join_element_wise(three.column("head"), three.column("tail"), " "),
                     3, n[deep])):
                if rows.num_rows:
                    yield from pa.table({
                        "lang": rows.column("lang"), "phrase": phrase,
                        "k": pa.array(np.full(len(f), k, np.int32)), "f": pa.array(f)}).combine_chunks().to_batches()

    return parts.mapInArrow(build, "lang string, phrase string, k int, f long")


def frequencies(docs: DataFrame, least: int, budget: int = BUDGET,
                frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Words (lang, phrase, f), and phrases of two and three words (with k) from `least` on."""
    words = settle(word_counts(docs), "words")
    total = words.agg(F.sum("f")).head()[0] or 0
    hot = {(r["lang"], r["phrase"]) for r in  # fewer than `frequent` rows
           words.where(F.col("f") * frequent > total).select("lang", "phrase").collect()}
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.expr("substring_index(suffix, ' ', int(depth))")
    parts = suffixes(docs, hot).repartition(n, prefix).sortWithinPartitions("suffix")
    counts = tree_counts(parts, least, budget).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(
        F.col("f") >= least)
    return words, settle(counts, "phrases")


def scored(words: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """Phrases with l, r and score of their lowest cut."""
    known = words.where(F.col("f") >= least).select("lang", "phrase", "f").unionByName(
        phrases.where("k = 2").select("lang", "phrase", "f"))
    parts = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "k", F.col("f").alias("a"),
                          F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "k", "a", "cut",
        F.array_join(F.slice(parts, 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    met = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(
        known.toDF("lang", "right", "r"), ["lang", "right"])
    rows = met.withColumn("score", ratio("a", "l", "r"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return rows.groupBy("lang", "phrase", "k", "a").agg(best).select(
        "lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def ratio(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**15."""
    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(16,0)")

    top = F.lit(1_000_000).cast("decimal(7,0)")
    square = (wide(a) * wide(a)).cast("decimal(31,0)")
    return F.call_function("div", (square * top).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(32,0)"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2_000,
                 budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, without those of
    which a longer one holds at least `share` per cent."""
    words, phrases = frequencies(docs, least, budget)
    longer = phrases.where("k = 3").select("lang", "f", F.split("phrase", " ").alias("w")).select(
        "lang", "f", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]),
                                       F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored(words, phrases, least).join(inside, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    first = kept.withColumn("part", part).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                             "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, x FROM
    (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
w AS (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM
    (SELECT lang, piece, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda v: v <> '') AS ws FROM p)),
s AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w
    WINDOW o AS (PARTITION BY piece ORDER BY pos)),
f AS (SELECT lang, w1 AS phrase, 1 AS k, count(*) AS f FROM s GROUP BY ALL UNION ALL
    SELECT lang, w1 || ' ' || w2, 2, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL
    SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, k, a, cut, array_to_string(ws[:cut], ' ') AS lft, array_to_string(ws[cut + 1:], ' ') AS rgt
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
rated AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lft JOIN f y ON y.lang = cuts.lang AND y.phrase = rgt),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * longer < 50 * a, true)),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  JOIN n USING (lang) WHERE rank <= 2000"""
