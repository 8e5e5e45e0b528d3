"""Token counts of whole texts, huge ones in overlapping chunks that are spliced.

A text of up to `chunk` characters is counted at once. A longer one is cut into chunks that
overlap; chunks are dealt out over the cluster and encoded with offsets. Two neighbours are
spliced at the first position of their overlap where both encodings have a token boundary and the
text itself proves the boundary stable: a character that is not white space before it and white
space after it, which no token of the supported kinds spans, whatever stands further off. Where
an overlap has no such place, that document goes round again with overlaps eight times as wide;
once an overlap covers the document it is encoded whole.

Null text counts as empty: 0 bytes, 0 tokens. Empty tables give empty results; every row is
counted by itself, so repeated ids are fine; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import settle
from bookloom.llm.tokenizer import encoder

WIDEN = 8
SPACES = re.compile(r"\s+")


def stable(text: str, at: int) -> bool:
    """Whether the text proves a token boundary before character `at`."""
    def space(c: str) -> bool:
        return c.isspace() and not "\x1c" <= c <= "\x1f"

    return 0 < at < len(text) and space(text[at]) and not space(text[at - 1])


def chunk_rows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, bool, str]]:
    """number, start, whether it is the last, characters of each chunk."""
    if overlap >= len(text):
        yield 0, 0, True, text
        return
    k = start = 0
    while True:
        end = min(len(text), start + chunk + overlap)
        yield k, start, end == len(text), text[start:end]
        if end == len(text):
            return
        k, start = k + 1, start + chunk


def boundaries(text: str, spans: list[tuple[int, int]], lo: int, hi: int) -> dict[int, int]:
    """Stable boundaries in [lo, hi) where a token starts: position -> tokens before it."""
    found: dict[int, int] = {}
    blanks = SPACES.finditer(text)
    a, b = 0, 0
    for n, (start, _) in enumerate(spans):
        while b < start and (run := next(blanks, None)):
            a, b = run.span()
        # offsets may leave out white space that belongs to the token
        at = a if a < start <= b else start
        for p in (at, start):
            if lo <= p < hi and p not in found and stable(text, p):
                found[p] = n
    return found


def count_tokens(docs: DataFrame, path: str, chunk: int = 65_536, overlap: int = 1_024,
                 batch: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text). path: the tokenizer file."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(1).to_pylist()
                yield pa.record_batch(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array([len(i) // 4 for i in e.ids(texts)], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    counts = "doc_id long, n_bytes long, n_tokens long"
    done = rows.where(F.length("text") <= chunk).mapInArrow(short, counts)
    # a key for each row, since ids may repeat; rows are the same however often they are read
    left = rows.where(F.length("text") > chunk).withColumn(
        "row", F.concat_ws("-", F.monotonically_increasing_id(), F.sha2("text", 256)))
    while True:
        part = settle(_spliced(left, path, chunk, overlap), "token_count")
        done = done.unionByName(part.where("aligned").select("doc_id", "n_bytes", "n_tokens"))
        open_rows = part.where("not aligned").select("row")
        if open_rows.isEmpty():
            return done
        left = left.join(open_rows, "row", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, overlap)


def _spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens, aligned: whether all neighbours met."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for k, start, last, piece in chunk_rows(text, chunk, overlap):
                    yield pa.record_batch(
                        [pa.array([row]), pa.array([doc], pa.int64()), pa.array([k], pa.int32()),
                         pa.array([last]), pa.array([piece])],
                        ["row", "doc_id", "k", "last", "piece"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for row, doc, k, last, piece in zip(*(b.column(i).to_pylist() for i in range(5))):
                spans = e.spans(piece)
                left = boundaries(piece, spans, 0, overlap) if k else {}
                right = {} if last else boundaries(piece, spans, chunk, chunk + overlap)
                yield pa.record_batch(
                    [pa.array([row]), pa.array([doc], pa.int64()), pa.array([k], pa.int32()),
                     pa.array([last]), pa.array([len(piece[:None if last else chunk].encode())],
                                                pa.int64()),
                     pa.array([len(spans)], pa.int64()),
                     pa.array([list(left.items())], pa.map_(pa.int64(), pa.int64())),
                     pa.array([[(p - chunk, n) for p, n in right.items()]],
                              pa.map_(pa.int64(), pa.int64()))],
                    ["row", "doc_id", "k", "last", "n_bytes", "n", "left", "right"])

    chunks = rows.select("row", "doc_id", "text").mapInArrow(
        cut, "row string, doc_id long, k int, last boolean, piece string")
    sides = settle(chunks.repartition(F.col("row"), F.col("k")).mapInArrow(
        encode, "row string, doc_id long, k int, last boolean, n_bytes long, n long, "
                "left map<long,long>, right map<long,long>"), "token_chunks")
    after = sides.select("row", (F.col("k") - 1).alias("k"), F.col("left").alias("next"))
    at = F.array_min(F.array_intersect(F.map_keys("right"), F.map_keys("next")))
    pairs = sides.join(after, ["row", "k"], "left").withColumn("at", at)
    # tokens up to the splice on the right, less those before the splice on the left
    return pairs.groupBy("row", "doc_id").agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.when(F.col("last"), F.col("n"))
              .otherwise(F.element_at("right", F.col("at")) - F.element_at("next", F.col("at"))))
        .alias("n_tokens"),
        F.every(F.col("last") | F.col("at").isNotNull()).alias("aligned"))
