"""First-fit decreasing packing of token pieces, with a tournament tree of bin capacities.

Each document's ids, closed by an end id, are cut into pieces of `size` and a rest. Documents are
dealt by a hash of their id into groups of about `per_group`, so that no source, topic or length
gathers in one; each group is packed by itself, and more data only means more groups. In a group,
pieces are placed longest first, each into the first sequence with room, which the tree finds in
logarithmic time.

Null text counts as empty and yields the end id alone. Pieces of equal length go by doc_id, then
start, then ids. Rows with null ids form documents like others and repeated rows are packed once
each. Empty tables give no pieces; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.tokenizer import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = PIECES + ", sequence_id long, offset long"


class Tournament:
    """Room left in bins; every inner node holds the larger of its children's."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Takes `length` from the first bin that has it and returns that bin."""
        best, at = self.best, 1
        if best[1] < length:
            raise ValueError(f"no bin has room for {length}")
        while at < self.leaves:
            at *= 2
            at += best[at] < length
        found = at - self.leaves
        best[at] -= length
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Bin and offset of each length, which must come longest first."""
    tree, used, out = Tournament(len(lengths), size), [0] * len(lengths), []
    for n in lengths:
        b = tree.place(n)
        out.append((b, used[b]))
        used[b] += n
    return out


def tokenize(docs: DataFrame, path: str, end_id: int, size: int, batch: int = 256,
             memo: int = 500_000) -> DataFrame:
    """Pieces of each document: ids are little-endian unsigned 32-bit integers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(path, memo), array("I", [end_id]).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part, rows = b.slice(at, batch), []
                names = part.column(0).to_pylist()
                for doc, ids in zip(names, e.ids(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, s, min(size, n - s), n, ids[4 * s:4 * (s + size)])
                             for s in range(0, n, size)]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.binary(),))],
                    ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1,
         per_group: int = 4096, memo: int = 500_000) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset of each piece.

    sequence_id: the group times 2**32, plus the sequence's number in it. memo: how much a worker's
    encoder remembers; less where other stages' workers stay in memory."""
    groups = max(1, -(-docs.count() // per_group))

    def place(key: tuple, t: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                 ("ids", "ascending")]
        t = t.sort_by(order)
        found = first_fit_decreasing(t.column("length").to_pylist(), size)
        base = key[0].as_py() << 32
        return (t.drop_columns(["part"])
                .append_column("sequence_id", pa.array([base + b for b, _ in found], pa.int64()))
                .append_column("offset", pa.array([o for _, o in found], pa.int64())))

    pieces = tokenize(docs, path, end_id, size, memo=memo)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)).alias("part")
    return pieces.select(part, "*").groupBy("part").applyInArrow(place, PACKED)
