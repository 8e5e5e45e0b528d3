"""Token ids in files of bit or byte planes, each compressed with zstandard.

A file holds the ids of consecutive documents. Ids are cut into blocks of `block`; a block is
transposed into planes - plane j holds bit j (or byte j) of every id - and each plane that is not
all zero is compressed. Layout, little-endian:

  8 bytes magic, then big-endian: 4 bytes part and 4 bytes number (the file's place in document
  order), 8 bytes number of ids, 4 bytes length of the index; index (JSON); planes one after another

The index holds per document its id and number of ids, and per
block the number of ids and each plane's length (0: all bits zero). Readers can seek to a block by
adding up lengths. A closing line feed ends the file.

Files are made in ascending doc_id order from range partitions, about `per_file` ids each. Null
text is empty (end id only); repeated ids stay next to each other; null ids come first. An empty
table makes no files and reads back as no rows.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import read_files, settle, write_files
from bookloom.llm.tokenizer import encoder

MAGIC = b"BITPLANE"
HEAD = struct.Struct(">IIQI")


def split_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """width planes of a block: bit planes (width bits) or byte planes (width bytes)."""
    if bits:
        table = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1,
                              bitorder="little", count=None)
        return [np.packbits(table[:, j], bitorder="little").tobytes() for j in range(width)]
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(table[:, j]).tobytes() for j in range(width)]


def join_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if bits:
        table = np.zeros((n, 32), np.uint8)
        for j, p in enumerate(planes):
            if p is not None:
                table[:, j] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out = np.packbits(table, axis=1, bitorder="little")
    else:
        for j, p in enumerate(planes):
            if p is not None:
                out[:, j] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out).view("<u4").ravel()


def encode_file(part: int, number: int, docs: list[tuple[int | None, bytes]], block: int,
                bits: bool, level: int = 3) -> bytes:
    ids = np.frombuffer(b"".join(i for _, i in docs), "<u4")
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    width = width if bits else -(-width // 8)
    press, blocks, data = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block):
        part_ids = ids[at:at + block]
        planes = [press.compress(p) if p.strip(b"\0") else b""
                  for p in split_planes(part_ids, width, bits)]
        blocks.append([len(part_ids), [len(p) for p in planes]])
        data += planes
    index = json.dumps({"bits": bits, "blocks": blocks,
                        "docs": [[d, len(i) // 4] for d, i in docs]}).encode()
    return b"".join([MAGIC, HEAD.pack(part, number, len(ids), len(index)), index, *data])


def decode_index(content: bytes) -> tuple[dict, int]:
    """The index, and where the planes begin."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of planes")
    part, number, _, n = HEAD.unpack_from(content, 8)
    at = 8 + HEAD.size
    return json.loads(content[at:at + n]) | {"part": part, "number": number}, at + n


def decode_file(content: bytes) -> tuple[dict, np.ndarray]:
    index, at = decode_index(content)
    press, parts = zstandard.ZstdDecompressor(), []
    for n, lengths in index["blocks"]:
        planes: list[bytes | None] = []
        for m in lengths:
            planes.append(press.decompress(content[at:at + m]) if m else None)
            at += m
        parts.append(join_planes(planes, n, index["bits"]))
    return index, np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_planes(docs: DataFrame, folder: str, path: str, end_id: int, block: int = 65_536,
                 per_file: int = 4_000_000, bits: bool = False, batch: int = 256) -> None:
    """Writes the ids of docs (doc_id, text), each document closed by end_id, to a new folder."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, part = encoder(path), array("I", [end_id]).tobytes(), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = number = 0

        def file() -> pa.RecordBatch:
            return pa.record_batch([pa.array([encode_file(part, number, held, block, bits)],
                                             pa.binary())], ["content"])

        for b in batches:
            for at in range(0, b.num_rows, batch):
                rows = b.slice(at, batch)
                for doc, ids in zip(rows.column(0).to_pylist(), e.ids(rows.column(1).to_pylist())):
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= per_file:
                        yield file()
                        held, size, number = [], 0, number + 1
        if held:
            yield file()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_files(ordered.mapInArrow(encode, "content binary"), folder, per_file=1)


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of each document."""
    def open_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                index, ids = decode_file(content)
                raw, at, rows = ids.tobytes(), 0, []
                for doc, n in index["docs"]:
                    rows.append((index["part"], index["number"], doc, at, n, raw[4 * at:4 * (at + n)]))
                    at += n
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["part", "number", "doc_id", "at", "n_tokens", "ids"])

    def field(at: int, size: int, kind: str) -> Column:
        return F.conv(F.hex(F.substring("content", at + 1, size)), 16, 10).cast(kind)

    files = read_files(spark, folder).select("content")
    totals = settle(files.select(field(8, 4, "int").alias("part"), field(12, 4, "int").alias("number"),
                                 field(16, 8, "long").alias("n")), "plane_sizes")
    # a row per file; running sums within a part, over the sums of the parts before it
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = Window.partitionBy("part").orderBy("number")
    starts = totals.join(before, "part").select(
        "part", "number", (F.col("base") + F.sum("n").over(own) - F.col("n")).alias("base"))
    rows = files.mapInArrow(open_file, "part int, number int, doc_id long, at long, n_tokens long, "
                                       "ids binary")
    return rows.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
