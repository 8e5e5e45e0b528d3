"""Legacy archives to WARC: ARC records of version 1 and 2, read by their declared lengths.

An ARC file opens with a version block whose record line starts with `filedesc://`; its body
gives the version and the fields of all later record lines. Version 1 lines hold URL, address,
date, type and length; version 2 lines put result code, checksum, location, offset and file name
before the length. A record's bytes are as many as its line declares, whatever they contain.

Each record becomes a WARC 1.1 record: an identifier derived from what the record is (so redone
tasks give the same), the timestamp as an ISO date, the block's type, and the SHA-1 digest of the
payload in base32. Of records with equal payloads of at least `least` bytes, the one with the
smallest page id is a response, the others are revisits that carry only the HTTP head and refer to
it. Files are written by Spark to shared storage, one gzip stream each; WARC records are followed
by two line ends, as the format asks.

Null html is an empty payload. Null or odd urls are percent-escaped or become `urn:page`. Pages
without an id come last among equals, and their revisits and copies are still told apart by row.
Repeated rows: one is the response, the others revisit it. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import read_files, write_files

#: Fields of record lines, by version. Fixed values of the format.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
             "Filename Archive-length"}
DATE = "20240102030405"
END = "\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 bookloom\n{FIELDS[version]}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(body)}",
            2: f"filedesc://{name} 0.0.0.0 {DATE} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return line.encode() + b"\n" + body


def url_field(url: str | None) -> str:
    """The url without white space or control characters, which would end the field."""
    if not url:
        return "urn:page"
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes) -> bytes:
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n"
            f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode()
    n, u = len(head) + len(payload), url_field(url)
    line = {1: f"{u} 192.0.2.1 {DATE} text/html {n}",
            2: f"{u} 192.0.2.1 {DATE} text/html 200 {digest(payload)} - 0 - {n}"}[version]
    return line.encode() + b"\n" + head + payload


@dataclass
class ArcRecord:
    url: str
    address: str
    date: str
    head: bytes
    payload: bytes


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block of an ARC file."""
    at, version = 0, 0
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        n = int(fields[-1])
        block = data[end + 1:end + 1 + n]
        if len(block) < n:
            raise ValueError(f"record at {at} declares {n} bytes, {len(block)} are left")
        at = end + 1 + n
        if not version:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with a version block")
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        if len(fields) < len(FIELDS[version].split()):
            raise ValueError(f"{len(fields)} fields in a line of version {version}")
        head, _, payload = block.partition(END.encode())
        yield ArcRecord(fields[0], fields[1], fields[2], head + END.encode(), payload)


def iso_date(stamp: str) -> str:
    """yyyymmddhhmmss, or a shorter form of it, as an ISO time."""
    s = (stamp + "00000101000000"[len(stamp):])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:]}Z"


def header(head: bytes, name: str) -> str:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else ""


def warc_record(kind: str, record_id: str, refers_to: str | None, r: dict) -> bytes:
    """The record without the two line ends that follow it."""
    block = r["head"] + (r["payload"] if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>",
             f"WARC-Date: {iso_date(r['date'])}", f"WARC-Target-URI: {r['url']}",
             f"WARC-IP-Address: {r['address']}", f"WARC-Payload-Digest: sha1:{r['digest']}",
             f"WARC-Block-Digest: sha1:{digest(block)}",
             "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{refers_to}>", f"X-Refers-To-Page: {r['page_of']}",
                  f"X-Payload-Length: {len(r['payload'])}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END.encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        heads = dict(x.split(": ", 1) for x in lines)
        at = end + 4
        n = int(heads["Content-Length"])
        if len(data) < at + n + 4 or data[at + n:at + n + 4] != END.encode():
            raise ValueError(f"a record of {n} bytes does not end at {at + n}")
        yield heads, data[at:at + n]
        at += n + 4


def _unzip(content: bytes) -> bytes:
    return zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content


def write_arc(pages: DataFrame, folder: str, per_file: int = 2_000) -> None:
    """Writes pages (page_id, url, html) as ARC files; versions 1 and 2 take turns by partition."""
    from pyspark import TaskContext

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        version = 1 + part % 2
        for b in batches:
            out = []
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                if n % per_file == 0:
                    out.append(version_block(version, f"pages-{part}-{n // per_file}.arc"))
                out.append(arc_record(version, url, page, (html or "").encode()))
                n += 1
            yield pa.record_batch([pa.array(out, pa.binary())], ["content"])

    rows = pages.select("page_id", "url", "html").mapInArrow(records, "content binary")
    write_files(rows, folder, compress=True, per_file=per_file + 1)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """record_no (file and place), page_id, url, address, date, head, payload, digest."""
    schema = ("record_no string, page_id long, url string, address string, date string, "
              "head binary, payload binary, digest string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name, rows = path.rsplit("/", 1)[-1], []
                for k, r in enumerate(parse_arc(_unzip(content))):
                    page = header(r.head, "X-Page-Id")
                    rows.append((f"{name}#{k}", int(page) if page else None, r.url, r.address, r.date,
                                 r.head, r.payload, digest(r.payload)))
                if rows:
                    types = (pa.string(), pa.int64(), *(pa.string(),) * 3, pa.binary(), pa.binary(),
                             pa.string())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          [x.split()[0] for x in schema.split(", ")])

    return read_files(spark, folder).mapInArrow(parse, schema)


def write_warc(records: DataFrame, folder: str, least: int = 0, per_file: int = 2_000) -> None:
    """Writes what read_arc gives as WARC files, with revisits for equal payloads."""
    big = records.where(F.length("payload") >= least)
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_no")
    # the response of each payload that occurs more than once; sums come before the shuffle
    firsts = (big.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("digest", F.col("first.record_no").alias("of"),
                                     F.col("first.page_id").alias("page_of")))
    joined = records.join(firsts, "digest", "left")
    names = "record_no", "of", "page_of", "url", "address", "date", "head", "payload", "digest"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def urn(r: dict, no: str, page: int | None) -> str:
            return uuid.uuid5(uuid.NAMESPACE_URL, f"{r['digest']} {page} {no}").urn

        for b in batches:
            out = []
            for r in b.to_pylist():
                page = header(r["head"], "X-Page-Id") or None
                revisit = r["of"] not in (None, r["record_no"]) and len(r["payload"]) >= least
                r["page_of"] = "" if r["page_of"] is None else r["page_of"]
                out.append(warc_record(
                    "revisit" if revisit else "response", urn(r, r["record_no"], page),
                    urn(r, r["of"], r["page_of"] or None) if revisit else None, r))
            yield pa.record_batch([pa.array(out, pa.binary())], ["content"])

    write_files(joined.select(*names).mapInArrow(make, "content binary"), folder, END,
                compress=True, per_file=per_file)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri,
    warc_date, payload (null for revisits) of each record; digests are checked."""
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, record_id string, target_uri string, warc_date string, payload binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for heads, block in parse_warc(_unzip(content)):
                    if heads["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"block of {heads['WARC-Record-ID']} is damaged")
                    head, _, payload = block.partition(END.encode())
                    kind = heads["WARC-Type"]
                    same = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and same != digest(payload):
                        raise ValueError(f"payload of {heads['WARC-Record-ID']} is damaged")
                    page, of = header(head + END.encode(), "X-Page-Id"), heads.get("X-Refers-To-Page")
                    n = int(heads.get("X-Payload-Length", len(payload)))
                    rows.append((int(page) if page else None, n, same, kind,
                                 int(of) if of else None, heads["WARC-Record-ID"],
                                 heads["WARC-Target-URI"], heads["WARC-Date"],
                                 payload if kind == "response" else None))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                             pa.string(), pa.string(), pa.string(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          [x.split()[0] for x in schema.split(", ")])

    return read_files(spark, folder).select("content").mapInArrow(parse, schema)
