"""WARC: a converter of legacy ARC archives, with revisit records for repeated payloads.

An ARC file starts with a version block that names the version and its header fields; each record is one header line of
space-separated fields, the last of which is the declared length, then that many bytes and a line feed. Version 1 has five
fields, version 2 ten. The converter follows the declared lengths, never the content, and synthesises from each record a
WARC/1.1 record: a UUID derived from URI, date and payload, an ISO timestamp from the 14-digit date, the type, and SHA-1
digests of payload and block. Members are gzip-compressed one by one, as is customary.

`archive` puts a table of pages through that path: pages become ARC records (versions 1 and 2, by turns), these become
WARC records, which are kept as rows (archive, data) of Parquet so that any store that Spark writes to will do;
`export` puts them into files. Of the records with equal payloads of at least `least` bytes, that with the smallest
page_id is a response, the others are revisits of it.

To find the first of equal payloads, an index of (page_id, size, digest) is aggregated by digest, map side first; only the
revisits' page_ids are joined back to the pages, so payloads are not moved unless Spark finds that side large.

Defined cases: a null html is an empty payload; a null URL becomes urn:page:<page_id>; white space and control characters
in a URL are percent-encoded; rows that repeat the first page_id of a payload are responses all; a row without page_id
revisits the first row with its payload that has one, and is a response if there is none; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

LEAST, ARCHIVE_BYTES, LEVEL = 0, 8 << 20, 3
# The header fields of the two versions, and the profile of revisit records.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


# ARC --------------------------------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def arc_file(name: str, version: int, records: list[ArcRecord]) -> bytes:
    intro = f"{version} 0 larkspur\n{' '.join(FIELDS[version])}\n\n".encode()
    tail = {1: "", 2: f" 200 - - 0 {name}"}[version]
    out = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{tail} {len(intro)}\n".encode(), intro, b"\n"]
    place = sum(map(len, out))
    for r in records:
        middle = {1: "", 2: f" {_status(r.block)} {digest(r.block)} - {place} {name}"}[version]
        parts = [f"{r.url} {r.ip} {r.date} {r.content_type}{middle} {len(r.block)}\n".encode(), r.block, b"\n"]
        out += parts
        place += sum(map(len, parts))
    return b"".join(out)


def _status(block: bytes) -> str:
    return m[1].decode() if (m := re.match(rb"HTTP/\d\.\d (\d{3})", block)) else "-"


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block; ValueError if a header or a length doesn't hold."""
    place, fields = 0, None
    while place < len(raw):
        if raw[place : place + 1] in (b"\n", b"\r"):  # between records
            place += 1
            continue
        end = raw.find(b"\n", place)
        parts = raw[place : end if end >= 0 else len(raw)].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if end < 0 or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at byte {place}")
        block = raw[end + 1 : end + 1 + int(parts[-1])]
        if len(block) < int(parts[-1]):
            raise ValueError(f"the ARC record at byte {place} ends early")
        place = end + 1 + len(block)
        if fields is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with filedesc:")
            fields = FIELDS[int(block.split(b" ", 1)[0])]
            continue
        if len(parts) < len(fields):
            raise ValueError(f"{len(parts)} fields in an ARC header of {len(fields)}")
        spare = len(parts) - len(fields)  # spaces within the URL
        named = dict(zip(fields, [" ".join(parts[: spare + 1]), *parts[spare + 1 :]], strict=True))
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], block)


# WARC -------------------------------------------------------------------------------------------------------------------


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its empty line, payload)."""
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def http_fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if v}


def convert(record: ArcRecord, refers_to: tuple | None = None) -> WarcRecord:
    """The WARC record of an ARC record: a response, a revisit of refers_to (page_id, URI) without its payload, or, where no
    HTTP header stands before it (as in dns: records), a resource."""
    http = record.block.startswith(b"HTTP/")
    head, payload = payload_of(record.block) if http else (b"", record.block)
    own = digest(payload)
    block = record.block if refers_to is None else head
    headers = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if http else "resource",
        "WARC-Record-ID": record_id(record.url, record.date, own),
        "WARC-Date": iso_date(record.date),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha1:{own}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response" if http else record.content_type,
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        page, url = refers_to
        date = page_date(page)
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(url, date, own), "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": iso_date(date), "WARC-Refers-To-Page": str(page)}
    return WarcRecord(headers, block)


def iso_date(date: str) -> str:
    return datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest}')}>"


def warcinfo(name: str, intro: bytes) -> WarcRecord:
    """The record that stands for an ARC file's version block."""
    body = f"software: larkspur\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode() + b"arc-version-block: " + b" ".join(intro.split()) + b"\r\n"
    headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"filedesc://{name}", "", digest(intro)), "WARC-Date": iso_date("20000101"), "WARC-Filename": name, "WARC-Block-Digest": f"sha1:{digest(body)}", "Content-Type": "application/warc-fields", "Content-Length": str(len(body))}
    return WarcRecord(headers, body)


def version_block(raw: bytes) -> bytes:
    """What an ARC file says of itself in its first record."""
    end = raw.find(b"\n")
    return raw[end + 1 : end + 1 + int(raw[:end].rsplit(b" ", 1)[1])]


def member(record: WarcRecord) -> bytes:
    """A gzip member with one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogateescape") + record.block + b"\r\n\r\n") + packer.flush()


def read_warc(raw: bytes) -> Iterator[WarcRecord]:
    """The records of an archive of gzip members."""
    while raw:
        unpacker = zlib.decompressobj(31)
        one, raw = unpacker.decompress(raw), unpacker.unused_data
        end = one.index(b"\r\n\r\n")
        lines = one[:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = one[end + 4 : end + 4 + int(headers["Content-Length"])]
        if len(block) != int(headers["Content-Length"]) or digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
        yield WarcRecord(headers, block)


# Tables -----------------------------------------------------------------------------------------------------------------


def page_date(page_id: int | None) -> str:
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")


def page_record(page_id, url: str | None, html: str | None) -> ArcRecord:
    payload = (html or "").encode()
    address = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-ID: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return ArcRecord(address, "0.0.0.0", page_date(page_id), "text/html", head.encode() + payload)


def _legacy(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(rows' revisits, ARC files) of some MB of pages each."""
    for batch in slices(batches, "html", ARCHIVE_BYTES):
        revisits = batch.column("revisits").to_pylist() if "revisits" in batch.schema.names else [None] * batch.num_rows
        records: dict[int, list] = {1: [], 2: []}
        own: dict[int, list] = {1: [], 2: []}
        for k, (page_id, url, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)):
            version = 1 + (page_id or 0) % 2
            records[version].append(page_record(page_id, url, html))
            own[version].append(dict(revisits[k] or []))
        yield own[1] + own[2], [arc_file(f"pages-v{v}.arc", v, some) for v, some in records.items()]


def _page_id(record: ArcRecord | WarcRecord) -> int | None:
    text = http_fields(payload_of(record.block)[0]).get("x-page-id", "")
    return int(text) if text else None


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, files in _legacy(batches):
        rows = [(_page_id(r), payload_of(r.block)[1], r.url) for raw in files for r in read_arc(raw)]
        columns = [pa.array([p for p, _, _ in rows], pa.int64()), pa.array([len(x) for _, x, _ in rows], pa.int64()), pa.array([digest(x) for _, x, _ in rows], pa.string()), pa.array([u for _, _, u in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "size", "digest", "uri"])


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for revisits, files in _legacy(batches):
        arc = (r for raw in files for r in read_arc(raw))
        out = []
        for record, known in zip(arc, revisits, strict=True):
            page = known.get(digest(payload_of(record.block)[1])) if known else None
            out.append(member(convert(record, None if page is None else (page["first"], page["uri"]))))
        data = b"".join(out)
        yield pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(data).hexdigest()[:16]}.warc.gz"]), pa.array([len(out)], pa.int64()), pa.array([data], pa.binary())], ["archive", "n_records", "data"])


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """archive, n_records, data: WARC archives of pages(page_id, url, html), kept in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    index = materialize(rows.mapInArrow(_index, "page_id long, size long, digest string, uri string"), "warc-index").filter(F.col("size") >= least)
    known = F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("first"), "uri"))
    first = index.groupBy("digest").agg(F.min(known).alias("one"), F.count("*").alias("n")).filter("n > 1 AND one IS NOT NULL").select("digest", "one")
    again = index.join(first, "digest").filter("page_id IS NULL OR page_id > one.first").select("page_id", F.struct("digest", "one").alias("one"))
    again = again.select(F.col("page_id").alias("of"), "one").groupBy("of").agg(F.map_from_entries(F.collect_set("one")).alias("revisits"))
    revisits = materialize(again, "warc-revisits")
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")), "left").select("page_id", "url", "html", "revisits")
    return materialize(marked.mapInArrow(_archives, "archive string, n_records long, data binary"), "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for data in batch.column("data"):
            for record in read_warc(data.as_py()):
                head, payload = payload_of(record.block)
                kind, own = record.headers["WARC-Type"], record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http_fields(head)["content-length"])
                if kind == "response" and (len(payload) != size or digest(payload) != own):
                    raise ValueError(f"{record.headers['WARC-Record-ID']}: the payload is damaged")
                refers = record.headers.get("WARC-Refers-To-Page")
                rows.append((_page_id(record), size, own, kind, None if refers is None else int(refers)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, checked against its digests."""
    return archives.select("data").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert_files(spark: SparkSession, path: str) -> DataFrame:
    """archive, n_records, data: WARC archives of the ARC files under path, one for each, led by a warcinfo record. A file is
    read whole, as Spark's binaryFile does (2 GB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                plain = raw.as_py()
                if plain[:2] == b"\x1f\x8b":
                    whole = []
                    while plain:
                        unpacker = zlib.decompressobj(31)
                        whole.append(unpacker.decompress(plain))
                        plain = unpacker.unused_data
                    plain = b"".join(whole)
                out = [member(warcinfo(os.path.basename(name), version_block(plain))), *(member(convert(r)) for r in read_arc(plain))] if plain else []
                yield pa.RecordBatch.from_arrays([pa.array([f"{os.path.basename(name).removesuffix('.gz').removesuffix('.arc')}.warc.gz"]), pa.array([len(out)], pa.int64()), pa.array([b"".join(out)], pa.binary())], ["archive", "n_records", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, n_records long, data binary")


def export(archives: DataFrame, folder: str) -> int:
    """Writes each archive to a file of a folder that the driver sees, one at a time; returns their number."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in archives.select("archive", "data").toLocalIterator():
        with open(os.path.join(folder, row["archive"]), "wb") as f:
            f.write(row["data"])
        n += 1
    return n


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(archive(table(spark, sf_dir, "pages")))


# DuckDB has SHA-1 as hex only: its digits are regrouped by fives into base 32.
ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, payload_bytes, hex,
                array_to_string(list_transform(string_split(hex, ''), lambda c: right(('000' || bin(instr('0123456789abcdef', c) - 1)), 4)), '') AS b FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + list_sum(list_transform(range(5), lambda j: (substr(b, (5 * k + j + 1)::BIGINT, 1) = '1')::INT * (16 >> j)::INT))::INT, 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(page_id = min(page_id) OVER w, min(page_id) OVER w IS NULL) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)"""
