"""Operator 2: WARC records in ZIP packages, read by byte ranges without extraction.

A package is a ZIP archive with a stored member ``archive/data.warc.gz`` (one gzip member per record) and a stored index
``indexes/index.cdxj`` (offset and length of every record). Reading parses the end record, the ZIP64 records and the
central directory, finds the stored members, reads the index, and then only the ranges of the records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_folder, open_input, open_output, readers, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20  # a package is closed beyond this size
BLOCK_BYTES = 4 << 20  # records that follow one another are read together up to this size

# Fixed values of the ZIP format.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_BIG, _MANY = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header_at: int


def _read(file, at: int, n: int) -> bytes:
    raw = file.read_at(n, at)
    if len(raw) < n:
        raise ValueError(f"archive ends at byte {at + len(raw)}, {n - len(raw)} bytes early")
    return bytes(raw)


def _directory(file) -> tuple[int, int]:
    """Offset and size of the central directory, from the end record or its ZIP64 form."""
    total = file.size()
    tail = min(total, 22 + _MANY)
    raw = _read(file, total - tail, tail)
    at = raw.rfind(_END)
    while at >= 0 and (at + 22 > tail or at + 22 + struct.unpack_from("<H", raw, at + 20)[0] != tail):
        at = raw.rfind(_END, 0, at)  # the mark may occur in the archive's comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    entries, size, offset = struct.unpack_from("<HII", raw, at + 10)
    if _MANY == entries or _BIG in (size, offset):
        end_at = total - tail + at
        if end_at >= 20 and (locator := _read(file, end_at - 20, 20))[:4] == _LOCATOR64:
            record = _read(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ValueError("ZIP64 end record is not where its locator points")
            size, offset = struct.unpack_from("<QQ", record, 40)
    return offset, size


def members(file) -> list[Member]:
    """All entries of the central directory; sizes and offsets of 4 GiB and more come from the ZIP64 field."""
    offset, size = _directory(file)
    raw, at, out = _read(file, offset, size), 0, []
    while at < size:
        if raw[at : at + 4] != _ENTRY:
            raise ValueError(f"broken central directory at byte {offset + at}")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header_at = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))  # only the fields that are too small, in order
                plain = next(wide) if plain == _BIG else plain
                packed = next(wide) if packed == _BIG else packed
                header_at = next(wide) if header_at == _BIG else header_at
            extra = extra[4 + n :]
        out.append(Member(name, method, packed, plain, header_at))
        at += 46 + n_name + n_extra + n_comment
    return out


def stored_range(file, member: Member) -> tuple[int, int]:
    """Where the bytes of a stored member lie in the archive: offset and size."""
    if member.method != zipfile.ZIP_STORED or member.packed != member.size:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    header = _read(file, member.header_at, 30)
    if header[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name} at byte {member.header_at}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + n_name + n_extra, member.size


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        fields += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    plain = "\r\n".join([*fields, "", ""]).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(plain) + pack.flush()


def parse_record(raw: bytes) -> dict:
    """Headers and block of one gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return {"fields": fields, "block": rest[: int(fields["Content-Length"])]}


class _Package:
    """A package being written: records one by one, the index when it is closed."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        self.stream = open_output(self.uri)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str | None, raw: bytes):
        self.data.write(raw)
        entry = {"offset": self.size, "length": len(raw), "record": _record_id(page_id)}
        self.index.append(f"{json.dumps(url or '')} 20240101000000 {json.dumps(entry)}\n")
        self.size += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.index), self.size


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), revisit, refers_to of every row of (page_id, url, html).

    Only digests are grouped; the payloads are dealt once, by page_id and digest, so a payload that a third of all
    pages share stays spread. Rows that share the smallest page_id of their payload are all responses; null page_ids
    come after all others and are responses among themselves if no other page has the payload. Null html is empty.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "sha1")
    digests = stored(large, "page-digests")
    first = digests.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = digests.join(first.hint("merge"), "sha1").where("refers_to IS NOT NULL AND (page_id IS NULL OR page_id > refers_to)")
    later = later.groupBy("page_id", "sha1").agg(F.min("refers_to").alias("refers_to"))
    named = later.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "refers_to")
    joined = rows.join(named.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    return joined.select("page_id", "url", "payload", "sha1", F.col("refers_to").isNotNull().alias("revisit"), "refers_to")


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of ``pages``; return the packages: uri, n_records, bytes.

    Each task writes packages under names of its own; only those of finished attempts are in the returned table.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # few payloads as Python objects at a time
                for row in batch.slice(start, 64).to_pylist():
                    if package and package.size >= package_bytes:
                        done.append(package.close())
                        package = None
                    package = package or _Package(folder)
                    digest = base32(bytes.fromhex(row["sha1"]))
                    package.add(row["page_id"], row["url"], _record(row["page_id"], row["url"], row["payload"], digest, row["revisit"], row["refers_to"]))
        if package:
            done.append(package.close())
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["uri", "n_records", "bytes"])

    return stored(with_revisits(pages, least_bytes).mapInArrow(write, "uri string, n_records long, bytes long"), "packages")


def locate(packages: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of records that follow one another: uri, start (in the package), lengths of the records.

    Only directory and index of a package are read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                with open_input(uri) as file:
                    by_name = {m.name: m for m in members(file)}
                    archive_at, archive_size = stored_range(file, by_name[ARCHIVE])
                    index_at, index_size = stored_range(file, by_name[INDEX])
                    lines = _read(file, index_at, index_size).decode().splitlines() if index_size else []
                blocks: list[list] = []
                for line in lines:
                    # the key is a JSON string without blanks outside of it; the entry is the last JSON object
                    entry = json.loads(line[line.rindex(' {"offset"') :])
                    offset, length = entry["offset"], entry["length"]
                    if offset + length > archive_size:
                        raise ValueError(f"index of {uri} points beyond the archive member")
                    if not blocks or blocks[-1][2] != offset or offset + length - blocks[-1][0] > block_bytes:
                        blocks.append([offset, [], offset])
                    blocks[-1][1].append(length)
                    blocks[-1][2] = offset + length
                if blocks:
                    yield pa.record_batch(
                        [pa.array([uri] * len(blocks)), pa.array([archive_at + b[0] for b in blocks]), pa.array([b[1] for b in blocks], pa.list_(pa.int64()))],
                        names=["uri", "start", "lengths"],
                    )

    size, number = packages.agg(F.sum("bytes"), F.count("*")).first()
    spread = packages.select("uri").repartition(max(1, min(readers(size), number)))
    return spread.mapInArrow(find, "uri string, start long, lengths array<long>")


def read_records(located: DataFrame, payload: bool = True, tasks: int | None = None) -> DataFrame:
    """The records of the given blocks, one range read each, dealt to ``tasks`` (by the blocks' bytes if not given): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null for a revisit).

    A response whose payload does not have the digest of its header raises.
    """

    def number(text: str | None) -> int | None:
        digits = (text or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                with open_input(block["uri"]) as file:
                    raw = _read(file, block["start"], sum(block["lengths"]))
                rows, at = [], 0
                for length in block["lengths"]:
                    record = parse_record(raw[at : at + length])
                    at += length
                    fields = record["fields"]
                    http, _, body = record["block"].partition(b"\r\n\r\n")
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
                    n = int(sent["Content-Length"])
                    if kind == "response" and (len(body) != n or base32(hashlib.sha1(body).digest()) != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
                    rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, digest, kind, number(fields.get("WARC-Refers-To")), body if kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(7 if payload else 6)], names=names[: 7 if payload else 6])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if tasks is None:
        located = stored(located, "blocks")
        tasks = readers(located.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0])
    spread = located.repartition(tasks)
    return spread.mapInArrow(read, schema + ", payload binary" if payload else schema)


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Query: write all pages to packages in the shared folder and read every record back."""
    packages = write_packages(pages, new_folder(spark, "warc"))
    return read_records(locate(packages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


DIGEST_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT p.page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(p.hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (hex)
"""
