"""WARC archives as seekable Zstandard bundles.

Method. Each task writes its rows as WARC records, groups records into frames that are
compressed by themselves, and closes a bundle with a seek table in a skippable frame, as
the public seekable format has it. The manifest maps each record to (bundle, frame,
offset in the frame), so one record costs one seek and one small decompression. Of
records with equal payloads of some size the one with the largest id holds the payload,
the others are revisits that name it.

Defined cases: a null payload is empty; equal payloads meet by SHA-1; rows that share
the largest id and payload are all responses; a null id never becomes the response that
others name, and a group without ids has only responses; line ends in a URL are written
in percent form; repeated rows get a record each; an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import scratch_path
from . import files
from .common import stored, whole

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER, HEAD = "<II", "<IBI", "<II"

LEAST_SHARED = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
MOST_READERS = 10_000
NAME = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, path string, frame int, offset int, size int"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; `refers_to` is the id of the response, if this is a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head.append(f"WARC-Refers-To: <{NAME}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    """Header lines from `start` and where the block after them begins."""
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}, end + 4


def parse(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at `start` and where the next one begins; payloads are verified."""
    head, at = headers(data, start)
    size = int(head["content-length"])
    http, body = headers(data, at)
    payload = data[body : at + size]
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(n) if (n := head[name][len(NAME) + 1 : -1]) else None
    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload and digest differ")
    found = {
        "page_id": number("warc-record-id"),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "record_type": head["warc-type"],
        "refers_to": number("warc-refers-to") if "warc-refers-to" in head else None,
        "url": head.get("warc-target-uri"),
        "payload": payload,
    }
    return found, at + size + 4


def bundle(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames as (compressed, plain size) and their seek table."""
    table = b"".join(struct.pack(ENTRY, len(data), plain) for data, plain in frames)
    footer = table + struct.pack(FOOTER, len(frames), 0, SEEKABLE)
    return b"".join(data for data, _ in frames) + struct.pack(HEAD, SKIPPABLE, len(footer)) + footer


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the end of a bundle."""
    size = files.length(uri)
    count, _, magic = struct.unpack(FOOTER, files.read_part(uri, size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
    if magic != SEEKABLE:
        raise ValueError(f"{uri} has no seek table")
    table = files.read_part(uri, size - struct.calcsize(FOOTER) - count * struct.calcsize(ENTRY), count * struct.calcsize(ENTRY))
    out, at = [], 0
    for packed, plain in struct.iter_unpack(ENTRY, table):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(uri: str, frame: tuple[int, int, int]) -> bytes:
    start, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(files.read_part(uri, start, packed), max_output_size=plain)


def read_record(uri: str, frame: int, offset: int) -> dict:
    """One record by its place in the manifest."""
    return parse(read_frame(uri, seek_table(uri)[frame]), offset)[0]


def shared_payloads(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(digest, first): payloads of at least `least` bytes that several rows have."""
    long = pages.where(F.octet_length("__payload") >= least)
    found = long.groupBy("__digest").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("n"))
    return stored(found.where("n > 1").drop("n"), "payloads")


def write(pages: DataFrame, folder: str, least: int = LEAST_SHARED) -> DataFrame:
    """Write the pages as bundles below a folder; returns the stored manifest."""
    payload = whole("html").cast("binary")
    read = pages.select("page_id", "url", payload.alias("__payload"), F.sha1(payload).alias("__digest"))
    named = read.join(shared_payloads(read, least), "__digest", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))
    rows = named.select("page_id", "url", "__payload", "__digest", first.alias("__refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        number, frames, open_, places, packed = 0, [], bytearray(), [], 0

        def close_frame() -> None:
            nonlocal open_, packed
            if open_:
                data = packer.compress(bytes(open_))
                frames.append((data, len(open_)))
                packed += len(data)
                open_ = bytearray()

        def close_bundle() -> pa.RecordBatch:
            nonlocal number, frames, places, packed
            close_frame()
            name = f"pages-{TaskContext.get().partitionId():06d}-{number:04d}.warc.zst"
            path = files.write(folder, name, bundle(frames))
            ids, frame, offset, size = zip(*places)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([path] * len(ids)), pa.array(frame, pa.int32()), pa.array(offset, pa.int32()), pa.array(size, pa.int32())],
                ["page_id", "path", "frame", "offset", "size"],
            )
            number, frames, places, packed = number + 1, [], [], 0
            return out

        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in range(5))):
                data = record(*values)
                places.append((values[0], len(frames), len(open_), len(data)))
                open_ += data
                if len(open_) >= FRAME_BYTES:
                    close_frame()
                if packed >= BUNDLE_BYTES:
                    yield close_bundle()
        if places:
            yield close_bundle()

    return stored(rows.mapInArrow(run, RECORDS), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read every bundle of a manifest back, frame by frame, one row for each record."""
    paths = manifest.select("path").distinct()
    paths = paths.repartition(max(1, min(paths.count(), MOST_READERS)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for frame in seek_table(uri):
                    data, at, found = read_frame(uri, frame), 0, []
                    while at < len(data):
                        one, at = parse(data, at)
                        found.append(one)
                    yield pa.RecordBatch.from_pylist(found, schema=kind)

    kind = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return paths.mapInArrow(run, schema)


def op3(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
    CASE WHEN n >= {LEAST_SHARED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {LEAST_SHARED} AND page_id <> first THEN first END AS refers_to FROM m
"""
