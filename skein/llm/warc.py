"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle is a row of frames with
the seek table of the Zstandard seekable format as a skippable last frame, so a reader finds any
frame from the end of the bundle. The index maps a record identifier to (bundle, frame, offset in
the frame, length). Bundles are rows of a binary column: Spark writes and reads them, so they live in
any file system and a lost task is simply written again.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id is a
``response``; the others are ``revisit`` records that hold its identifier, the payload's digest and
length, but not the payload. Smaller payloads are all responses.

Defined results: a null html is an empty payload; a null page_id has a record with an empty
identifier, and is never the response that others refer to unless no page of its group has an
identifier (then each is a response); repeated rows with the smallest page_id are each a response;
line breaks and other control characters of a url are percent-encoded; an empty table gives no
bundle; columns other than the three are ignored.
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

from .common import materialise

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3

# Fixed values of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

BUNDLE_SCHEMA = "bundle string, archive binary, records array<struct<record_id:string,frame:int,offset:int,length:int>>"
RECORD_SCHEMA = "page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string, payload binary"


def record(page_id: str, url: str, payload: bytes, n_bytes: int, sha1_hex: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    data = bytes(data) if isinstance(data, memoryview) else data
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut short")
    return head, data[start:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: (compressed, decompressed) sizes of its frames."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames(archive: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, read from the footer."""
    count, descriptor, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if descriptor & 0x80 else 8
    table = archive[-9 - count * width : -9]
    out, at = [], 0
    for i in range(count):
        c, d = struct.unpack_from("<II", table, i * width)
        out.append((at, c, d))
        at += c
    return out


def read_frame(archive: bytes, frame: int, table: list[tuple[int, int, int]] | None = None) -> bytes:
    at, c, d = (table or frames(archive))[frame]
    return zstandard.ZstdDecompressor().decompress(archive[at : at + c], max_output_size=max(1, d))


def mark(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n_bytes, sha1, refers_to): which record each page becomes."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    # Partial sums make the group of a payload small before the shuffle, however often it repeats.
    first = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    out = rows.join(first, "sha1", "left")
    revisit = (F.col("n_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "sha1", F.when(revisit, F.col("first")).alias("refers_to"))


def write(marked: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(bundle, archive, records): bundles of about ``bundle_bytes``, each with its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        part, count = TaskContext.get().partitionId(), 0
        open_frame, n_open, packed, sizes, index, total = [], 0, [], [], [], 0

        def close_frame() -> None:
            nonlocal n_open
            if open_frame:
                packed.append(squeeze.compress(b"".join(open_frame)))
                sizes.append((len(packed[-1]), n_open))
                open_frame.clear()
                n_open = 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal total, count
            close_frame()
            archive = b"".join(packed) + seek_table(sizes)
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
            out = pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}"]), pa.array([archive], pa.binary()), pa.array([index], kind)], names=["bundle", "archive", "records"])
            packed.clear(), sizes.clear(), index.clear()
            total, count = 0, count + 1
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, n, sha1, refers = (batch.column(k)[i].as_py() for k in range(6))
                data = record(page or "", url, payload or b"", n, sha1, refers, date)
                index.append({"record_id": f"{ID_PREFIX}{page or ''}", "frame": len(packed), "offset": n_open, "length": len(data)})
                open_frame.append(data)
                n_open, total = n_open + len(data), total + len(data)
                if n_open >= frame_bytes:
                    close_frame()
                if total >= bundle_bytes:
                    yield close_bundle()
        if index:
            yield close_bundle()

    plain = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    return marked.select(F.col("page_id").cast("string"), plain.alias("url"), "payload", "n_bytes", "sha1", F.col("refers_to").cast("string")).mapInArrow(run, BUNDLE_SCHEMA)


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where each record starts."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    bare = lambda name: head[name][1:-1].removeprefix(ID_PREFIX) or None if name in head else None
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    return bare("WARC-Record-ID"), n, digest, kind, bare("WARC-Refers-To"), head["WARC-Target-URI"], payload if with_payload and kind == "response" else None


def _rows(batches_of: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    held, weight = [], 0
    for row in batches_of:
        held.append(row)
        weight += len(row[6] or b"")
        if len(held) >= size or weight > BUNDLE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _at(archive: bytes, spots: list[dict], with_payload: bool) -> Iterator[tuple]:
    """The records at places of the index, frame by frame; each must be the one that the index names, of its length."""
    table, current, data = frames(archive), -1, b""
    for s in sorted(spots, key=lambda s: (s["frame"], s["offset"])):
        if s["frame"] != current:
            current, data = s["frame"], read_frame(archive, s["frame"], table)
        head, block, end = parse(data, s["offset"])
        if head["WARC-Record-ID"] != f"<{s['record_id']}>" or end - s["offset"] != s["length"]:
            raise ValueError(f"the index is wrong about {s['record_id']}")
        yield _row(head, block, with_payload)


def read(bundles: DataFrame, key_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """Every record of the bundles by its place in the index, each payload checked against its digest; revisits have
    no payload. Of each bundle the records of the index must fill the frames to the last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for value, held in zip(batch.column(0), batch.column(1), strict=True):
                    archive, spots = value.as_py(), held.as_py()
                    if sum(s["length"] for s in spots) != sum(d for _, _, d in frames(archive)):
                        raise ValueError("the index does not hold every record")
                    yield from _at(archive, spots, with_payload)

        yield from _rows(each())

    rows = bundles.select("archive", "records").mapInArrow(run, RECORD_SCHEMA.format(kind="string"))
    return rows.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def fetch(bundles: DataFrame, ids: DataFrame, key_type: str = "bigint") -> DataFrame:
    """The records of ``ids`` (column page_id). Of the bundles that hold them only their frames are unpacked; a bundle
    is a cell of the table and is read whole."""
    wanted = ids.select(F.concat(F.lit(ID_PREFIX), F.col("page_id").cast("string")).alias("record_id")).distinct()
    places = index(bundles).join(wanted, "record_id", "left_semi").groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for value, at in zip(batch.column(0), batch.column(1), strict=True):
                    yield from _at(value.as_py(), at.as_py(), True)

        yield from _rows(each())

    rows = bundles.join(places, "bundle").select("archive", "at").mapInArrow(run, RECORD_SCHEMA.format(kind="string"))
    return rows.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page into bundles in the shared folder, then read all records back, without payloads."""
    kind = pages.schema["page_id"].dataType.simpleString()
    bundles = materialise(write(mark(pages, min_bytes)), "warc")
    return read(bundles, kind, with_payload=False).drop("payload")
