"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent frames, each of whole records, and a skippable frame with the seek table: for every
frame its compressed and decompressed size, then their number, a descriptor and a magic number. The index names
for each record its bundle, frame, and place in the decompressed frame, so one frame is all that a read unpacks."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small_batches, written

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names all records' ids, so that equal pages get equal ids.
_NAMES = uuid.UUID("8f0f4a76-6c39-5a0e-9d6f-0d7a3c1b5e21")
_ENTRY, _FOOT = struct.Struct("<II"), struct.Struct("<IBI")

INDEX = "page_id long, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload if refers_to names a page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page-Id": None if refers_to is None else str(refers_to),
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Its fields, and http and payload of the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return {"fields": fields, "http": http.decode(), "payload": payload}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(_ENTRY.pack(*x) for x in sizes) + _FOOT.pack(len(sizes), 0, SEEK_TABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame of an open bundle."""
    end = f.size()
    f.seek(end - _FOOT.size)
    count, _, magic = _FOOT.unpack(f.read(_FOOT.size))
    if magic != SEEK_TABLE_MAGIC:
        raise ValueError("no seek table at the end")
    f.seek(end - _FOOT.size - count * _ENTRY.size)
    out, at = [], 0
    for packed, unpacked in _ENTRY.iter_unpack(f.read(count * _ENTRY.size)):
        out.append((at, packed, unpacked))
        at += packed
    return out


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html (null: empty), refers_to: of pages with equal html of at least so many UTF-8 bytes, the
    largest page_id for all the others; null for that one (and its repeated rows), and for shorter pages."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    pages = pages.withColumn("digest", F.when(F.octet_length(raw) >= least_bytes, F.sha2(raw, 256)))
    # Aggregated before it is shuffled; only digests of several pages are joined, from a plain table, so that a common
    # one's side can be split.
    shared = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(shared, "digests")
    return pages.join(shared, "digest", "left").select("page_id", "url", "html", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write a record for each row of page_id, url, html, refers_to; the index: page_id, bundle, frame, offset, length.

    Frames have frame_bytes or little more, bundles bundle_bytes. Each attempt of a task writes bundles of its own, and
    the index, which is itself written, names those of the attempts that counted."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        out, path, sizes, held, size, index = None, "", [], [], 0, []

        def close_frame() -> None:
            nonlocal held, size
            packed = packer.compress(b"".join(held))
            out.write(packed)
            sizes.append((len(packed), size))
            held, size = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal out, sizes, index
            if held:
                close_frame()
            out.write(seek_table(sizes))
            out.close()
            out, sizes, done, index = None, [], index, []
            return pa.RecordBatch.from_pylist(
                [dict(zip(("page_id", "bundle", "frame", "offset", "length"), x, strict=True)) for x in done],
                schema=pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]),
            )

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(path, compression=None)
                record = warc_record(page_id, url, html.encode(), refers_to, date)
                index.append((page_id, path, len(sizes), size, len(record)))
                held.append(record)
                size += len(record)
                if size >= frame_bytes:
                    close_frame()
                    if sum(x for x, _ in sizes) >= bundle_bytes or len(index) >= 1_000_000:
                        yield close_bundle()
        if out is not None:
            yield close_bundle()

    rows = pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX)
    return written(rows, "warc-index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame, task_bytes: int = 32 << 20) -> DataFrame:
    """The records that the index names, each frame unpacked once: page_id, record_type, refers_to, payload_bytes and
    payload_digest (bare lower-case hex SHA-1) as the record states them, and payload (null in a revisit)."""
    spark = index.sparkSession
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(row["bundle"]) as f:
                    if row["bundle"] not in tables:  # a task reads a bundle's table once, and holds those of a few
                        if len(tables) >= 64:
                            tables.clear()
                        tables[row["bundle"]] = read_seek_table(f)
                    start, packed, unpacked = tables[row["bundle"]][row["frame"]]
                    f.seek(start)
                    frame = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=unpacked)
                out = []
                for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                    record = parse_record(frame[offset : offset + length])
                    fields = record["fields"]
                    http = dict(x.split(": ", 1) for x in record["http"].split("\r\n")[1:])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(http["Content-Length"])
                    if not revisit and (len(record["payload"]), hashlib.sha1(record["payload"]).hexdigest()) != (size, digest):
                        raise ValueError("a payload that is not what its record says")
                    of = lambda k: int(fields[k]) if k in fields else None
                    out.append((of("X-Page-Id"), size, digest, fields["WARC-Type"], of("X-Refers-To-Page-Id"), None if revisit else record["payload"]))
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    # A frame's entries are bounded by its size. The number of tasks goes by the bytes to read, not by the index's.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    frames = index.repartition(tasks, "folder", "bundle", "frame").groupBy("folder", "bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("e"))
    frames = frames.select("folder", "bundle", "frame", F.col("e.offset").alias("offsets"), F.col("e.length").alias("lengths"))
    return frames.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write all pages and read the archives back."""
    return read_records(write_bundles(with_revisits(pages, least_bytes)))
