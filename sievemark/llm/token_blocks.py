"""Token ids in binary files of patched frame-of-reference blocks.

A file: magic, blocks, then the block index (where each block starts), the documents (validity, ids, lengths) and a
footer. A block holds 256 ids (the last one fewer): their minimum, then every difference from it at a width that a
percentile of the differences fits into; wider ones (outliers) are zero there and listed with their place."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, pieces, small_batches, written
from .tokens import default_tokenizer, encoder

MAGIC = b"PFB1"
BLOCK = 256
_HEAD = struct.Struct("<IBBH")  # minimum, width, exceptions (256 is written as 0 with width 0), values
_FOOT = struct.Struct("<QQQQI4s")  # documents, ids, blocks, start of the index, crc32 of all before the footer, magic


def encode_blocks(ids: np.ndarray, percentile: float = 90.0) -> tuple[bytes, np.ndarray]:
    """Blocks of the ids, and where each starts."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint64)
    count = -(-n // BLOCK)
    rows = np.full(count * BLOCK, ids[-1], dtype=np.uint32)
    rows[:n] = ids
    rows = rows.reshape(count, BLOCK)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    usual = np.partition(rows, at, axis=1)[:, at]
    width = np.ceil(np.log2(usual.astype(np.float64) + 1)).astype(np.int64)
    over = rows >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    outliers = over.sum(axis=1)
    body: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        for some in np.array_split(np.flatnonzero(width == w), -(-int((width == w).sum()) // 1024)):
            kept = np.where(over[some], 0, rows[some]).astype("<u4")
            bits = np.unpackbits(kept.view(np.uint8).reshape(len(some), BLOCK, 4), axis=2, bitorder="little", count=w) if w else np.zeros((len(some), 0), np.uint8)
            packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            for i, line in zip(some.tolist(), packed, strict=True):
                body[i] = line.tobytes()
    out = []
    sizes = np.full(count, BLOCK)
    sizes[-1] = n - BLOCK * (count - 1)
    for i, (m, w, k, size) in enumerate(zip(low.tolist(), width.tolist(), outliers.tolist(), sizes.tolist(), strict=True)):
        block = _HEAD.pack(m, w, k, size) + body[i]
        if k:
            place = np.flatnonzero(over[i])
            block += place.astype(np.uint8).tobytes() + rows[i][place].astype("<u4").tobytes()
        out.append(block)
    starts = np.zeros(count, np.uint64)
    starts[1:] = np.cumsum([len(x) for x in out[:-1]])
    return b"".join(out), starts


def decode_blocks(data: memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    head = raw[starts[:, None] + np.arange(_HEAD.size)]
    low = head[:, :4].copy().view("<u4")[:, 0]
    width, outliers = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    sizes = head[:, 6:8].copy().view("<u2")[:, 0]
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        for some in np.array_split(np.flatnonzero(width == w), -(-int((width == w).sum()) // 1024)):
            packed = raw[(starts[some] + _HEAD.size)[:, None] + np.arange(BLOCK // 8 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            wide = np.zeros((len(some), BLOCK, 16 if w <= 16 else 32), np.uint8)
            wide[:, :, :w] = bits
            rows[some] = np.packbits(wide.reshape(len(some), -1), axis=1, bitorder="little").view("<u2" if w <= 16 else "<u4")
    for i in np.flatnonzero(outliers).tolist():
        k, at = int(outliers[i]), int(starts[i] + _HEAD.size + BLOCK // 8 * width[i])
        rows[i, raw[at : at + k]] = np.frombuffer(data, "<u4", k, at + k)
    rows += low[:, None]
    return rows.reshape(-1)[(np.arange(BLOCK) < sizes[:, None]).reshape(-1)]


class BlockFile:
    """Writes a file to an open stream; of the ids, only those of blocks that aren't whole yet are held."""

    def __init__(self, out: BinaryIO, percentile: float = 90.0, step: int = 1 << 20):
        self.out, self.percentile, self.step = out, percentile, step
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.starts: list[np.ndarray] = []
        self.held: list[bytes] = []
        self.size = self.crc = self.n_held = self.n_ids = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= self.step:
            self._encode(self.n_held // BLOCK * BLOCK)

    def _encode(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        blocks, starts = encode_blocks(ids[:n], self.percentile)
        self.starts.append(starts + np.uint64(self.size))
        self._write(blocks)
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._encode(self.n_held)
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.uint64)
        index = self.size
        there = np.array([x is not None for x in self.doc_ids], np.uint8)
        self._write(starts.astype("<u8").tobytes() + there.tobytes() + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.out.write(_FOOT.pack(len(self.doc_ids), self.n_ids, len(starts), index, self.crc, MAGIC))


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a file; ValueError if it is damaged."""
    docs, n, blocks, index, crc, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    if magic != MAGIC or data[:4] != MAGIC or zlib.crc32(memoryview(data)[: -_FOOT.size]) != crc:
        raise ValueError("not a whole file of token blocks")
    starts = np.frombuffer(data, "<u8", blocks, index)
    at = index + 8 * blocks
    there = np.frombuffer(data, np.uint8, docs, at)
    names = np.frombuffer(data, "<i8", docs, at + docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    ids = decode_blocks(memoryview(data), starts)
    if len(ids) != n or lengths.sum() != n:
        raise ValueError("a file of token blocks with other counts than its footer")
    return [x if ok else None for x, ok in zip(names.tolist(), there.tolist(), strict=True)], lengths, ids


def write_token_files(docs: DataFrame, tokenizer: str | None = None, percentile: float = 90.0, file_ids: int = 16_000_000) -> DataFrame:
    """Write the ids of every whole text (null: empty), each with the end id, in ascending doc_id order (nulls first;
    equal doc_ids in any order); one row per file: part, seq (their order is that of the files), path, n_docs, n_ids.

    A file has file_ids ids or little more. Attempts of a task write files of their own, and the returned table, which
    is itself written, names those of the attempts that counted."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, name = new_path(spark, "token-files"), tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, seq, stream, file, path = TaskContext.get().partitionId(), 0, None, None, ""
        kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

        def closed() -> pa.RecordBatch:
            file.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(file.doc_ids), "n_ids": file.n_ids}], schema=kinds)

        for batch in (x for whole in batches for x in pieces(whole, "text")):
            ids, bounds = encoder(name).encode(batch.column(1))
            raw, bounds = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * bounds).tolist()
            for doc_id, first, last in zip(batch.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                if file is None:
                    path = f"{base}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.pfb"
                    stream = store.open_output_stream(path)
                    file = BlockFile(stream, percentile)
                file.add(doc_id, raw[first:last])
                if file.n_ids >= file_ids:
                    yield closed()
                    seq, file = seq + 1, None
        if file is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = written(rows.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    return files.withColumn("folder", F.lit(folder))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (unsigned)."""
    # One row per file, so this window stays small.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "path", "folder", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(row["path"]) as f:
                    doc_ids, lengths, ids = read_file(f.read())
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # As many partitions as files: so small rows would be merged into few tasks otherwise.
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
