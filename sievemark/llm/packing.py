"""Best-fit packing of documents into sequences, with lower bounds that certify how few they are."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORDS_HELD, pieces, small_batches, written
from .tokens import default_tokenizer, encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024) -> DataFrame:
    """Token ids of every whole text (null: empty) and the end id, cut where they are more than capacity: the first
    piece takes what is left over, the others are full. One row per piece; repeated rows give repeated pieces."""
    small_batches(docs.sparkSession)
    name = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "text", WORDS_HELD)):
            ids, bounds = encoder(name).encode(batch.column(1))
            sizes = np.diff(bounds)
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            # A document's pieces end where whole ones are left behind them.
            to = sizes[doc] - (count[doc] - 1 - piece) * capacity
            start = np.maximum(to - capacity, 0)
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (bounds[doc] + start)).tolist(), (4 * (bounds[doc] + to)).tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(to - start), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: longest first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, at, count = capacity, count, count + 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, count


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest of the sums of dual feasible functions, rounded up. The families: items
    over capacity - t count whole and those under t nothing, for every t up to half; and rounding to multiples of 1/k."""
    if not len(lengths):
        return 0
    sizes = np.arange(capacity + 1)
    n = np.bincount(lengths, minlength=capacity + 1)
    mass, above = np.cumsum(n * sizes), np.cumsum(n[::-1])[::-1]
    t = np.arange(0, capacity // 2 + 1)
    whole = np.concatenate([above, [0]])[capacity - t + 1]
    some = mass[capacity - t] - np.where(t > 0, mass[t - 1], 0)
    best = int((whole + -(-some // capacity)).max())
    for k in range(1, 41):
        scaled = (k + 1) * sizes
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def pack(parts: DataFrame, capacity: int = 1024, group: int = 20_000, rounds: int = 3, pooled: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (1 to capacity long).

    Full pieces are sequences. The others are dealt by a hash to groups of about `group`, each packed best-fit
    decreasing and held against its lower bound. Groups with a gap hand the pieces of their sequences that are not full
    to pools of about `pooled` groups, which are packed anew and taken where that saves a sequence; up to `rounds` times."""
    parts = written(parts, "pieces")
    rest = parts.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    shape = _PIECES + ", part long, bin long, offset long, fill long, gap long"

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        return rows.assign(bin=bins, offset=offsets, fill=np.bincount(bins, lengths, count).astype(np.int64)[bins], gap=count - bin_bound(lengths, capacity))

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before = len(rows[["part", "bin"]].drop_duplicates())
        lengths = rows["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        rows = rows.drop(columns=["pool"])
        if count >= before:
            return rows.assign(gap=before - bin_bound(lengths, capacity))
        part = int(key[0])
        return rows.assign(part=part, bin=bins, offset=offsets, fill=np.bincount(bins, lengths, count).astype(np.int64)[bins], gap=count - bin_bound(lengths, capacity))

    # By their places in the table, so that repeated pieces, too, are dealt to all groups, and none has over 2 ** 20.
    dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    now = written(dealt.groupBy("part").applyInPandas(first, shape), "packed")
    done = []
    for k in range(1, rounds + 1):
        gapped = (F.col("gap") > 0) & (F.col("fill") < capacity)
        left = now.where(gapped).select("part").distinct().count()
        if left < 2:
            break
        pools = max(1, left // pooled)
        done.append(now.where(~gapped))
        pool = F.pmod(F.xxhash64("part", F.lit(k)), F.lit(pools)) + (k << 40)
        now = written(now.where(gapped).withColumn("pool", pool).groupBy("pool").applyInPandas(again, shape), "repacked")
    for x in done:
        now = now.unionByName(x)
    packed = now.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
    alone = parts.where(F.col("length") == capacity)
    return packed.unionByName(alone.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
