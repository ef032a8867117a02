"""What several operators use: tables in the shared folder, words of a batch of texts, components of a graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.session import new_path, shared_folder, small_batches, table, written

__all__ = ["WORDS_HELD", "Words", "components", "crc_mod", "mix", "new_path", "pieces", "shared_folder", "small_batches", "spanning", "table", "written"]


#: Bytes of texts whose words are told apart at once: the arrays take some forty times that, and a worker keeps what it once
#: took while stage follows stage.
WORDS_HELD = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most so many bytes together (a single text may have more)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


# Words: runs of [0-9a-z] and of all characters beyond ASCII, after A-Z is lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of an array of texts: data (lower-cased bytes of all texts), first and last (their bytes' bounds),
    of (the text's number), and bounds (text i has words bounds[i] to bounds[i + 1])."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = LOWER[raw[offsets[0] : offsets[-1]]]
        self.offsets = offsets - offsets[0]
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = IN_WORD[self.data]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        starts[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        self.first = np.flatnonzero(starts)
        self.last = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.first, self.offsets)
        self.of = np.repeat(np.arange(n), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = len(self.data)
        powers, inverses = _powers(1 << max(20, (size + 1).bit_length()))
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:size], out=total[1:])
        return mix((total[self.last] - total[self.first]) * inverses[self.first])

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words within a text, and the number of its first word. A text of 1 to n - 1 words
        has one run, of all its words."""
        h = self.hashes() if hashes is None else hashes
        count = np.diff(self.bounds)
        length = np.minimum(n, count)
        runs = np.where(count > 0, count - length + 1, 0)
        text = np.repeat(np.arange(len(count)), runs)
        start = self.bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs))
        out, size = np.full(len(text), 0x51ED270B, dtype=np.uint64), length[text]
        for k in range(n):
            more = size > k
            if more.all():
                out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[start + k])
            else:
                out[more] = mix(out[more] * np.uint64(0x2545F4914F6CDD1D) + h[start[more] + k])
        return out, start


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of a number as text, modulo the divisor."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % divisor


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (a matrix of rows `left` and columns `right`, numbers below size)."""
    label, edges = np.arange(size), []
    for i in np.flatnonzero(links.any(axis=1)).tolist():
        x, linked = int(left[i]), right[links[i]]
        labels, first = np.unique(label[linked], return_index=True)
        for other, at in zip(labels.tolist(), first.tolist(), strict=True):
            if other != label[x]:
                edges.append((x, int(linked[at])))
                label[label == other] = label[x]
    return edges


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node reachable): of every node of the undirected edges a, b (bigint).

    Each round points every node at the first, in a hashed order, of its neighbours' neighbours, follows these
    pointers once more and contracts the graph, which shrinks it by a factor; what a hub receives is combined before
    it is shuffled, and the joins' skewed sides can be split. Every round is written to the shared folder."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m")).select("u", F.least("m", order(F.col("u"))).alias("m"))
        near = written(near, name)  # a join with a plain table can split a hub's side
        far = both.join(near, "u").groupBy("v").agg(F.min("m").alias("m"))
        points = written(far.select(F.col("v").alias("u"), F.least("m", order(F.col("v")))["n"].alias("p")), name)
        again = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jump = written(points.join(again, "p").select(F.col("u").alias("label"), F.col("q").alias("to")), name)
        if labels is None:
            labels = jump.select(F.col("label").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(jump, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        left, right = jump.select(F.col("label").alias("a"), F.col("to").alias("x")), jump.select(F.col("label").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    labels = written(labels, name)
    smallest = written(labels.groupBy("label").agg(F.min("node").alias("root")), name)
    return labels.join(smallest, "label").select("node", "root")
