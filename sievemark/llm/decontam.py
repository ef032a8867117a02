"""Passages of benchmark items in documents: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import WORDS_HELD, Words, pieces, small_batches

SEED_WORDS = 3
THRESHOLD = 0.5
#: Of so many n-grams of an item in a row, one at least is a seed.
WINDOW = 4
#: Scores of an equal word, another word, and a word that only one side has.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
_BITS = 22


class Items(NamedTuple):
    """Benchmark items: ids, their words' hashes (item i: bounds[i] to bounds[i + 1]); and seeds, sorted, each with its
    item and place; filled marks the leading bits of all seeds, sizes are their numbers of words."""

    ids: list[int | None]
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    needed: np.ndarray
    filled: np.ndarray
    sizes: list[int]


class Leak(NamedTuple):
    row: int
    item_id: int | None
    score: float
    first_word: int
    last_word: int


class Grams(NamedTuple):
    """n-grams of items: hash, place of the first word, item, and number of words (n; all of an item of fewer)."""

    hashes: np.ndarray
    at: np.ndarray
    item: np.ndarray
    size: np.ndarray


def _grams(words: Words, hashes: np.ndarray, n: int) -> Grams:
    grams, at = words.grams(n, hashes)
    item = words.of[at] if len(at) else np.zeros(0, np.int64)
    return Grams(grams, at, item, np.minimum(n, np.diff(words.bounds))[item])


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _BITS)).astype(np.int64)


def item_counts(texts: list[str | None], n: int = SEED_WORDS) -> np.ndarray:
    """In how many items each n-gram is, by the leading bits of its hash: counts of blocks add up, and never fall short."""
    words = Words(pa.array(texts, pa.string()))
    grams = _grams(words, words.hashes(), n)
    pairs = np.unique(np.stack([grams.hashes, grams.item.astype(np.uint64)]), axis=1) if len(grams.item) else np.zeros((2, 0), np.uint64)
    return np.bincount(_cell(pairs[0]), minlength=1 << _BITS).astype(np.int32)


def prepare(ids: list[int | None], texts: list[str | None], n: int = SEED_WORDS, counts: np.ndarray | None = None, items: int | None = None) -> Items:
    """Seeds are n-grams within at most the larger of 3 and a hundredth of all items, and of every WINDOW n-grams in a row
    of an item the rarest, whatever its count; an item with fewer than four of the first kind keeps all of its n-grams. So
    every stretch of n + WINDOW - 1 words of an item has a seed. An item of fewer than n words is its own seed. counts
    (item_counts) and items are those of the whole benchmark, where these items are a block of it."""
    words = Words(pa.array(texts, pa.string()))
    hashes = words.hashes()
    grams, at, item, size = _grams(words, hashes, n)
    counts, items = item_counts(texts, n) if counts is None else counts, len(ids) if items is None else items
    count = counts[_cell(grams)]
    rare = count <= max(3, items // 100)
    few = np.bincount(item[rare], minlength=len(ids)) < 4
    keep = rare | few[item]
    if len(grams) >= WINDOW:
        # Windows within one item; ties go to the smaller hash, so that items choose alike in a context they share.
        order = np.empty(len(grams), np.int64)
        order[np.lexsort((grams, count))] = np.arange(len(grams))
        view = np.lib.stride_tricks.sliding_window_view(order, WINDOW)
        inside = item[: len(view)] == item[WINDOW - 1 :]
        keep[(np.arange(len(view)) + view.argmin(axis=1))[inside]] = True
    grams, at, item, size = grams[keep], at[keep], item[keep], size[keep]
    order = np.argsort(grams, kind="stable")
    grams, at, item, size = grams[order], at[order], item[order], size[order]
    filled = np.zeros(1 << _BITS, bool)
    filled[_cell(grams)] = True
    needed = np.minimum(2, np.bincount(item, minlength=len(ids)))
    return Items(list(ids), hashes, words.bounds, grams, item, at - words.bounds[item], needed, filled, np.unique(size).tolist())


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment of all words of the item with a part of the text: its score, and the text's last word in it."""
    if not len(text):
        return 0.0, -1
    ramp = -GAP * np.arange(len(text))
    row, best, end = np.zeros(len(text)), 0.0, -1
    for word in item:
        here = np.where(text == word, MATCH, MISMATCH)
        here[1:] += row[:-1]
        row = np.maximum(np.maximum(here, row + GAP), 0)
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def find_leaks(texts: pa.Array, items: Items, threshold: float = THRESHOLD, n: int = SEED_WORDS) -> list[Leak]:
    """For each text (by its number) and item whose best alignment reaches the threshold times the item's words: the
    score as a share of these, and the first and last word of the text in it. Ties go to the earlier place."""
    words = Words(texts)
    hashes = words.hashes()
    parts = [words.grams(k, hashes) for k in items.sizes]
    parts = [(x[some], y[some]) for x, y in parts for some in [np.flatnonzero(items.filled[_cell(x)])]]
    grams, at = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    low, high = np.searchsorted(items.seeds, grams, "left"), np.searchsorted(items.seeds, grams, "right")
    count = high - low
    place = np.repeat(at, count)
    seed = np.repeat(low, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    if not len(seed):
        return []
    item, row, inside = items.seed_item[seed], words.of[place], items.seed_at[seed]
    order = np.lexsort((inside, place, item, row))
    item, row, inside, place = item[order], row[order], inside[order], place[order]
    sizes = np.diff(items.bounds)
    # A new window begins with another text or item, or after more words than the item has.
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(place) > sizes[item[1:]])) + 1
    best: dict[tuple[int, int], Leak] = {}
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
        i, r = int(item[a]), int(row[a])
        if len(np.unique(inside[a:b])) < items.needed[i]:
            continue
        size, own = int(sizes[i]), items.words[items.bounds[i] : items.bounds[i + 1]]
        first = max(int(words.bounds[r]), int(place[a]) - int(inside[a:b].max()) - size // 4)
        last = min(int(words.bounds[r + 1]), int(place[b - 1]) + size - int(inside[a:b].min()) + size // 4)
        text = hashes[first:last]
        # No alignment scores more than the item's words that the text has at all.
        if np.isin(own, text).sum() * MATCH < threshold * size:
            continue
        score, end = align(own, text)
        if score >= threshold * size and score / size > best.get((r, i), Leak(0, 0, 0.0, 0, 0)).score:
            _, back = align(own[::-1], text[: end + 1][::-1])
            start = first - int(words.bounds[r])
            best[r, i] = Leak(r, items.ids[i], score / size, start + end - back, start + end)
    return [best[k] for k in sorted(best)]


def item_blocks(benchmark: DataFrame, most_words: int = 1_000_000) -> Iterator[Items]:
    """The benchmark in blocks of about most_words words at most (a single longer item is a block's only excess): what
    is broadcast is one block, so its size is bounded."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = rows.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    blocks = int(size // most_words) + 1

    def block(k: int) -> list[Row]:
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        return sorted(own, key=lambda x: (x.item_id is None, x.item_id, x.text))

    # Counts and the number of items are those of the whole benchmark, so that seeds don't depend on the blocks.
    counts, items, own = np.zeros(1 << _BITS, np.int32), 0, []
    for k in range(blocks):
        own = block(k)
        counts, items = counts + item_counts([x.text for x in own]), items + len(own)
    for k in range(blocks):
        own = own if blocks == 1 else block(k)
        if own:
            yield prepare([x.item_id for x in own], [x.text for x in own], counts=counts, items=items)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: a row for every row of doc_id, text and item whose alignment
    reaches the threshold. Null and empty texts match nothing; repeated rows give repeated results. The benchmark is a
    set of queries against all documents, block by block."""
    spark = docs.sparkSession
    small_batches(spark)
    shape = "doc_id long, item_id long, score double, first_word long, last_word long"
    names = ["doc_id", "item_id", "score", "first_word", "last_word"]
    found = []
    for block in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in (x for whole in batches for x in pieces(whole, "text", WORDS_HELD)):
                out = find_leaks(batch.column(1), held.value, threshold)
                if out:
                    row, *rest = (list(x) for x in zip(*out, strict=True))
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=names)

        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, shape))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], shape)


def _clean(held: Broadcast, threshold: float):
    """A column function: whether no item of the block is found in a text."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        array = pa.array([None if x is None or x != x else x for x in texts], pa.string())
        batch, out, at = pa.RecordBatch.from_arrays([array], names=["text"]), np.ones(len(array), bool), 0
        for part in pieces(batch, "text", WORDS_HELD):
            for leak in find_leaks(part.column(0), held.value, threshold):
                out[at + leak.row] = False
            at += part.num_rows
        return pd.Series(out)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item is found."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in item_blocks(benchmark):
        docs = docs.where(_clean(spark.sparkContext.broadcast(block), threshold)(F.col("text")))
    return docs
