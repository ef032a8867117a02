"""Class-based bigram scores of texts, with word classes found by exchange clustering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, pieces, small_batches, written

#: The token that ends a text; no word can be it.
END = "\n"
_OPEN = 8  # classes of the words that training has not seen, by their length in bytes


def _open_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(sizes - 1, 0) // 2, _OPEN - 1)


def _open_class_sql(word: Column) -> Column:
    return F.least(F.floor(F.greatest(F.octet_length(word) - 1, F.lit(0)) / 2), F.lit(_OPEN - 1)).cast("int")


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


def tokens(texts: list[str | None]) -> list[list[bytes]]:
    """Words between ASCII white space, with A-Z lower-cased, and the end, of each text (null: empty)."""
    return [[*(x or "").encode().lower().split(), b"\n"] for x in texts]


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n, h (a 64-bit hash) of all tokens of the texts, counted in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = pa.array(list(seen), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64()), pa.array(map(_hash, seen), pa.int64())], names=["word", "n", "h"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for own in tokens(batch.column(0).to_pylist()):
                seen.update(own)
            if len(seen) > 200_000:
                yield flush()
                seen = Counter()
        if seen:
            yield flush()

    counted = texts.select("text").mapInArrow(count, "word string, n long, h long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("h").alias("h"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most `most` words reach with their counts."""
    levels = counts.agg(*[F.count_if(F.col("n") >= (1 << k)).alias(f"k{k}") for k in range(48)]).first()
    return next((1 << k for k in range(48) if levels[k] <= most), 1 << 48)


def _ids(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    """Pieces of batches with a column text, and their tokens: as words, as numbers (-1 if not known), and how many each text has."""
    for batch in (x for whole in batches for x in pieces(whole, "text")):
        own = tokens(batch.column("text").to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        words = list(chain.from_iterable(own))
        yield batch, words, np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)), sizes


def _before(kinds: np.ndarray, end: int) -> np.ndarray:
    """Of each token, what the token before it is; a text begins after an end, and ends with one."""
    return np.concatenate([[end], kinds[:-1]]) if len(kinds) else kinds


def _rows(names: list[str], *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in cols], names=names)


def pair_table(texts: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """How often each known word follows each; the last row and column are those of all other words. Summed in tasks."""
    held, size = texts.sparkSession.sparkContext.broadcast(known), len(known) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, end = np.zeros(size * size, np.int64), held.value[b"\n"]
        for _, _, ids, _ in _ids(batches, held.value):
            ids[ids < 0] = size - 1
            cells += np.bincount(_before(ids, end) * size + ids, minlength=size * size)
        at = np.flatnonzero(cells)
        yield from _rows(["cell", "n"], at, cells[at])

    rows = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["cell"]] = rows["n"]
    return out.reshape(size, size)


def _counted(met: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of codes: what each different one is divided by `cells`, the rest, and how often it is there."""
    codes, n = np.unique(np.concatenate(met), return_counts=True)
    return codes // cells, codes % cells, n


def common_contexts(texts: DataFrame, known: dict[bytes, int], of: np.ndarray, size: int, most: int = 4_000_000) -> DataFrame:
    """w, d, n: how often a word of class d (of[number]; size - 1 for unknown words) goes before the known word w, and, as
    size + d, follows it. Tasks count about `most` tokens at a time before they shuffle."""
    held = texts.sparkSession.sparkContext.broadcast((known, np.append(of, size - 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kinds = held.value
        met, here = [], 0
        for _, _, ids, _ in _ids(batches, words):
            kind = kinds[ids]
            before, there = _before(kind, kinds[words[b"\n"]]), ids >= 0
            follows = there.copy()
            follows[-1:] = False
            follows &= ids != words[b"\n"]  # what follows an end is another text
            met += [(ids * (2 * size) + before)[there], (ids * (2 * size) + size + np.append(kind[1:], 0))[follows]]
            here += len(ids)
            if here > most:
                yield from _rows(["w", "d", "n"], *_counted(met, 2 * size))
                met, here = [], 0
        if met:
            yield from _rows(["w", "d", "n"], *_counted(met, 2 * size))

    return texts.select("text").mapInArrow(count, "w long, d long, n long").groupBy("w", "d").agg(F.sum("n").alias("n"))


def rare_contexts(texts: DataFrame, known: dict[bytes, int], of: np.ndarray, rare: int, most: int = 4_000_000) -> DataFrame:
    """h, d, n: how often a word of class d (of[number]; `rare` for unknown words) goes before the unknown word with hash h;
    and, where h is null, n for d = before * (rare + 1) + class of the known words. Counted in tasks, not yet summed."""
    held = texts.sparkSession.sparkContext.broadcast((known, np.append(of, rare)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kinds = held.value
        names: dict[bytes, int] = {}
        met, here, cells = [], 0, np.zeros((rare + 1) ** 2, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.fromiter(map(_hash, names), np.int64, len(names))
            w, d, n = _counted(met, rare + 1)
            yield from _rows(["h", "d", "n"], hashes[w], d, n)

        for _, own, ids, _ in _ids(batches, words):
            kind = kinds[ids]
            before = _before(kind, kinds[words[b"\n"]])
            there, gone = np.flatnonzero(ids >= 0), np.flatnonzero(ids < 0)
            cells += np.bincount(before[there] * (rare + 1) + kind[there], minlength=len(cells))
            number = np.fromiter((names.setdefault(own[i], len(names)) for i in gone.tolist()), np.int64, len(gone))
            met.append(number * (rare + 1) + before[gone])
            here += len(ids)
            if here > most:
                yield from flush()
                names, met, here = {}, [], 0
        if met:
            yield from flush()
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at), pa.array(cells[at])], names=["h", "d", "n"])

    return written(texts.select("text").mapInArrow(count, "h long, d long, n long"), "contexts")


def place_logs(table: np.ndarray, classes: int, both: bool, prior: float = 1.0) -> np.ndarray:
    """What each context (a class before; if both are asked for, then a class after) adds to the log-likelihood of a word in
    each of the first classes, from how often each class (column) follows each (row)."""

    def side(cells: np.ndarray) -> np.ndarray:  # contexts by classes
        share = cells.sum(axis=1) + 1
        share = prior * share / share.sum()
        return np.log(cells[:, :classes] + share[:, None]) - np.log(cells[:, :classes].sum(axis=0) + prior)

    return np.concatenate([side(table), side(table.T)]) if both else side(table)


def placed(contexts: DataFrame, word: str, logs: np.ndarray) -> DataFrame:
    """word, k, n, and contexts d, m (arrays) of each word of contexts (word, d, n; each d once): the class that its contexts
    suit best; ties go to the lowest. n is the sum of counts."""
    held = contexts.sparkSession.sparkContext.broadcast(logs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            d, n = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            dense = np.zeros((batch.num_rows, len(held.value)))
            dense[row, d] = n
            best = (dense @ held.value).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(dense.sum(axis=1).astype(np.int64)), lists, batch.column(2)], names=[word, "k", "n", "d", "m"])

    lists = contexts.groupBy(word).agg(F.collect_list(F.struct("d", "n")).alias("x")).select(word, "x.d", "x.n")
    return lists.mapInArrow(place, f"{word} long, k long, n long, d array<long>, m array<long>")


def exchange(pairs: np.ndarray, free: int, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each item: the first `free` items, most frequent first, move between `classes` classes while that makes
    the classes' bigrams likelier; every other item keeps a class of its own. Ties go to the lowest class."""
    items = len(pairs)
    fixed = items - free
    of = np.concatenate([np.arange(free) % max(classes, 1), classes + np.arange(fixed)]).astype(np.int64)
    k = classes + fixed
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    member = np.zeros((items, k))
    member[np.arange(items), of] = 1
    table = member.T @ pairs @ member
    after, before = pairs @ member, pairs.T @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(free):
            own, old = pairs[w, w], of[w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (f(table + right) - f(table)).sum(axis=1) + (f(table.T + left) - f(table.T)).sum(axis=1)
            d = np.diag(table)
            gain += f(d + right + left + own) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right.sum() + own) - f(rows) + f(cols + left.sum() + own) - f(cols)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                after[:, old] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, old] -= pairs[w]
                before[:, new] += pairs[w]
        if not moved:
            break
    return of


def transitions(table: np.ndarray, prior: float = 10.0) -> np.ndarray:
    """log10 of the probability of each class (column) after each history (row): counts and a prior in proportion to the classes."""
    single = (table.sum(axis=0) + 1) / (table.sum() + table.shape[1])
    return np.log10((table + prior * single) / (table.sum(axis=1, keepdims=True) + prior))


def with_open(table: np.ndarray, once: np.ndarray) -> np.ndarray:
    """The table with a class for each length of unseen words: as many tokens as words that occur once (Good-Turing),
    spread over the histories as all tokens are."""
    return np.concatenate([table, np.outer(table.sum(axis=1) / max(table.sum(), 1), once)], axis=1)


class Model(NamedTuple):
    """A class bigram model. known: the words at hand by number; n, k: their counts and classes. rare: h, n, k of all other
    words. Classes are numbers below `classes`, then the end's, then those of unseen words by length; as histories, all words
    that aren't at hand are one class, the last. table: tokens of each class (without unseen ones) after each history."""

    known: dict[bytes, int]
    n: np.ndarray
    k: np.ndarray
    rare: DataFrame
    classes: int
    table: np.ndarray
    step: np.ndarray
    mass: np.ndarray
    tokens: int
    types: int


def fit(train: DataFrame, kept: int = 200_000, clustered: int = 512, classes: int = 32) -> Model:
    """Put all words of the texts into classes: `classes`, or the fourth root of the distinct words if that is more.

    The most frequent words (four a class, at least `clustered`) go through an exchange on the counts of their pairs. Then
    each of the at most `kept` most frequent words is put where the exchange's classes before and after all of its tokens
    make it likeliest; then each other word, where the classes before all of its tokens do. All counts are those of
    all texts; they are made in tasks, and what the driver holds is bounded by `kept` words and squares of classes."""
    counts = written(word_counts(train), "word-counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = least_count(counts, kept)
    rows = counts.where((F.col("n") >= least) & (F.col("word") != END)).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    known = {x.encode(): i for i, x in enumerate(rows["word"])}
    known[b"\n"] = end = len(known)
    ends = counts.where(F.col("word") == END).select("n").first()
    n = np.append(rows["n"].to_numpy(np.int64), ends.n if ends else 0)
    classes = max(classes, int(np.ceil(types**0.25)))
    free = min(end, max(clustered, 4 * classes))
    classes = min(classes, max(1, free))
    seeds = {x: i for x, i in known.items() if i < free} | {b"\n": free}
    pairs = pair_table(train, seeds)
    start = exchange(pairs, free, classes)  # the end is class `classes`, all other words are the next
    member = np.zeros((free + 2, classes + 2))
    member[np.arange(free + 2), start] = 1
    of = np.full(end + 1, classes + 1)
    of[:free], of[end] = start[:free], classes
    logs = place_logs(member.T @ pairs @ member, classes, both=True)
    own = placed(common_contexts(train, known, of, classes + 2), "w", logs).select("w", "k").toPandas()
    k = np.zeros(end + 1, np.int64)
    k[own["w"]] = own["k"]
    k[end] = classes
    rare = classes + 1
    met = rare_contexts(train, known, k, rare)
    table, cells = np.zeros((rare + 1, rare)), met.where("h is null").groupBy("d").agg(F.sum("n").alias("n")).toPandas()
    table[cells["d"] // (rare + 1), cells["d"] % (rare + 1)] = cells["n"]
    # Dealt by word alone, so that both sums come from one shuffle; no such word is frequent.
    others = met.where("h is not null").repartition("h").groupBy("h", "d").agg(F.sum("n").alias("n"))
    words = written(placed(others, "h", place_logs(table, classes, both=False)), "rare-words")
    cells = words.select("k", F.explode(F.arrays_zip("d", "m")).alias("x")).groupBy("k", "x.d").agg(F.sum("x.m").alias("n")).toPandas()
    np.add.at(table, (cells["d"].to_numpy(np.int64), cells["k"].to_numpy(np.int64)), cells["n"].to_numpy(np.float64))
    once = np.zeros(_OPEN)
    for row in counts.where("n = 1").groupBy(_open_class_sql(F.col("word")).alias("k")).count().collect():
        once[row.k] = row["count"]
    mass = np.concatenate([np.bincount(k, n + 1.0, rare), once]) + 1
    for row in words.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[row.k] += row.n + row.v
    return Model(known, n, k, words.select("h", "n", "k"), classes, table, transitions(with_open(table, once)), np.log10(mass), total, types)


def score_texts(docs: DataFrame, kept: int = 200_000, clustered: int = 512, classes: int = 32) -> DataFrame:
    """Per row of doc_id, text (null: empty): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id counts as an empty text); see fit. A
    token's probability is that of its class after the class of the word before, times its count plus one over its
    class's tokens, types and one. Words that aren't at hand are one class as histories, and have the classes of fit
    as tokens, joined by a 64-bit hash; words that only other rows have are in classes by length (see with_open).
    Repeated rows give repeated results."""
    spark = docs.sparkSession
    small_batches(spark)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), "text", (crc_mod(name, 7) == 2).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")), kept, clustered, classes)
    held = spark.sparkContext.broadcast(model._replace(rare=None, table=None))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        logs, kinds = np.append(np.log10(m.n + 1.0), 0.0), np.append(m.k, m.classes + 1)
        for batch, words, ids, sizes in _ids(batches, m.known):
            at, kind = np.cumsum(sizes) - sizes, kinds[ids]
            before, there = _before(kind, m.classes), ids >= 0
            local = np.where(there, m.step[before, kind] - m.mass[kind], 0.0)
            # What isn't at hand goes on with its hash, and what is before it.
            rare = np.flatnonzero(~there)
            hashes = {x: _hash(x) for x in {words[i] for i in rare.tolist()}}
            lengths = np.fromiter((len(words[i]) for i in rare.tolist()), np.int64, len(rare))
            doc_of = pa.array(np.repeat(np.arange(len(sizes)), sizes)[rare])
            none = lambda x: pa.nulls(len(sizes), x)  # noqa: B023, E731
            cols = [none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array(sizes), pa.array(np.add.reduceat((there & (logs[ids] > 0)).astype(np.int64), at)), pa.array(np.add.reduceat(logs[ids], at)), pa.array(np.add.reduceat(local, at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), *cols], names=names)
            for first in range(0, len(rare), 50_000):
                some = slice(first, first + 50_000)
                doc = doc_of[some]
                cols = [pa.array([hashes[words[i]] for i in rare[some].tolist()], pa.int64()), pa.array(before[rare[some]]), pa.array(m.classes + 1 + _open_class(lengths[some]))]
                cols += [pa.nulls(len(doc), x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.bool_()), *cols], names=names)

    names = ["row", "doc_id", "held_out", "h", "before", "open", "n_tokens", "n_known", "logs", "local"]
    shape = "row long, doc_id long, held_out boolean, h long, before long, open long, n_tokens long, n_known long, logs double, local double"
    parts = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out").mapInArrow(score, shape), "parts")
    cells = [(i, j, float(x) - float(model.mass[j])) for i, line in enumerate(model.step) for j, x in enumerate(line)]
    cells = F.broadcast(spark.createDataFrame(cells, "before long, k long, step double"))
    rare = parts.where("h is not null").select("row", "h", "before", "open").join(model.rare, "h", "left").withColumn("k", F.coalesce("k", "open")).join(cells, ["before", "k"])
    rare = rare.select("row", F.col("n").isNotNull().cast("long").alias("n_known"), F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)).alias("logs"), "step")
    rare = rare.groupBy("row").agg(F.sum("n_known").alias("more"), F.sum("logs").alias("more_logs"), F.sum("step").alias("more_local"))
    rows = parts.where("h is null").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.types + 1)))).alias("base_score"),
        (logs + F.col("local") + F.coalesce("more_local", F.lit(0.0))).alias("score"),
    )
