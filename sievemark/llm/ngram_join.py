"""Jaccard join of documents on word n-grams: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORDS_HELD, Words, components, mix, pieces, small_batches, spanning, written

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999


def band_plan(similarity: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """Bands of `rows` values each: as many as find a pair of that similarity with that probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))), rows


def _hashers(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def gram_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of a text of fewer than n words, that of all its words."""
    words = Words(texts)
    grams, at = words.grams(n)
    cuts = np.searchsorted(words.of[at] if len(at) else np.zeros(0, np.int64), np.arange(1, len(texts)))
    return [np.unique(x) for x in np.split(grams, cuts)] if len(texts) else []


def bands_of(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's smallest values over a set of n-grams (not empty)."""
    times, plus = _hashers(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        part = grams[at : at + 1024]
        # The high half of a product depends on all bits of the n-gram's hash.
        low = np.minimum(low, (part[None, :] * times[:, None] + plus[:, None]).min(axis=1))
    out = np.full(bands, 0x1B873593, np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + low.reshape(bands, rows)[:, k])
    return out.view(np.int64)


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _features(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), chars, key (of the set of n-grams; null if it is empty), bands."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "text", WORDS_HELD)):
            keys, signatures = [], []
            for grams in gram_sets(batch.column(3), n):
                keys.append(blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                signatures.append(bands_of(grams, bands, rows) if len(grams) else None)
            own = [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "row", "chars", "key", "bands"])

    slim = docs.select(F.col("doc_id").cast("long"), _row_key().alias("row"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "text")
    return slim.mapInArrow(features, "doc_id long, row long, chars long, key binary, bands array<long>")


def similar(left: list[np.ndarray], right: list[np.ndarray], asked: np.ndarray, similarity: float) -> np.ndarray:
    """Of the pairs that are asked for (a matrix), those of so large a Jaccard similarity. Where many are asked for, the
    sets' shared n-grams are counted as products of 0/1 matrices, a stretch of n-grams at a time."""
    out = np.zeros(asked.shape, bool)
    rows, cols = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    if not len(rows):
        return out
    a, b = np.array([len(left[i]) for i in rows]), np.array([len(right[j]) for j in cols])
    if asked.sum() <= 4 * (len(rows) + len(cols)):
        for i, j in np.argwhere(asked).tolist():
            small, large = sorted((left[i], right[j]), key=len)
            if len(small) >= similarity * len(large) - 1e-9:
                same = np.searchsorted(large, small)
                same = int((large[np.minimum(same, len(large) - 1)] == small).sum())
                out[i, j] = same >= similarity * (len(small) + len(large) - same) - 1e-9
        return out
    xs, ys = np.concatenate([left[i] for i in rows]), np.concatenate([right[j] for j in cols])
    shared = np.intersect1d(xs, ys)
    of_x, of_y = np.repeat(np.arange(len(rows)), a), np.repeat(np.arange(len(cols)), b)

    def placed(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], of[hit][order]

    (px, ox), (py, oy) = placed(xs, of_x), placed(ys, of_y)
    same, step = np.zeros((len(rows), len(cols)), np.float32), 2048
    for first in range(0, len(shared), step):
        mats = []
        for p, o, size in ((px, ox, len(rows)), (py, oy, len(cols))):
            low, high = np.searchsorted(p, first), np.searchsorted(p, first + step)
            m = np.zeros((size, step), np.float32)
            m[o[low:high], p[low:high] - first] = 1
            mats.append(m)
        same += mats[0] @ mats[1].T
    close = same >= similarity * (a[:, None] + b[None, :] - same) - 1e-6
    out[np.ix_(rows, cols)] = close
    return out & asked


def _verify(rows: pd.DataFrame, similarity: float, n: int) -> pd.DataFrame:
    """Links of a task's rows: either some small components, or one pair i, j of blocks of a large one. Gives a, a, links
    (rows of the table that class a links with here) and a, b, 0 (edges of a spanning forest of classes)."""
    array = pa.RecordBatch.from_arrays([pa.array(list(rows["text"]), pa.string())], names=["text"])
    sets = [x for part in pieces(array, "text", WORDS_HELD) for x in gram_sets(part.column(0), n)]
    del array
    bands = np.array(list(rows["bands"]), np.int64)
    weight, ids, block = rows["n"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
    count, edges = np.zeros(len(rows), np.int64), []
    for (_, i, j), own in rows.groupby(["root", "i", "j"], sort=False).indices.items():
        left, right = (own, own) if i == j else (own[block[own] == i], own[block[own] == j])
        asked = np.zeros((len(left), len(right)), bool)
        for k in range(bands.shape[1]):
            asked |= bands[left, k][:, None] == bands[right, k][None, :]
        if i == j:
            asked = np.triu(asked, 1)
        links = similar([sets[x] for x in left], [sets[x] for x in right], asked, similarity)
        np.add.at(count, left, links.astype(np.float64) @ weight[right])
        np.add.at(count, right, links.T.astype(np.float64) @ weight[left])
        edges += [(ids[x], ids[y]) for x, y in spanning(links, left, right, len(rows))]
    some = np.flatnonzero(count)
    ends = np.array(edges, np.int64).reshape(-1, 2)
    a, b = np.concatenate([ids[some], ends[:, 0]]), np.concatenate([ids[some], ends[:, 1]])
    return pd.DataFrame({"a": a, "b": b, "links": np.concatenate([count[some], np.zeros(len(ends), np.int64)])})


def linked(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, block: int = 2048, block_chars: int = 16 << 20) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, class_id, n_links, component_id, kept_row (the row key that stays of its
    component), for every row of docs; see join."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = band_plan(similarity, recall)
    features = written(_features(docs, bands, rows, n), "features")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = features.where("key is not null").groupBy("key").agg(first.alias("first"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.any_value("bands").alias("bands"))
    classes = written(classes.select("key", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("row"), "n", "chars", "bands"), "classes")
    buckets = classes.select("row", F.posexplode("bands").alias("band", "hash"))
    firsts = buckets.groupBy("band", "hash").agg(F.min("row").alias("first"), F.count("*").alias("size")).where("size > 1")
    firsts = written(firsts, "buckets")  # joins with plain tables, as here and below, can split a large bucket's side
    candidates = buckets.join(firsts, ["band", "hash"]).select(F.col("row").alias("a"), F.col("first").alias("b"))
    groups = written(components(candidates, "candidates").withColumnRenamed("node", "row"), "groups")
    members = written(classes.select("row", "n", "chars", "bands").join(groups, "row"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))
    sizes = written(sizes, "sizes")
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("chars") / block_chars), F.lit(1)).cast("int")
    total = members.agg(F.count("*"), F.sum("chars")).first()
    pools = max(1, -(-total[0] // 500), -(-(total[1] or 0) // (4 << 20)))
    pairs = members.drop("chars").join(sizes.select("root", blocks.alias("blocks")), "root")
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root", F.lit(4)), F.lit(pools))).otherwise(F.xxhash64("root", "i", "j"))
    texts = docs.select(_row_key().alias("row"), "text").join(members.select("row"), "row", "left_semi").dropDuplicates(["row"])
    work = pairs.join(texts, "row").select(task.alias("task"), "root", "i", "j", "block", "row", "n", "bands", "text")
    found = written(work.groupBy("task").applyInPandas(lambda rows: _verify(rows, similarity, n), "a long, b long, links long"), "found")
    links = found.where("a = b").groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    joined = components(found.where("a <> b").select("a", "b"), "links").withColumnRenamed("node", "row")
    known = classes.select("key", "class_id", "row", "n").join(links, "row", "left").join(joined, "row", "left").withColumn("root", F.coalesce("root", "row"))
    known = written(known, "components")
    least = written(known.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "row")).alias("kept")), "kept")
    known = known.join(least, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("kept.class_id").alias("component_id"), F.col("kept.row").alias("kept_row"))
    known = written(known, "known")
    with_words = features.where("key is not null").select("row", "doc_id", "key").join(known, "key").drop("key")
    own = features.where("key is null").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.col("row").alias("kept_row"))
    return with_words.unionByName(own)


def join(docs: DataFrame, **options) -> DataFrame:
    """Per row of doc_id, text: doc_id, class_id (the smallest doc_id with the same set of word n-grams), n_links (other
    rows of a Jaccard similarity of at least `similarity`), component_id (the smallest doc_id reachable by links) and kept
    (doc_id is component_id).

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A text of fewer than n words has one
    n-gram, all its words; one without words (or null) links with nothing. Repeated rows count, and are kept, as rows;
    a null doc_id comes after all others.

    Rows of the same set become one class before anything is paired. Bands are hashed and shuffled without texts; a bucket
    joins its members to its smallest one, and the components of that graph are where pairs are looked for. Each class's
    text goes once to the block of its component that a hash names; a large component has several blocks, and each pair of
    blocks is one task's work, so no task holds more than two. A pair is verified once, if it shares a band; what leaves
    a task is a count per class and a spanning forest, not the pairs."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked(docs, **options).select("doc_id", "class_id", "n_links", "component_id", kept.alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, whatever their names, of each component (that of the smallest doc_id, nulls last), and
    every row without words. Rows of equal doc_id and text stay once."""
    kept = linked(docs).where(F.col("row") == F.col("kept_row")).select("row").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), _row_key().alias("row"))
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*[F.col("own")[c].alias(c) for c in docs.columns])
