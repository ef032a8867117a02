"""Near copies of vectors: collisions in windows of many one-dimensional projections, then cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small_batches, written

COSINE = 0.98
_PROJECTIONS = 16
_WINDOW_SD = 3.0  # of what a pair at the threshold differs by in one projection
_CELL_SD = 8.0  # width of a bucket's cells, in the same
_CHUNK = 1 << 20  # pairs that are looked at at once


@lru_cache(maxsize=512)
def directions(size: int, count: int = _PROJECTIONS, seed: int = 3) -> np.ndarray:
    """Orthonormal directions, as columns; at most `count`."""
    return np.ascontiguousarray(np.linalg.qr(np.random.default_rng(seed + size).normal(size=(size, size)))[0][:, :count])


def spread(size: int, cosine: float) -> float:
    """Standard deviation of a projection of the difference of two unit vectors of that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine) / size)


def reach(size: int, cosine: float, sd: float) -> float:
    """So many deviations, and never more than the difference's length, which no projection exceeds."""
    return min(sd * spread(size, cosine), math.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9


def needed_collisions(size: int, cosine: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with that probability: each of its projections collides
    with the normal probability of the window."""
    m, p = min(size, _PROJECTIONS), math.erf(_WINDOW_SD / math.sqrt(2))
    tail = 0.0
    for k in range(m + 1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail > 1 - recall:
            return k
    return m


def bucket_plan(most: int, size: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections of a bucket, and tables of buckets: so many projections that few of `most` unrelated vectors share a
    bucket with another one, and so many tables that a pair at the threshold is in one bucket of some table with that probability. A cell is
    _CELL_SD deviations wide, so such a pair is in one cell with the probability 1 - E|d| / width."""
    p = 1 - math.sqrt(2 / math.pi) / _CELL_SD
    width = _CELL_SD * spread(size, cosine) * math.sqrt(size)  # in deviations of a unit vector's projection
    apart = min(0.9, width / (2 * math.sqrt(math.pi)) or 0.9)
    depth = max(1, min(size, math.ceil(math.log(20 * max(2, most)) / -math.log(apart))))
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**depth)))


def buckets_of(units: np.ndarray, depth: int, tables: int, cosine: float) -> np.ndarray:
    """Each unit vector's bucket in each table, as a hash: the cells of `depth` projections of the table's own, where the
    cells begin at an offset of the table's own."""
    size, width = units.shape[1], _CELL_SD * spread(units.shape[1], cosine) or 1.0
    out = np.empty((len(units), tables), np.int32)
    for t in range(tables):
        offsets, mixed = np.random.default_rng((t, size)).random(depth), np.full(len(units), t + 1, np.uint64)
        cells = np.floor(units @ directions(size, depth, 1000 * (t + 1)) / width + offsets[: min(depth, size)]).astype(np.int64)
        for column in cells.T:
            mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out[:, t] = (mixed >> np.uint64(16)).astype(np.uint32).view(np.int32)
    return out


def sorted_collisions(axis: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of one projection's values, and for each value in that order the bounds of the window around it."""
    order = np.argsort(axis, kind="stable")
    held = axis[order]
    return order, np.searchsorted(held, held - width), np.searchsorted(held, held + width, "right")


def near_pairs(units: np.ndarray, places: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float, enough: int) -> np.ndarray:
    """Which of the pairs x, y (rows of units) have the cosine. places holds, for each projection, two rows: the vectors'
    ranks in its order, and the ranks that the window around each ends before. A pair collides where the later one's rank
    is within the earlier one's window; pairs with enough collisions are verified in double precision."""
    left, count, projections = np.arange(len(x)), np.zeros(len(x), np.int16), len(places)
    for k in range(projections):
        rank, last = places[k]
        a, b = rank[x[left]], rank[y[left]]
        count[left] += np.maximum(a, b) < np.where(a < b, last[x[left]], last[y[left]])
        left = left[count[left] >= enough - (projections - 1 - k)]  # others can't get there any more
    out = np.zeros(len(x), bool)
    out[left] = np.einsum("ij,ij->i", units[x[left]], units[y[left]]) >= cosine
    return out


def _pairs(groups: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each group (left, right; the same array for pairs within), about _CHUNK at a time."""
    held, size = [], 0
    for left, right in groups:
        step = max(1, _CHUNK // max(1, len(right)))
        for at in range(0, len(left), step):
            own = np.arange(at, min(len(left), at + step))
            x, y = np.repeat(own, len(right)), np.tile(np.arange(len(right)), len(own))
            if left is right:
                x, y = x[x < y], y[x < y]
            held.append((left[x], right[y]))
            size += len(x)
            if size >= _CHUNK:
                yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def _verify(rows: pd.DataFrame, cosine: float, recall: float) -> pd.DataFrame:
    """Links of a task's buckets, each whole or one pair i, j of its blocks: a, a, links (rows that class a links with) and
    a, b, 0 (a spanning forest). A pair counts in the first table only in which it shares a bucket."""
    out = [pd.DataFrame({"a": [], "b": [], "links": []}, dtype=np.int64)]
    for size, same in rows.groupby(rows["unit"].str.len() // 8, sort=False):
        ids, first, of = np.unique(same["id"].to_numpy(np.int64), return_index=True, return_inverse=True)
        units = np.frombuffer(b"".join(same["unit"].iloc[first]), np.float64).reshape(len(ids), -1)
        buckets = np.frombuffer(b"".join(same["buckets"].iloc[first]), np.int32).reshape(len(ids), -1)
        weight, block, table = same["n"].to_numpy(np.int64)[first], same["block"].to_numpy(), same["table"].to_numpy()
        enough, width, places = needed_collisions(size, cosine, recall), reach(size, cosine, _WINDOW_SD), []
        for axis in (units @ directions(size)).T:
            order, _, last = sorted_collisions(axis, width)
            rank, ends = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            rank[order], ends[order] = np.arange(len(order)), last
            places.append((rank, ends))
        by_table: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (t, _, _, i, j), own in same.groupby(["table", "label", "bucket", "i", "j"], sort=False).indices.items():
            whole = of[own]
            by_table.setdefault(t, []).append((whole, whole) if i == j else (of[own[block[own] == i]], of[own[block[own] == j]]))
        count, root, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for t, groups in by_table.items():
            for x, y in _pairs(groups):
                left = np.arange(len(x))
                for k in range(t):
                    left = left[buckets[x[left], k] != buckets[y[left], k]]
                x, y = x[left], y[left]
                close = near_pairs(units, places, x, y, cosine, enough)
                x, y = x[close], y[close]
                count += np.bincount(x, weight[y], len(ids)).astype(np.int64) + np.bincount(y, weight[x], len(ids)).astype(np.int64)
                new = root[x] != root[y]
                for a, b in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    if root[a] != root[b]:
                        edges.append((ids[a], ids[b]))
                        root[root == root[b]] = root[a]
        some, ends = np.flatnonzero(count), np.array(edges, np.int64).reshape(-1, 2)
        a, b = np.concatenate([ids[some], ends[:, 0]]), np.concatenate([ids[some], ends[:, 1]])
        out.append(pd.DataFrame({"a": a, "b": b, "links": np.concatenate([count[some], np.zeros(len(ends), np.int64)])}))
    return pd.concat(out, ignore_index=True)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = 0.9999999, block: int = 2048, pool: int = 4096) -> DataFrame:
    """Per row of vec_id, embedding, label: vec_id, n_links (other rows of the same label with at least that cosine, in
    double precision), component_id (the smallest vec_id reachable by links), kept (vec_id is component_id).

    A null label or vector, and one that is all zero or has a null or non-finite component, links with nothing; vectors of
    different lengths don't link. Equal vectors are one class before anything is paired; repeated rows count as rows; a null vec_id is
    never a class's or component's name unless it has no other.

    Pairs are looked for in the buckets of several tables, each the cells of a few projections (see bucket_plan: projections
    grow with the logarithm of the largest label, tables with a small power of it). Buckets of one class are gone before
    vectors are shuffled; the others are dealt to tasks of about `pool` vectors, and one of more than `block` to blocks, each
    pair of which is one task's work. There, every projection of a set of their own is sorted, collisions of a pair in windows
    around the vectors are counted, and pairs with a recall-calibrated count are verified. What leaves a task is a count per
    class and a spanning forest, not the pairs."""
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), e.alias("e"), good.alias("good"))
    classes = rows.where("good").groupBy("label", "e").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    classes = written(classes.withColumn("id", F.xxhash64("label", "e")), "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                units = np.array(own.column(1).flatten(), np.float64).reshape(-1, size)
                units /= np.abs(units).max(axis=1, keepdims=True)
                units /= np.sqrt(np.einsum("ij,ij->i", units, units))[:, None]
                found = buckets_of(units, *bucket_plan(most, size, cosine, recall), cosine)
                cols = [own.column(0), own.column(2), own.column(3), pa.array([x.tobytes() for x in units], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(found.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["label", "n", "id", "unit", "buckets", "names"])

    shape = "label string, n long, id long, unit binary, buckets binary, names array<int>"
    placed = written(classes.select("label", "e", "n", "id").mapInArrow(place, shape), "buckets-of-vectors")
    places = placed.select("label", "id", F.length("unit").alias("size"), F.posexplode("names").alias("table", "bucket"))
    keys = ["label", "size", "table", "bucket"]
    shared = written(places.groupBy(keys).agg(F.count("*").alias("members")).where("members > 1"), "shared-buckets")
    total = shared.agg(F.sum("members")).first()[0] or 0
    own = places.join(shared, keys).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    own = own.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    alone = F.pmod(F.xxhash64("label", "size", "table", "bucket"), F.lit(-(-total // pool) + 1))
    task = F.when(F.col("blocks") == 1, alone).otherwise(F.xxhash64("label", "size", "table", "bucket", "i", "j"))
    work = own.withColumn("task", task).join(placed.select("id", "n", "unit", "buckets"), "id")
    work = work.select("task", "label", "table", "bucket", "i", "j", "block", "id", "n", "unit", "buckets")
    found = work.groupBy("task").applyInPandas(lambda x: _verify(x, cosine, recall), "a long, b long, links long")
    found = written(found, "vector-links")
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.where("a <> b").select("a", "b"), "vector-components").withColumnRenamed("node", "id")
    known = classes.join(links, "id", "left").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = written(known, "vector-roots")
    least = written(known.groupBy("root").agg(F.min("class_id").alias("component_id")), "vector-names")
    known = written(known.join(least, "root").select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-known")
    linked = rows.where("good").join(known, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
