"""Exact groups and near pairs by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.identity import hamming


def duplicate_groups(rows: DataFrame, key: Column, name: Column, path: Column) -> DataFrame:
    """value, n, classes and paths (joined by |), cross_class_conflict: of each key, not null or empty, of two rows or more."""
    named = rows.select(key.alias("value"), name.cast("string").alias("class"), path.cast("string").alias("path")).where("value <> ''")
    groups = named.groupBy("value").agg(
        F.count("*").alias("n"),
        (F.count_distinct("class") > 1).alias("cross_class_conflict"),
        F.array_join(F.array_sort(F.collect_set("class")), "|").alias("classes"),
        F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"),
    )
    return groups.where("n > 1")


def hamming_pairs(rows: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """left_id, right_id, distance: all pairs, once, of rows of id, hash (bigint), pixels whose hashes differ in at most
    `most` bits and whose pixels differ.

    The bits are cut into most + 1 bands; of such a pair at least one band is equal (there are fewer differences than
    bands), so an equi-join on bands finds it. A pair is kept at the first band that is equal, so none comes twice."""
    bands = most + 1
    cuts = [bits * i // bands for i in range(bands + 1)]
    mask = lambda n: (1 << n) - 1 if n < 64 else -1
    pieces = F.array(*[F.shiftright("hash", a).bitwiseAND(mask(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])
    keyed = rows.select("id", "hash", "pixels", F.posexplode(pieces).alias("band", "piece"))
    left, right = keyed.alias("l"), keyed.alias("r")
    earlier = F.lit(False)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        same = F.shiftright(F.col("l.hash").bitwiseXOR(F.col("r.hash")), a).bitwiseAND(mask(b - a)) == 0
        earlier = earlier | (same & (F.col("l.band") > i))
    found = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.piece") == F.col("r.piece")) & (F.col("l.id") < F.col("r.id")))
    distance = hamming(F.col("l.hash"), F.col("r.hash"))
    found = found.where((distance <= most) & (F.col("l.pixels") != F.col("r.pixels")) & ~earlier)
    return found.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), distance.alias("distance"))


def capped_pairs(pairs: DataFrame, cap: int) -> DataFrame:
    """The first `cap` pairs in the order of their ids, then by distance; truncated says that the cap was reached."""
    first = pairs.orderBy("left_id", "right_id").limit(cap)
    count = first.agg((F.count("*") >= cap).alias("truncated"))
    return first.join(F.broadcast(count)).orderBy("distance", "left_id", "right_id")


def pairs_by_split(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """n of pairs (left_id, right_id) by the two splits, in alphabetical order; splits: id, split."""
    of = lambda side: splits.select(F.col("id").alias(f"{side}_id"), F.col("split").alias(f"{side}_split"))
    both = pairs.join(of("left"), "left_id").join(of("right"), "right_id")
    name = F.array_join(F.array_sort(F.array("left_split", "right_split")), "__")
    return both.groupBy(name.alias("splits")).agg(F.count("*").alias("n"))
