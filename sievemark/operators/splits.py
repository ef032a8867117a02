"""Deterministic splits that keep groups, or components of groups, whole."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.identity import stable_order
from sievemark.functions.text import SPLITS

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
# What the hashed orders of the two kinds of split begin with.
GROUP_POLICY = "condition_group_stratified_by_model_sha256_v1"
COMPONENT_POLICY = "phash_condition_component_model_balanced_sha256_v2"


def allocation(n: Column, ratios: Mapping[str, float] = RATIOS) -> dict[str, Column]:
    """Counts of train, val, test that add up to n: shares rounded down, then one more to the largest remainders, then one
    from the largest count to each that is empty. Ties go to the earlier split; n must be 3 at least."""
    exact = [n * F.lit(float(ratios[s])) for s in SPLITS]
    low = [F.floor(x).cast("long") for x in exact]
    rest = [x - y for x, y in zip(exact, low, strict=True)]
    left = n - (low[0] + low[1] + low[2])
    counts = []
    for i in range(3):
        before = sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i)
        counts.append(low[i] + (before < left).cast("int"))

    def repair(state: Column, empty: Column) -> Column:
        need, donor = F.get(state, empty) == 0, F.array_position(state, F.array_max(state)) - 1
        return F.transform(state, lambda x, i: x + F.when(need & (i == empty), 1).when(need & (i == donor), -1).otherwise(0))

    repaired = F.aggregate(F.array(*map(F.lit, range(3))), F.array(*counts), repair)
    return {s: F.get(repaired, i).cast("long") for i, s in enumerate(SPLITS)}


def hash_ranks(groups: DataFrame, seed: int = 42, policy: str = GROUP_POLICY) -> DataFrame:
    """model, group_id and its rank (from 1) in its model's hashed order."""
    order = Window.partitionBy("model").orderBy(stable_order(policy, seed, F.col("model"), F.col("group_id")), "group_id")
    return groups.select("model", "group_id").distinct().withColumn("rank", F.row_number().over(order).cast("long"))


def group_split(rows: DataFrame, seed: int = 42, ratios: Mapping[str, float] = RATIOS) -> DataFrame:
    """model, group_id, rank, split: every model's groups in hashed order, the first to train, the next to val, the last
    to test. rows: model, group_id."""
    ranked = hash_ranks(rows, seed)
    sizes = ranked.groupBy("model").agg(F.count("*").alias("n"))
    counts = sizes.select("model", *[c.alias(f"n_{s}") for s, c in allocation(F.col("n"), ratios).items()])
    split = F.when(F.col("rank") <= F.col("n_train"), "train").when(F.col("rank") <= F.col("n_train") + F.col("n_val"), "val").otherwise("test")
    return ranked.join(counts, "model").select("model", "group_id", "rank", split.alias("split"))


def mixed_groups(rows: DataFrame) -> DataFrame:
    """group_id, n_models of the groups that have several models."""
    return rows.groupBy("group_id").agg(F.count_distinct("model").alias("n_models")).where("n_models > 1")


class _Reach:
    """Which pairs of two sums some of the given sizes can make: a bit for each pair, in rows of one first sum."""

    def __init__(self, first: int, second: int):
        self.width, self.height = second + 1, first + 1
        self.all = (1 << self.width * self.height) - 1
        self.rows = self.all // ((1 << self.width) - 1)
        self.masks: dict[int, int] = {}

    def more(self, reach: int, size: int) -> int:
        """With one component more: the pairs as they are, and shifted by its size in either sum."""
        if size >= self.width:
            right = 0
        else:
            if size not in self.masks:
                self.masks[size] = self.rows * (((1 << self.width) - 1) ^ ((1 << size) - 1))
            right = reach << size & self.masks[size]
        return reach | right | (reach << size * self.width & self.all if size < self.height else 0)

    def below(self, total: int) -> int:
        """All pairs that add up to no more than total."""

        def rows(first: int, last: int) -> int:
            if first > total:
                return 0
            if last - first == 1:
                return (1 << min(self.width, total - first + 1)) - 1
            middle = (first + last) // 2
            return rows(first, middle) | rows(middle, last) << (middle - first) * self.width

        return self.all if total >= self.width + self.height else rows(0, self.height)

    def has(self, reach: int, first: int, second: int) -> bool:
        return first < self.height and second < self.width and bool(reach >> (first * self.width + second) & 1)


def _full(sizes: list[int]) -> list[bool]:
    """For each place, whether the components from there on can be dealt to three parts in all sums that add up to theirs.

    So it is, where before each of them, by size, the smaller ones add up to twice its size less two at least: then it always
    fits one of the parts, as three that are all smaller than it would hold less. What is short of that is watched."""
    out, count, short = [True] * (len(sizes) + 1), {}, {}
    for i in range(len(sizes) - 1, -1, -1):
        size = sizes[i]
        short = {s: low + (size if s > size else 0) for s, low in short.items()}
        if size not in count:
            short[size] = sum(s * n for s, n in count.items() if s < size)
        count[size] = count.get(size, 0) + 1
        short = {s: low for s, low in short.items() if low < 2 * (s - 1)}
        out[i] = not short
    return out


class _Suffixes:
    """Whether the components from a place on can make a val and a test sum exactly, with at most `train` over.

    Only places that aren't full need bits: of the two smallest of the three parts. They are kept at about every square root
    of the components, and made again between."""

    def __init__(self, sizes: list[int], behind: list[int], full: list[bool], train: int, val: int, test: int):
        self.sizes, self.behind, self.full = sizes, behind, full
        self.over = train <= test
        self.reach = _Reach(*((train, val) if self.over else (val, test)))
        self.step, self.kept, self.block = max(1, math.isqrt(len(sizes))), {}, {}

    def ends_at(self, i: int, last: int | None) -> int | None:
        """The bits of a place, of those of the place behind it; None where it is full."""
        if self.full[i]:
            return None
        return self.reach.more(self.reach.below(self.behind[i + 1]) if last is None else last, self.sizes[i])

    def scan(self, first: int):
        """Places from the last one down to `first`, each with its bits."""
        last = None
        for i in range(len(self.sizes), first - 1, -1):
            last = self.ends_at(i, last)
            if i % self.step == 0:
                self.kept[i] = last
            yield i, last

    def holds(self, i: int, bits: int | None, val: int, test: int) -> bool:
        train = self.behind[i] - val - test
        if val < 0 or test < 0 or train < 0:
            return False
        return bits is None or self.reach.has(bits, *((train, val) if self.over else (val, test)))

    def has(self, i: int, val: int, test: int) -> bool:
        """Of a place that scan has passed; places are asked for from the first on."""
        if self.full[i]:
            return self.holds(i, None, val, test)
        if i not in self.block:
            end = min(len(self.sizes), -(-i // self.step) * self.step)
            last, self.block = self.kept.get(end), {}
            for j in range(end, i - 1, -1):
                last = self.kept[j] if j in self.kept else self.ends_at(j, last)
                self.block[j] = last
        return self.holds(i, self.block[i], val, test)


def exact_choice(sizes: list[int], val: int, test: int) -> list[str] | None:
    """A split for each component so that those in val and in test add up exactly; None if there is none.

    Of all such choices the one that is first when train comes before val and val before test, from the first component on:
    the one that a walk over all states, keeping the first way to each, arrives at. What the components behind a place can
    still make tells there which choices stay open. Where they are many and small that is told by their sum (see _full);
    else by the sums that they make, of which one is what is over for train, and small behind the first components: all go
    to train as long as the rest can make val and test. With many large components and no small ones the work is their
    number times val * over / 64."""
    unit = math.gcd(*sizes) or 1
    if val % unit or test % unit:
        return None
    sizes, val, test = [s // unit for s in sizes], val // unit, test // unit
    behind = [*itertools.accumulate(reversed(sizes), initial=0)][::-1]
    full, n = _full(sizes), len(sizes)
    last = next((i for i in range(n, -1, -1) if behind[i] >= val + test), None)
    if last is None:
        return None
    most, start = 4 * max(sizes, default=1), last if full[last] else None
    while start is None:
        # The last place from which val and test can be made: among those with little over, or with ever more.
        first = last
        while first and behind[first - 1] - val - test <= most:
            first -= 1
        found = _Suffixes(sizes, behind, full, behind[first] - val - test, val, test)
        start = next((i for i, bits in found.scan(first) if i <= last and found.holds(i, bits, val, test)), None)
        if start is None and not first:
            return None
        most *= 4
    found = _Suffixes(sizes, behind, full, behind[start] - val - test, val, test)
    for _ in found.scan(start):
        pass
    out = ["train"] * start
    for i in range(start, n):
        if found.has(i + 1, val, test):
            out.append("train")
        elif found.has(i + 1, val - sizes[i], test):
            out.append("val")
            val -= sizes[i]
        else:
            out.append("test")
            test -= sizes[i]
    return out


def _exact(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Splits of one model's components that reach its val and test targets exactly, chosen in hashed order."""
    model, val, test = rows["model"].iloc[0], int(rows["n_val"].iloc[0]), int(rows["n_test"].iloc[0])
    free = rows[~rows["forced"]].copy()
    material = [f"{COMPONENT_POLICY}\0{seed}\0{model}\0{c}" for c in free["component_id"]]
    free["h"] = [hashlib.sha256(x.encode()).hexdigest() for x in material]
    free = free.sort_values(["h", "component_id"])
    chosen = exact_choice(free["size"].tolist(), val, test)
    if chosen is None:
        return pd.DataFrame({"model": [model], "component_id": [None], "split": ["NO_EXACT_SPLIT"]})
    ids = [*rows.loc[rows["forced"], "component_id"], *free["component_id"]]
    return pd.DataFrame({"model": model, "component_id": ids, "split": ["train"] * int(rows["forced"].sum()) + chosen})


def component_split(rows: DataFrame, seed: int = 42, ratios: Mapping[str, float] = RATIOS) -> DataFrame:
    """model, component_id, split. rows: model, group_id, component_id. A component of several models goes to train; the
    others of each model reach its val and test counts of groups exactly, or one row says NO_EXACT_SPLIT. A model's
    components (not their groups) meet in one task, whose work is their number where small ones are among them (see exact_choice)."""
    groups = rows.select("model", "group_id", "component_id").distinct()
    counts = groups.groupBy("model").agg(F.count_distinct("group_id").alias("n"))
    targets = counts.select("model", *[c.alias(f"n_{s}") for s, c in allocation(F.col("n"), ratios).items()])
    spans = groups.groupBy("component_id").agg((F.count_distinct("model") > 1).alias("forced"))
    sizes = groups.groupBy("model", "component_id").agg(F.count("*").alias("size")).join(spans, "component_id").join(targets, "model")
    return sizes.groupBy("model").applyInPandas(lambda x: _exact(x, seed), "model string, component_id string, split string")


def split_overlap(rows: DataFrame) -> DataFrame:
    """left_split, right_split, n: groups that two splits have in common. rows: group_id, split."""
    own = rows.select("group_id", "split").distinct()
    left, right = own.withColumnRenamed("split", "left_split"), own.withColumnRenamed("split", "right_split")
    return left.join(right, "group_id").where("left_split < right_split").groupBy("left_split", "right_split").agg(F.count("*").alias("n"))


def pair_overlaps(rows: DataFrame, stratum: str, columns: list[str]) -> DataFrame:
    """stratum, left, right, and for each column shared_{column}: how many of its values both parts (split) of a pair have."""
    splits_of = rows.select(stratum, "split").distinct()
    pairs = splits_of.select(stratum, F.col("split").alias("left")).join(splits_of.select(stratum, F.col("split").alias("right")), stratum).where("left < right")
    for c in columns:
        held = rows.groupBy(stratum, c).agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
        each = held.select(stratum, F.explode("s").alias("left"), "s").select(stratum, "left", F.explode("s").alias("right")).where("left < right")
        pairs = pairs.join(each.groupBy(stratum, "left", "right").agg(F.count("*").alias(f"shared_{c}")), [stratum, "left", "right"], "left")
    return pairs.fillna(0)


def split_audit(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """model, train, val, test (groups), torn (components in several splits or none), spread (components of several models
    that aren't in train). rows: model, group_id, component_id; assigned: what component_split gave."""
    own = rows.select("model", "group_id", "component_id").distinct().join(assigned, ["model", "component_id"], "left")
    spans = own.groupBy("component_id").agg((F.count_distinct("model") > 1).alias("forced"))
    parts = own.groupBy("model", "component_id").agg(F.count_distinct("split").alias("splits"), F.min("split").alias("split"), F.count("*").alias("n")).join(spans, "component_id")
    size = lambda s: F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s)
    return parts.groupBy("model").agg(*map(size, SPLITS), F.count_if(F.col("splits") != 1).alias("torn"), F.count_if(F.col("forced") & ~F.col("split").eqNullSafe("train")).alias("spread"))
