"""Runs, metrics and tables against each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate_runs(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """model, runs, and {metric}_mean, {metric}_std (of the sample; null for one run), without nulls."""
    columns = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return runs.groupBy("model").agg(F.count("*").alias("runs"), *columns)


def unpivoted(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, value."""
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def paired_deltas(runs: DataFrame, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """metric, paired_n, mean_delta, sample_sd_delta, degrees_of_freedom of first minus second over the same seeds."""
    long = unpivoted(runs, ["model", "seed"], metrics)
    a = long.where(F.col("model") == first).select("seed", "metric", F.col("value").alias("a"))
    b = long.where(F.col("model") == second).select("seed", "metric", F.col("value").alias("b"))
    both = a.join(b, ["seed", "metric"]).withColumn("delta", F.col("a") - F.col("b"))
    return both.groupBy("metric").agg(
        F.count("delta").alias("paired_n"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sample_sd_delta"), (F.count("delta") - 1).alias("degrees_of_freedom")
    )


def matrix_gaps(runs: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """model, seed, n, problem: cells of models by seeds that have no run or several. Both sides are small lists."""
    seen = runs.groupBy("model", "seed").agg(F.count("*").alias("n"))
    cells = models.select("model").distinct().join(F.broadcast(seeds.select("seed").distinct()))
    found = cells.join(seen, ["model", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.where("n <> 1").withColumn("problem", F.when(F.col("n") == 0, "missing").otherwise("duplicate"))


def uneven_fields(runs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n_values: fields on which the runs disagree (null is a value)."""
    long = runs.select(*[F.coalesce(F.to_json(F.struct(F.col(f).alias("v"))), F.lit("")).alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    return long.groupBy("field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def within_tolerance(exported: DataFrame, native: DataFrame, keys: Sequence[str], absolute: float, relative: float) -> DataFrame:
    """keys, status, reason, difference, allowed: |exported - native| <= absolute + relative * |native|. Sides have keys,
    value; a value that is missing or not finite fails."""
    both = native.select(*keys, F.col("value").cast("double").alias("native")).join(exported.select(*keys, F.col("value").cast("double").alias("exported")), list(keys), "full")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    there = F.col("native").isNotNull() & F.col("exported").isNotNull()
    good = there & finite(F.col("native")) & finite(F.col("exported"))
    difference, allowed = F.abs(F.col("exported") - F.col("native")), absolute + relative * F.abs(F.col("native"))
    reason = F.when(~there, "missing_or_non_numeric").when(~good, "non_finite").when(difference <= allowed, "within_tolerance").otherwise("tolerance_exceeded")
    rows = both.select(*keys, reason.alias("reason"), F.when(good, difference).alias("difference"), F.when(good, allowed).alias("allowed"))
    return rows.withColumn("status", F.when(F.col("reason") == "within_tolerance", "PASS").otherwise("FAIL"))


def array_errors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n, max_error, mean_error, p99_error (linear) between two arrays of values of the same length."""
    both = left.select(key, F.col("values").alias("a")).join(right.select(key, F.col("values").alias("b")), key)
    each = both.select(key, F.explode(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))).alias("e"))
    return each.groupBy(key).agg(F.count("*").alias("n"), F.max("e").alias("max_error"), F.avg("e").alias("mean_error"), F.percentile("e", F.lit(0.99)).alias("p99_error"))


def array_stats(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key, numel, mean, std (of the population), min, max, l2."""
    each = rows.select(key, F.explode(F.col(values).cast("array<double>")).alias("v"))
    return each.groupBy(key).agg(
        F.count("*").alias("numel"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2")
    )


def latency_summary(frames: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, p50, p95, p99 (exact, linear), fps (n over the sum, in milliseconds)."""
    p = [F.percentile(value, F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)]
    return frames.groupBy(key).agg(F.count(value).alias("n"), *p, (F.count(value) * 1000.0 / F.sum(value)).alias("fps"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side and the rows' columns, with n: what one side has more often than the other, and how many more."""
    columns = left.columns
    count = lambda rows, sign: rows.select(*columns, F.lit(sign).alias("sign"))
    net = count(left, 1).unionByName(count(right, -1)).groupBy(*columns).agg(F.sum("sign").alias("net")).where("net <> 0")
    return net.select(F.when(F.col("net") > 0, "left").otherwise("right").alias("side"), *columns, F.abs("net").alias("n"))


#: About so many rows of a side are a task's.
ROWS_OF_A_TASK = 500_000


def _by_key(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by the key to as many partitions as their rows ask for, where the session's number is too small: what
    a task sorts doesn't grow with the tables then."""
    parts = -(-max(left.count(), right.count()) // ROWS_OF_A_TASK)
    if parts <= int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return left, right
    return left.repartition(parts, key), right.repartition(parts, key)


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, problem: missing or unexpected."""
    expected, actual = _by_key(expected.select(key), actual.select(key), key)
    missing = expected.select(key).distinct().join(actual, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(actual.select(key).distinct().join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, expected, actual: fields of the same key that differ (null equals null)."""
    left, right = _by_key(*(rows.select(key, *[F.col(f).cast("string").alias(f"{side}_{f}") for f in fields]) for side, rows in (("l", left), ("r", right))), key)
    both = left.join(right, key)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("expected"), F.col(f"r_{f}").alias("actual")) for f in fields]))
    return both.select(key, each.alias("x")).select(key, "x.*").where("not (expected <=> actual)")


def repeated_values(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shared_between(rows: DataFrame, key: str, group: str) -> DataFrame:
    """key, n_groups: keys that several groups have."""
    return rows.groupBy(key).agg(F.count_distinct(group).alias("n_groups")).where("n_groups > 1")


def broken_sequences(rows: DataFrame, group: str, place: str, first: int = 1) -> DataFrame:
    """group, n, lowest, highest: groups whose places aren't exactly first, first + 1, ... once each."""
    found = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(place).alias("d"), F.min(place).alias("lowest"), F.max(place).alias("highest"))
    return found.where((F.col("n") != F.col("d")) | (F.col("lowest") != first) | (F.col("highest") != F.col("n") + first - 1)).drop("d")


def last_and_best(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """group, last_place, last_value, best_place, best_value: at the highest place, and at the first of the highest values."""
    best = F.max_by(F.struct(F.col(place).alias("p"), F.col(value).alias("v")), F.struct(F.col(value), -F.col(place)))
    return rows.groupBy(group).agg(F.max(place).alias("last_place"), F.max_by(value, place).alias("last_value"), best.alias("b")).select(
        group, "last_place", "last_value", F.col("b.p").alias("best_place"), F.col("b.v").alias("best_value")
    )


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def violations(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, key: a row for each rule (a condition; null counts as broken) that a row breaks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def all_violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(found: DataFrame) -> None:
    """Raise ValueError with some violations, if there are any."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"rules are broken: {[tuple(x) for x in some]}")
