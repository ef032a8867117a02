"""Sums, means, deviations and percentiles that don't depend on how rows are dealt or in which order they are added."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sievemark.operators.running import in_ranges, running
from sievemark.session import written

# A double is a whole number of 56 bits times a power of two. The number is cut at multiples of 2 ** 32, and what falls on
# each multiple is added up in decimals: no sum is ever rounded.
_LIMB, _LOWEST, _WHOLE = 32, 1152, 54
_NAN, _UP, _DOWN = -1, -2, -3


def _limbs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __k, __p of rows with doubles __v: each is the sum of its __p * 2 ** (32 * __k - _LOWEST). What isn't finite is
    one row of its own, and zero none. Steps are columns, so that each is reckoned once."""
    rows = rows.where(F.col("__v") != 0)
    odd = F.isnan("__v") | (F.abs("__v") == float("inf"))
    code = F.when(F.isnan("__v"), _NAN).when(F.col("__v") > 0, _UP).otherwise(_DOWN)
    special = rows.where(odd).select(*keys, code.alias("__k"), F.lit(1).cast("long").alias("__p"))
    # The logarithm may be off by one next to a power of two, for which the number has bits to spare.
    out = rows.where(~odd).withColumn("__t", _WHOLE - F.floor(F.log2(F.abs("__v"))).cast("int"))
    half = F.floor(F.col("__t") / 2)
    out = out.withColumn("__w", (F.abs("__v") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.col("__t") - half)).cast("long"))
    at, mask = F.lit(_LOWEST) - F.col("__t"), F.lit((1 << _LIMB) - 1)
    out = out.withColumn("__k", F.floor(at / _LIMB).cast("int")).withColumn("__r", F.pmod(at, F.lit(_LIMB)).cast("int"))
    shifted = lambda c: F.call_function("shiftleft", c, F.col("__r"))
    out = out.withColumn("__low", shifted(F.col("__w").bitwiseAND(mask))).withColumn("__high", shifted(F.shiftright("__w", _LIMB)))
    parts = [F.col("__low").bitwiseAND(mask), F.shiftrightunsigned("__low", _LIMB) + F.col("__high").bitwiseAND(mask), F.shiftright("__high", _LIMB)]
    sign = F.when(F.col("__v") < 0, -1).otherwise(1)
    each = F.explode(F.array(*[F.struct((F.col("__k") + i).alias("k"), (sign * p).alias("p")) for i, p in enumerate(parts)]))
    return out.select(*keys, each.alias("__x")).select(*keys, F.col("__x.k").alias("__k"), F.col("__x.p").alias("__p")).unionByName(special)


def _square(v: Column) -> tuple[Column, Column]:
    """v * v as the sum of two doubles, exact while neither is too large or too small for one."""
    c = v * 134217729.0
    high = c - (c - v)
    low = v - high
    p = v * v
    return p, ((high * high - p) + 2.0 * high * low) + low * low


def _total(limbs) -> tuple[Fraction, float | None]:
    """The sum of limbs, and what stands for it where it isn't finite."""
    found = {int(x["k"]): int(x["p"]) for x in limbs} if limbs is not None else {}
    odd = None
    if _NAN in found or _UP in found and _DOWN in found:
        odd = math.nan
    elif _UP in found or _DOWN in found:
        odd = math.inf if _UP in found else -math.inf
    return Fraction(sum(p << (_LIMB * k) for k, p in found.items() if k >= 0), 1 << _LOWEST), odd


def _rounded(x: Fraction) -> float:
    try:
        return x.numerator / x.denominator
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _root(x: Fraction) -> float:
    """The square root, rounded once: a whole number of over 100 bits whose last one tells that there is a rest."""
    shift = max(0, 120 - (x.numerator.bit_length() - x.denominator.bit_length()) // 2)
    square, rest = divmod(x.numerator << 2 * shift, x.denominator)
    root = math.isqrt(square)
    if rest or root * root != square:
        root |= 1
    return _rounded(Fraction(root, 1 << shift))


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("sum", "mean", "std")]))
def _moments(n: pd.Series, sums: pd.Series, squares: pd.Series) -> pd.DataFrame:
    out = []
    for count, s, q in zip(n, sums, squares, strict=True):
        (total, odd), (square, beyond) = _total(s), _total(q)
        if count == 0:
            out.append((None, None, None))
        elif odd is not None:
            out.append((odd, odd, math.nan if count > 1 else None))
        elif beyond is not None:
            out.append((_rounded(total), _rounded(total) / count, math.inf if count > 1 else None))
        else:
            value = _rounded(total)
            spread = max(square - total * total / int(count), Fraction(0)) / (int(count) - 1) if count > 1 else None
            out.append((value, value / count, None if spread is None else _root(spread)))
    return pd.DataFrame(out, columns=["sum", "mean", "std"], dtype="object").astype("float64")


def exact_moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, metric, n, sum, mean, std: of each column's values that aren't null, sums as if reckoned without rounding and
    rounded once, means as that sum over n, deviations of the sample from exact sums of squares (null for one value).

    What is shuffled is at most 70 whole numbers a group and task; NaN, or both infinities, make NaN."""
    null = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = null.unpivot(list(keys), list(columns), "metric", "v")
    counts = long.groupBy(*keys, "metric").agg(F.count("v").alias("n"))
    own = [*keys, "metric", "__q"]
    square, rest = _square(F.col("v"))
    fine = F.abs(square) < float("inf")  # else the square stands for itself, as infinite
    each = F.array(*[F.struct(F.lit(q).alias("q"), v.alias("v")) for q, v in ((0, F.col("v")), (1, square), (1, F.when(fine, rest)))])
    each = long.where("v IS NOT NULL").select(*keys, "metric", F.explode(each).alias("__x")).select(*keys, "metric", F.col("__x.q").alias("__q"), F.col("__x.v").alias("__v"))
    limbs = _limbs(each, own).groupBy(*own, "__k").agg(F.sum(F.col("__p").cast("decimal(20,0)")).alias("__p"))
    of = lambda which: F.collect_list(F.when(F.col("__q") == which, F.struct(F.col("__k").alias("k"), F.col("__p").alias("p"))))
    sums = limbs.groupBy(*keys, "metric").agg(of(0).alias("sums"), of(1).alias("squares"))
    same = [counts[c].eqNullSafe(sums[c]) for c in (*keys, "metric")]
    both = counts.join(sums, same, "left").select(*[counts[c] for c in (*keys, "metric")], "n", _moments("n", "sums", "squares").alias("m"))
    # Arrow hands NaN back as null, and there is no other null where there are values enough.
    of = lambda c, least: F.when(F.col("n") >= least, F.coalesce(f"m.{c}", F.lit(math.nan))).alias(c)
    return both.select(*keys, "metric", "n", of("sum", 1), of("mean", 1), of("std", 2))


def aggregate_runs(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """model, runs, and {metric}_mean, {metric}_std of exact_moments."""
    long = exact_moments(runs, ["model"], metrics)
    named = long.select("model", F.explode(F.array(*[F.struct(F.concat("metric", F.lit(f"_{c}")).alias("name"), F.col(c).alias("value")) for c in ("mean", "std")])).alias("x"))
    wide = named.groupBy("model").pivot("x.name", [f"{m}_{c}" for m in metrics for c in ("mean", "std")]).agg(F.first("x.value"))
    counts = runs.groupBy(F.col("model").alias("own")).agg(F.count("*").alias("runs"))
    return counts.join(wide, F.col("own").eqNullSafe(F.col("model"))).drop("own").select("model", "runs", *[c for c in wide.columns if c != "model"])


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], accuracy: int = 1000) -> DataFrame:
    """keys and a column for each share (0 to 1): linear percentiles, the same as the built-in `percentile` gives.

    That one holds all different values of a group in one task. Here a sketch of each group says between which values a rank
    must lie, counts below and within say where exactly, and only values within are put in order, by ranges (see running).
    Should a sketch be wrong, that group's values are put in order whole. Nulls don't count, NaN is the largest."""
    keys = list(keys)
    values = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    own = [f"k{i}" for i in range(len(keys))]
    margin = 2.0 / accuracy
    asked = F.array(*[F.lit(x) for s in shares.values() for x in (max(0.0, s - margin), min(1.0, s + margin))])
    sketch = values.groupBy(*own).agg(F.count("*").alias("n"), F.percentile_approx("v", asked, accuracy).alias("b"))
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(s).alias("share"), F.get("b", 2 * i).alias("low"), F.get("b", 2 * i + 1).alias("high")) for i, (name, s) in enumerate(shares.items())]
    bounds = sketch.select(*own, "n", F.explode(F.array(*wanted)).alias("w")).select(*own, "n", "w.*")
    place = F.col("share") * (F.col("n") - 1)
    bounds = written(bounds.withColumn("place", place).withColumn("first", F.floor("place")).withColumn("last", F.ceil("place")), "bounds")

    def chosen(limits: DataFrame) -> DataFrame:
        """Values at the places of limits, where these are within."""
        same = [values[c].eqNullSafe(limits[c]) for c in own]
        both = (values.join(limits, same) if own else values.join(F.broadcast(limits))).select(*[limits[c] for c in limits.columns], "v")
        below = both.groupBy(*own, "name").agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
        within = both.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy(*own, "name", "v").agg(F.count("*").alias("c"))
        group, order = [*own, "name"], [("v", True)]
        counted = running(in_ranges(within, group, order), group, order, {"upto": F.col("c")})
        counted = counted.alias("a").join(below.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]).select("a.*", "b.below")
        spots = limits.select(*group, "place", "first", "last")
        at = counted.alias("a").join(spots.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]).select("a.*", "b.place", "b.first", "b.last")
        hit = lambda spot: F.max(F.when((F.col(spot) < F.col("below") + F.col("upto")) & (F.col(spot) >= F.col("below") + F.col("upto") - F.col("c")), F.col("v")))
        ends = at.groupBy(*group).agg(hit("first").alias("x"), hit("last").alias("y"), F.first("place").alias("place"), F.first("first").alias("first"), F.first("last").alias("last"))
        between = F.when((F.col("first") == F.col("last")) | (F.col("x") == F.col("y")), F.col("x")).otherwise((F.col("last") - F.col("place")) * F.col("x") + (F.col("place") - F.col("first")) * F.col("y"))
        return written(ends.where("x IS NOT NULL AND y IS NOT NULL").select(*group, between.alias("value")), "chosen")

    found = chosen(bounds)
    lost = bounds.alias("a").join(found.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*own, "name")], "left_anti")
    if not lost.isEmpty():
        found = found.unionByName(chosen(written(lost.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("nan"))), "lost")))
    wide = found.groupBy(*own).pivot("name", list(shares)).agg(F.first("value"))
    return wide.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *shares)
