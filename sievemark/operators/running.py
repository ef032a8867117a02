"""Running sums and maxima over groups of any size: ranges of a group are different tasks, and only their totals meet."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import written

RANGE = "__range"


def in_ranges(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """rows with the number of their range of keys and order (names, and whether they rise), written once so that ranges
    are the same for all that reads them."""
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    return written(rows.repartitionByRange(*[F.col(k).asc() for k in keys], *by).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(ranged: DataFrame, keys: list[str], order: list[tuple[str, bool]], sums: dict[str, Column] | None = None, maxima_behind: dict[str, Column] | None = None) -> DataFrame:
    """The rows of in_ranges with a column for each sum over the rows of their group up to their own, and for each maximum
    over the rows from their own on. order must settle all ties. Within a range that is a window; what other ranges add are
    totals, a row for each group and range."""
    sums, maxima_behind = sums or {}, maxima_behind or {}
    own = [*keys, RANGE]
    by = lambda flip: [F.col(c).asc() if up != flip else F.col(c).desc() for c, up in order]
    upto = Window.partitionBy(*own).orderBy(*by(False)).rowsBetween(Window.unboundedPreceding, 0)
    from_on = Window.partitionBy(*own).orderBy(*by(True)).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*own).agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())], *[F.max(c).alias(f"__m{i}") for i, c in enumerate(maxima_behind.values())])
    ranges = Window.partitionBy(*keys)
    ahead = ranges.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    behind = ranges.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    added = [F.sum(f"__s{i}").over(ahead).alias(f"__a{i}") for i in range(len(sums))] + [F.max(f"__m{i}").over(behind).alias(f"__b{i}") for i in range(len(maxima_behind))]
    others = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(own)], *added)
    local = [F.sum(c).over(upto).alias(f"__l{i}") for i, c in enumerate(sums.values())] + [F.max(c).over(from_on).alias(f"__h{i}") for i, c in enumerate(maxima_behind.values())]
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(own)]
    both = ranged.select("*", *local).join(others, reduce(and_, same))
    found = [(F.coalesce(f"__a{i}", F.lit(0)) + F.col(f"__l{i}")).alias(name) for i, name in enumerate(sums)]
    found += [F.greatest(f"__b{i}", f"__h{i}").alias(name) for i, name in enumerate(maxima_behind)]
    return both.select(*[F.col(f"`{c}`") for c in ranged.columns], *found)

