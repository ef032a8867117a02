"""Exact sums and percentiles against Python's own."""

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievemark.operators import exact


def hostile(rng, n):
    out = [rng.choice([1e305, -1e305, 1e-308, 5e-324, -5e-324, 2.0**-1022, 1.0, 1e16, -1e16, 0.1, 3.0, 0.0, -0.0, 2.0**52 + 1, 1 - 2.0**-53]) for _ in range(n)]
    return out + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(n)]


def test_sums_are_those_of_fsum_in_any_dealing(spark):
    rng = random.Random(3)
    groups = {"a": hostile(rng, 300), "b": [0.1] * 10, "c": [1e16, 1.0, -1e16], None: [2.5], "e": [None], "f": [1e308, 1e308, -1e308], "g": [5e-324] * 3}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    for parts in (1, 7):
        got = {r.k: r for r in exact.exact_moments(df.repartition(parts), ["k"], ["v"]).collect()}
        for k, vs in groups.items():
            own = [v for v in vs if v is not None]
            assert got[k].n == len(own)
            if k == "e":
                assert got[k]["sum"] is got[k]["mean"] is None
            else:
                total = float(sum(map(Fraction, own)))  # what math.fsum gives where nothing overflows on the way
                assert got[k]["sum"] == total and got[k]["mean"] == total / len(own)


def test_deviations_and_odd_values(spark):
    rng = random.Random(4)
    own = [1e9 + rng.random() for _ in range(200)]
    rows = [("a", v) for v in own] + [("n", math.nan), ("n", 1.0), ("u", math.inf), ("u", 1.0), ("m", math.inf), ("m", -math.inf), ("x", 1.5e308), ("x", 1.5e308)]
    got = {r.k: r for r in exact.exact_moments(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], ["v"]).collect()}
    assert got["a"]["std"] == pytest.approx(statistics.stdev(own), rel=1e-15)
    assert math.isnan(got["n"]["sum"]) and math.isnan(got["m"]["sum"]) and got["u"]["sum"] == math.inf and got["x"]["sum"] == got["x"]["std"] == math.inf
    runs = spark.createDataFrame([("m", 0.1, None), ("m", 0.2, None), ("one", 0.3, 1.0)], "model string, p double, q double")
    rows = {r.model: r for r in exact.aggregate_runs(runs, ["p", "q"]).collect()}
    assert tuple(rows["m"]) == ("m", 2, statistics.fmean([0.1, 0.2]), statistics.stdev([0.1, 0.2]), None, None) and tuple(rows["one"]) == ("one", 1, 0.3, None, 1.0, None)
    assert exact.exact_moments(runs.where("false"), ["model"], ["p"]).count() == 0


def test_percentiles_are_the_built_in_ones(spark):
    rng = random.Random(5)
    rows = [("many", rng.choice([rng.gauss(0, 1), 10.0 ** rng.randint(-9, 9)])) for _ in range(20_000)]
    rows += [("same", 3.5)] * 500 + [("few", 1.0), ("few", 2.0), ("one", 7.0), ("none", None), (None, -1.0), (None, 4.0)] + [("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(s)).alias(c) for c, s in shares.items()]).collect() if r.k != "none"}
    got = {r.k: tuple(r)[1:] for r in exact.exact_percentiles(df, ["k"], "v", shares).collect()}
    assert str(got) == str({k: want[k] for k in got}) and set(got) == set(want)
    whole = exact.exact_percentiles(df.where("k = 'many'"), [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [want["many"][1]]
    assert exact.exact_percentiles(df.where("false"), ["k"], "v", shares).count() == 0


def test_a_sketch_that_is_wrong_does_no_harm(spark):
    df = spark.range(1000).selectExpr("'a' AS k", "CAST(id AS DOUBLE) AS v")
    got = exact.exact_percentiles(df, ["k"], "v", {"m": 0.731}, accuracy=1_000_000_000).collect()
    assert got[0].m == df.agg(F.percentile("v", F.lit(0.731))).first()[0]
