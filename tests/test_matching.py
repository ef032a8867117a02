"""Grid pairs, matches and suppression of large groups, prefix scans, average precision and whole evaluations, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import evaluation, matching, running

TARGET = "image_id int, category string, id long, x double, y double, w double, h double"


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    return common / (a[2] * a[3] + b[2] * b[3] - common) if a[2] * a[3] + b[2] * b[3] - common else 0.0


def boxes(rng, n, images=2, spread=60.0, scored=False, first=0):
    side = lambda: rng.choice([1.0, 2.0, 4.0, 8.0, 0.3, 7.9, 33.0, rng.uniform(0.1, 50)])
    rows = []
    for i in range(n):
        box = (rng.uniform(-spread, spread), float(rng.randint(-20, 20)), side(), side())
        if rows and rng.random() < 0.3:  # near copies, and equal ones
            box = tuple(v + rng.choice([0.0, 0.1]) for v in rows[-1][3:7])
        rows.append((rng.randrange(images), rng.choice("ab"), first + i, *box, *([rng.choice([0.1, 0.25, 0.5, 0.5, 0.9, rng.random()])] if scored else [])))
    return rows


def frames(spark, targets, predictions):
    return spark.createDataFrame(targets, TARGET), spark.createDataFrame(predictions, TARGET + ", score double")


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 0.9, 1.0])
def test_grid_pairs_are_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    targets, predictions = boxes(rng, 120), boxes(rng, 150, scored=True, first=1000)
    targets += [(0, "a", 900, float("nan"), 0.0, 5.0, 5.0), (0, "a", 901, 0.0, 0.0, 0.0, 5.0), (0, "a", 902, 0.0, float("inf"), 5.0, 5.0), (0, "a", 903, 1e12, 0.0, 8.0, 8.0), (0, "a", 904, 0.0, 0.0, -4.0, 4.0)]
    predictions += [(0, "a", 2903, 1e12, 0.0, 8.0, 8.0, 0.5), (0, "a", 2904, float("nan"), 0.0, 5.0, 5.0, 0.5)]
    want = {(t[2], p[2]) for t, p in itertools.product(targets, predictions) if t[:2] == p[:2] and all(map(math.isfinite, t[3:7] + p[3:7])) and min(t[5], t[6], p[5], p[6]) > 0 and iou(p[3:7], t[3:7]) >= least}
    got = [(r.target_id, r.prediction_id) for r in matching.iou_pairs(*frames(spark, targets, predictions), ["image_id", "category"], least, large=0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = {(r.target_id, r.prediction_id) for r in matching.iou_pairs(*frames(spark, targets[:120], predictions[:150]), ["image_id", "category"], least, large=60).collect()}
    assert some == {(t, p) for t, p in want if t < 900 and p < 2900}


def test_a_large_image_looks_at_few_pairs(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("image_id"), "id", *[(F.rand(s) * m).alias(c) for s, c, m in ((1, "x", 8000), (2, "y", 8000))], *[(F.rand(s) * 20 + 10).alias(c) for s, c in ((3, "w"), (4, "h"))])
    looked = matching.grid_pairs(rows, rows, ["image_id"], 0.5)
    touching = looked.where((F.least(F.col("l.x") + F.col("l.w"), F.col("r.x") + F.col("r.w")) > F.greatest("l.x", "r.x")) & (F.least(F.col("l.y") + F.col("l.h"), F.col("r.y") + F.col("r.h")) > F.greatest("l.y", "r.y")))
    n, over = looked.count(), touching.count()
    assert 100_000 <= over <= n < 4 * over


@pytest.mark.parametrize(("seed", "keys"), [(1, ["image_id", "category"]), (2, ["image_id"]), (3, ["image_id", "category"])])
def test_large_groups_match_as_small_ones(spark, seed, keys):
    rng = random.Random(seed)
    targets, predictions = boxes(rng, 140, spread=20.0), boxes(rng, 160, spread=20.0, scored=True, first=1000)
    targets += [(0, "a", 500 + i, 5.0, 5.0, 9.0, 9.0) for i in range(12)]  # all alike: one refusal a round
    predictions += [(0, "a", 2000 + i, 5.0, 5.0, 9.0, 9.0, 0.7) for i in range(15)]
    predictions += [(*t[:2], 4000 + t[2], *[v + rng.choice([0.0, 0.0, 0.2]) for v in t[3:7]], rng.choice([0.5, rng.random()])) for t in targets if rng.random() < 0.7]
    sides = frames(spark, targets, predictions)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    small = rows(matching.matches(*sides, keys))
    assert small == rows(matching.matches(*sides, keys, large=0)) and len(small) == len(predictions) and sum(r[-3] for r in small) > 60
    some = rows(matching.matches(*sides, keys, large=80))
    assert some == small


@pytest.mark.parametrize("strict", [True, False])
def test_large_groups_are_suppressed_as_small_ones(spark, strict):
    rng = random.Random(7)
    rows = boxes(rng, 300, spread=15.0, scored=True) + [(0, "a", 700 + i, float(i), 0.0, 9.0, 9.0, 0.9 - i / 1000) for i in range(60)] + [(1, "b", 900, 3.0, 3.0, 0.0, 5.0, 0.3)]
    df = spark.createDataFrame(rows, TARGET + ", score double")
    kept = lambda **k: sorted((r.image_id, r.id) for r in matching.suppress(df, 0.5, strict, ["image_id"], **k).collect())
    assert kept(large=0) == kept() and kept(large=0, most=7) == kept(most=7) and 0 < len(kept()) < len(rows)


def test_counts_and_confusion_with_one_side_missing(spark):
    targets, predictions = frames(spark, [(1, "a", 1, 0.0, 0.0, 5.0, 5.0), (1, "b", 2, 50.0, 0.0, 5.0, 5.0)], [(1, "b", 3, 0.0, 0.0, 5.0, 5.0, 0.9), (2, "c", 4, 0.0, 0.0, 5.0, 5.0, 0.9)])
    assert sorted(map(tuple, matching.match_counts(targets, predictions).collect())) == [("a", 0, 0, 1), ("b", 0, 1, 1), ("c", 0, 1, 0)]
    assert sorted(map(tuple, matching.confusion(targets, predictions).collect())) == [("a", "b", 1, 1.0), ("b", "background", 1, 1.0), ("background", "c", 1, 1.0)]
    assert matching.confusion(targets.where("false"), predictions.where("false")).count() == 0


def test_running_sums_and_maxima_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", None, "b", "a", "a"][i % 5], i, int(rng.integers(0, 40)), int(rng.integers(-9, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, s int, v int").repartition(7)
    order = [("s", False), ("id", True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    ranged = running.in_ranges(df, ["k"], order)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.where("k = 'a'").select(running.RANGE).distinct().count() > 1
    got = {r.id: (r.total, r.best) for r in running.running(ranged, ["k"], order, {"total": F.col("v")}, {"best": F.col("v")}).collect()}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        for i, r in enumerate(own):
            assert got[r[1]] == (sum(x[3] for x in own[: i + 1]), max(x[3] for x in own[i:]))


def plain_average(targets, predictions, category, area, t):
    """AP and recall at 1, 10, 100 of one category by the published definition; None without targets."""
    low, high = {"all": (0, 1e10), "small": (0, 1024), "medium": (1024, 9216), "large": (9216, 1e10)}[area]
    outside = lambda b: not low <= b[5] * b[6] <= high
    n = sum(not outside(g) for g in targets if g[1] == category)
    if not n:
        return None
    hits = []
    for image in sorted({r[0] for r in targets + predictions}):
        gts = sorted((g for g in targets if g[:2] == (image, category)), key=lambda g: (outside(g), g[2]))
        used = set()
        for place, p in enumerate(sorted((p for p in predictions if p[:2] == (image, category)), key=lambda p: (-p[7], p[2]))[:100]):
            best = None
            for g in gts:
                if g[2] in used or iou(p[3:7], g[3:7]) < t or best is not None and (outside(g) > outside(best) or iou(p[3:7], g[3:7]) < iou(p[3:7], best[3:7])):
                    continue
                best = g
            if best is not None:
                used.add(best[2])
            if not (outside(best) if best is not None else outside(p)):
                hits.append((-p[7], image, p[2], best is not None, place))
    hits.sort()
    tps, precision = np.cumsum([h[3] for h in hits]), []
    for i in range(len(hits)):
        precision.append(tps[i] / (i + 1))
    best = np.maximum.accumulate(precision[::-1])[::-1] if hits else []
    recall = tps / n if hits else np.zeros(0)
    ap = sum(best[k] if k < len(hits) else 0.0 for k in np.searchsorted(recall, [i * 0.01 for i in range(101)], side="left")) / 101
    return ap, *[sum(h[3] for h in hits if h[4] < most) / n for most in (1, 10, 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_average_precision_against_the_definition(spark, seed):
    rng = random.Random(seed)
    targets = [(r[0], r[1], r[2], *[round(v * (4 if rng.random() < 0.3 else 1), 3) for v in r[3:7]]) for r in boxes(rng, 60, 4, 30.0)]
    predictions = [(t[0], t[1], 1000 + i, *[v + rng.choice([0.0, 0.0, 0.7]) for v in t[3:7]], rng.choice([0.2, 0.5, 0.8, rng.random()])) for i, t in enumerate(targets * 2) if rng.random() < 0.8]
    sides = frames(spark, targets, predictions)
    rows = {(r.category, r.area, r.iou): (r.ap, r.ar1, r.ar10, r.ar100) for r in matching.average_precision(*sides).collect()}
    want = {(c, a, t): plain_average(targets, predictions, c, a, t) or (None,) * 4 for c in "ab" for a in ("all", "small", "medium", "large") for t in matching.AP_IOUS}
    assert set(rows) == set(want)
    for k, v in want.items():
        assert rows[k] == pytest.approx(v, abs=1e-12) if v[0] is not None else rows[k] == v
    mean = lambda i, area, at=None: np.mean([v[i] for (c, a, t), v in want.items() if a == area and at in (None, t) and v[0] is not None])
    found = {(r.section, r.category, r.name): r.value for r in evaluation.average_figures(*sides).collect()}
    assert found["metrics", None, "ap50_95"] == pytest.approx(mean(0, "all")) and found["metrics", None, "ap75"] == pytest.approx(mean(0, "all", 0.75))
    assert found["metrics", None, "ar10"] == pytest.approx(mean(2, "all")) and found["metrics", None, "ar_medium"] == pytest.approx(mean(3, "medium"))
    assert found["per_class", "a", "ap50_95"] == pytest.approx(np.mean([v[0] for (c, a, t), v in want.items() if c == "a" and a == "all"]))


def test_average_precision_over_many_ranges_and_batches(spark, monkeypatch):
    """A row for each prediction is all that is dealt to ranges, and these don't change what comes out."""
    rng = random.Random(6)
    targets, predictions = boxes(rng, 300, 9, 30.0), boxes(rng, 500, 9, 30.0, scored=True, first=1000)
    rows = lambda: {(r.category, r.area, r.iou): (r.ap, r.ar1, r.ar10, r.ar100) for r in matching.average_precision(*frames(spark, targets, predictions)).collect()}
    whole, ranges, in_ranges = rows(), [], running.in_ranges
    monkeypatch.setattr(running, "in_ranges", lambda *a: ranges.append(in_ranges(*a)) or ranges[-1])
    monkeypatch.setattr(matching, "_DEAL", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = rows()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges[0].select(running.RANGE).distinct().count() > 2 and ranges[0].count() <= len(predictions)
    assert set(many) == set(whole) and all(many[k] == (pytest.approx(v) if v[0] is not None else v) for k, v in whole.items())
    for k in (("a", "all", 0.5), ("b", "small", 0.7), ("a", "medium", 0.9)):
        assert many[k] == pytest.approx(plain_average(targets, predictions, *k), abs=1e-12)


def test_averages_without_predictions_or_targets(spark):
    targets, predictions = frames(spark, [(1, "a", 1, 0.0, 0.0, 5.0, 5.0)], [(1, "b", 3, 0.0, 0.0, 5.0, 5.0, 0.9)])
    stats = lambda a, b: {r.name: r.value for r in evaluation.average_figures(a, b).where("category IS NULL").collect()}
    none = predictions.where("false")
    assert (s := stats(targets, none))["ap50_95"] == s["ar100"] == s["ap_small"] == 0.0 and s["ap_large"] is s["ar_medium"] is None
    assert (s := stats(targets.where("false"), predictions))["ap50"] is s["ap_small"] is None
    assert (s := stats(targets.where("false"), none))["ap50"] == 0.0 and s["ap_small"] is None
    classes = {r.category: r.value for r in evaluation.average_figures(targets, predictions).where("section = 'per_class'").collect()}
    assert classes == {"a": 0.0, "b": 0.0}


def test_a_whole_evaluation(spark):
    rng = random.Random(4)
    targets = boxes(rng, 50, 3, 30.0)
    predictions = [(t[0], t[1], 1000 + i, *t[3:7], 0.3 + 0.6 * rng.random()) for i, t in enumerate(targets)] + boxes(rng, 40, 3, scored=True, first=3000)
    sides = frames(spark, targets, predictions)
    rows = evaluation.full_evaluation(*sides, "val", target_precision=0.6, least_bound=0.4).collect()
    at = {(r.section, r.category, r.against, r.confidence, r.name): r for r in rows}
    assert len(at) == len(rows)
    plain = {r.category: r for r in matching.match_counts(sides[0], sides[1].where("score >= 0.25")).collect()}
    assert at["metrics", None, None, None, "tp"].value == sum(r.tp for r in plain.values()) and at["per_class", "a", None, None, "fn"].value == plain["a"].fn
    curve = [(r.value, -r.confidence) for r in rows if r.section == "curve" and r.name == "f1"]
    assert len(curve) == 101 and (at["metrics", None, None, None, "best_f1"].value, -at["metrics", None, None, None, "best_f1_confidence"].value) == max(curve)
    assert {r.status for r in rows if r.section == "calibration"} <= {matching.CHOSEN, matching.NOT_AVAILABLE} and at["calibration", None, None, None, "confidence"].status == matching.CHOSEN
    assert sum(r.value for r in rows if r.section == "areas") == len(targets) and ("metrics", None, None, None, "ap50_95") in at
    assert sum(r.value for r in rows if r.section == "confusion" and r.name == "n" and r.category != "background") == len(targets)
    test = evaluation.operating_figures(*sides, "test").collect()
    assert not [r for r in test if r.name.startswith("best_f1")] and {(r.status, r.value) for r in test if r.section == "calibration"} == {(evaluation.FORBIDDEN, None)}
    with pytest.raises(ValueError):
        evaluation.operating_figures(*sides, "train")
