"""Operators against plain loops and hand-made cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.operators import canonical, compare, duplicates, graph, matching, review, splits

BOX = "image_id long, category string, id long, x double, y double, w double, h double"


def iou(a, b):
    common = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - common
    return common / union if union > 0 else 0.0


def cases(seed, n):
    rng = random.Random(seed)
    box = lambda: tuple(float(rng.randrange(k)) for k in (12, 12)) + tuple(float(rng.randrange(4, 9)) for _ in range(2))
    targets = [(i % 7, rng.choice("ab"), i, *box()) for i in range(n)]
    predictions = [(i % 8, rng.choice("ab"), 1000 + i, *box(), rng.randrange(11) / 10) for i in range(2 * n)]
    return targets, predictions


def plain_match(targets, predictions, least, keys=2):
    out, groups = {}, {}
    for t in targets:
        groups.setdefault(t[:keys], ([], []))[0].append(t)
    for p in predictions:
        groups.setdefault(p[:keys], ([], []))[1].append(p)
    for gts, prs in groups.values():
        used = set()
        for p in sorted(prs, key=lambda p: (-p[-1], p[2])):
            best = max(((iou(p[3:7], t[3:7]), t[2]) for t in gts if t[2] not in used), default=(0.0, -1))
            if best[0] >= least:
                used.add(best[1])
            out[p[2]] = best[1] if best[0] >= least else None
    return out


def frames(spark, targets, predictions):
    return spark.createDataFrame(targets, BOX), spark.createDataFrame(predictions, BOX + ", score double")


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_matches(spark, seed):
    targets, predictions = cases(seed, 60)
    got = matching.outcomes(*frames(spark, targets, predictions)).collect()
    assert {r.id: r.target_id for r in got} == plain_match(targets, predictions, 0.5)
    with pytest.raises(ValueError):
        matching.greedy_match(*frames(spark, targets, predictions), ["image_id"], 0)


def test_one_match_serves_all_thresholds(spark):
    targets, predictions = cases(3, 50)
    rows = {(r.category, round(r.confidence, 6)): (r.tp, r.fp, r.fn) for r in matching.threshold_sweep(*frames(spark, targets, predictions)).collect()}
    for step in range(101):
        found = plain_match(targets, [p for p in predictions if p[-1] >= step * 0.01], 0.5)
        for c in ("a", "b", None):
            own = [x for p in predictions for x in [found.get(p[2], "out")] if x != "out" and c in (None, p[1])]
            tp, n = sum(x is not None for x in own), sum(c in (None, t[1]) for t in targets)
            assert rows[c, round(step * 0.01, 6)] == (tp, len(own) - tp, n - tp)


def test_confusion_adds_up(spark):
    targets, predictions = cases(4, 40)
    rows = matching.confusion(*frames(spark, targets, predictions)).collect()
    assert sum(r.n for r in rows if r["true"] != "background") == len(targets) and sum(r.n for r in rows if r.predicted != "background") == len(predictions)
    found = plain_match(targets, predictions, 0.5, keys=1)
    assert sum(r.n for r in rows if "background" not in (r["true"], r.predicted)) == sum(x is not None for x in found.values())


def test_suppression(spark):
    rows = [(1, "a", 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, "a", 2, 1.0, 0.0, 10.0, 10.0, 0.8), (1, "b", 3, 0.0, 0.0, 10.0, 10.0, 0.7), (1, "a", 4, 0.0, 0.0, 10.0, 5.0, 0.6)]
    boxes = spark.createDataFrame(rows, BOX + ", score double")
    kept = lambda **o: {r.id for r in matching.suppress(boxes, keys=["image_id"], **o).collect()}
    assert kept(iou=0.5, strict=False) == {1, 3} and kept(iou=0.5, strict=True) == {1, 3, 4} and kept(iou=0.5, strict=True, most=2) == {1, 3}


def test_average_precision_by_hand(spark):
    targets = [(1, "a", 1, 0.0, 0.0, 10.0, 10.0), (2, "a", 2, 0.0, 0.0, 10.0, 10.0), (1, "b", 3, 0.0, 0.0, 50.0, 50.0)]
    predictions = [(1, "a", 11, 0.0, 0.0, 10.0, 10.0, 0.9), (1, "a", 12, 50.0, 50.0, 10.0, 10.0, 0.8), (2, "a", 13, 0.0, 0.0, 10.0, 10.0, 0.7)]
    rows = {(r.category, r.area, r.iou): r for r in matching.average_precision(*frames(spark, targets, predictions)).collect()}
    # Recall 0.5 at precision 1 for 51 points, then recall 1 at precision 2 / 3 for 50.
    assert rows["a", "all", 0.5].ap == pytest.approx((51 + 50 * 2 / 3) / 101) and rows["a", "small", 0.95].ap == rows["a", "all", 0.5].ap
    assert rows["a", "medium", 0.5].ap is None and rows["b", "all", 0.5].ap == 0.0 and rows["b", "medium", 0.5].ap == 0.0
    assert rows["a", "all", 0.5].ar1 == 1.0 and rows["a", "all", 0.5].ar100 == 1.0


def test_threshold_choice(spark):
    rows = [("a", 0.1, 10, 1, 0), ("a", 0.2, 10, 0, 0), ("a", 0.3, 10, 0, 0), ("b", 0.1, 0, 0, 5)]
    curve = matching.rates(spark.createDataFrame(rows, "category string, confidence double, tp long, fp long, fn long"))
    got = {r.category: r for r in matching.choose_threshold(curve, 0.9, 0.5).collect()}
    assert (got["a"].confidence, got["a"].precision) == (0.2, 1.0) and got["b"].status == "NOT_AVAILABLE" and got["b"].confidence is None
    assert {r.category: r.confidence for r in matching.best_f1(curve).collect()} == {"a": 0.2, "b": 0.1}


@pytest.mark.parametrize("most", [0, 3, 6])
def test_hamming_pairs(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(6)]
    rows = [(i, h - (1 << 64) if h >= 1 << 63 else h, f"p{i // 2}") for i, h in enumerate(hashes)]
    got = {(r.left_id, r.right_id): r.distance for r in duplicates.hamming_pairs(spark.createDataFrame(rows, "id long, hash long, pixels string"), most).collect()}
    want = {(i, j): (hashes[i] ^ hashes[j]).bit_count() for j in range(len(rows)) for i in range(j) if (hashes[i] ^ hashes[j]).bit_count() <= most and i // 2 != j // 2}
    assert got == want


def test_duplicate_groups(spark):
    rows = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2"), ("", "a", "3"), ("", "a", "4"), (None, "a", "5"), (None, "a", "6"), ("z", "a", "7")], "k string, c string, p string")
    got = duplicates.duplicate_groups(rows, F.col("k"), F.col("c"), F.col("p")).collect()
    assert [tuple(r) for r in got] == [("k", 2, True, "a|b", "1|2")]


def test_components_of_names(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), ("s", "s")], "a string, b string")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "s": "s"}


@pytest.mark.parametrize("small", [0, 15, 10_000])
def test_components_by_rounds_and_in_a_task(spark, small):
    rng = random.Random(small)
    names = [f"n{i:03d}é" for i in range(120)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("hub", f"q{i}") for i in range(30)] + [("z", "z")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a string, b string"), small=small).collect()}
    assert got == {x: root(x) for x in up}


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 300), st.sampled_from([(0.8, 0.1, 0.1), (0.6, 0.2, 0.2), (0.34, 0.33, 0.33)]))
def test_allocation(spark, n, shares):
    ratios = dict(zip(("train", "val", "test"), shares, strict=True))
    row = spark.range(1).select(*[c.alias(k) for k, c in splits.allocation(F.lit(n), ratios).items()]).first()
    exact = [n * x for x in shares]
    want = [int(x) for x in exact]
    for i in sorted(range(3), key=lambda i: (-(exact[i] - int(exact[i])), i))[: n - sum(want)]:
        want[i] += 1
    for i in range(3):
        if want[i] == 0:
            want[max(range(3), key=lambda k: (want[k], -k))] -= 1
            want[i] = 1
    assert list(row) == want


def test_group_split_is_exact_and_stable(spark):
    rows = [(f"model_{m}", f"model_{m}-condition-{i:02d}") for m in "ab" for i in range(10) for _ in range(2)]
    run = lambda r, seed: {x.group_id: x.split for x in splits.group_split(spark.createDataFrame(r, "model string, group_id string").repartition(3), seed, {"train": 0.6, "val": 0.2, "test": 0.2}).collect()}
    first = run(rows, 42)
    assert first == run(rows[::-1], 42) != run(rows, 43)
    for m in "ab":
        own = [s for g_, s in first.items() if g_.startswith(f"model_{m}")]
        assert [own.count(s) for s in ("train", "val", "test")] == [6, 2, 2]


def test_components_stay_whole(spark):
    rows = [(m, f"{m}{i}", f"c{m}{i // 2}" if i < 6 else ("cross" if i == 6 else f"c{m}{i}")) for m in "ab" for i in range(10)]
    frame = spark.createDataFrame(rows, "model string, group_id string, component_id string")
    got = {(r.model, r.component_id): r.split for r in splits.component_split(frame, ratios={"train": 0.6, "val": 0.2, "test": 0.2}).collect()}
    assert got["a", "cross"] == got["b", "cross"] == "train"
    for m in "ab":
        count = {s: sum(got[m, c] == s for mm, _, c in rows if mm == m) for s in ("train", "val", "test")}
        assert count == {"train": 6, "val": 2, "test": 2}
    whole = frame.withColumn("component_id", F.col("model"))
    assert {r.split for r in splits.component_split(whole).collect()} == {"NO_EXACT_SPLIT"}


def test_equal_datasets_hash_alike_in_any_order(spark):
    rows = [(f"i{i}", "a", str(i), "0", "1", "1") for i in range(50)]
    frame = lambda r: spark.createDataFrame(r, "image_key string, class_name string, x string, y string, w string, h string").repartition(3)
    assert canonical.payload_hash(frame(rows)).first() == canonical.payload_hash(frame(rows[::-1])).first() != canonical.payload_hash(frame(rows[1:])).first()
    assert tuple(canonical.equivalence(frame(rows), frame(rows[:-1] + rows[:1])).first()) == (1, 1, False) and canonical.equivalence(frame(rows), frame(rows)).first().equal


def test_tolerances(spark):
    side = lambda values: spark.createDataFrame(list(enumerate(values)), "k int, value double")
    native = side([1.0, 10.0, 0.0, 5.0, 1.0])
    got = compare.within_tolerance(side([1.00001, 10.0005, 0.1, None, float("nan")]), native, ["k"], 1e-4, 1e-4).orderBy("k").collect()
    assert [r.reason for r in got] == ["within_tolerance", "within_tolerance", "tolerance_exceeded", "missing_or_non_numeric", "non_finite"]


def test_runs(spark):
    runs = spark.createDataFrame([("y", 42, 1.0), ("y", 43, 1.0), ("x", 42, 0.97937), ("x", 43, 0.98984)], "model string, seed int, ap double")
    rows = {r.model: r for r in compare.aggregate_runs(runs, ["ap"]).collect()}
    assert rows["x"].ap_mean == pytest.approx(0.984605) and rows["x"].ap_std == pytest.approx(0.0074034, abs=1e-5)
    delta = compare.paired_deltas(runs, "y", "x", ["ap"]).first()
    assert (delta.paired_n, delta.degrees_of_freedom) == (2, 1) and delta.mean_delta == pytest.approx(0.015395)
    assert compare.aggregate_runs(runs.where("seed = 42"), ["ap"]).first().ap_std is None


def test_rules_are_rows_until_they_are_enforced(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "id int, v int")
    found = compare.violations(rows, F.col("id"), {"positive": F.col("v") > 0, "small": F.col("v") < 3})
    assert sorted(tuple(r) for r in found.collect()) == [("positive", "2"), ("small", "1"), ("small", "2")]
    with pytest.raises(ValueError):
        compare.enforce(found)
    compare.enforce(found.where("false"))


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 1), (4, 2)], "g int, p int")
    assert {r.g for r in compare.broken_sequences(rows, "g", "p").collect()} == {2, 3, 4}


def test_review_keeps_images_without_proposals(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image string")
    proposals = spark.createDataFrame([("a", 0.9, True), ("b", 0.9, True), ("b", 0.2, False)], "image string, confidence double, high boolean")
    assert [r.image for r in review.in_review_order(review.review_queue(images, proposals)).collect()] == ["c", "b", "a"]


def test_sides_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(compare, "ROWS_OF_A_TASK", 100)
    left, right = spark.range(2000).selectExpr("id", "id % 7 AS v"), spark.range(40, 2050).selectExpr("id", "if(id = 50, 9, id % 7) AS v")
    assert [x.rdd.getNumPartitions() for x in compare._by_key(left, right, "id")] == [21, 21]
    gaps = compare.set_difference(left, right, "id")
    assert {r.problem: r["count"] for r in gaps.groupBy("problem").count().collect()} == {"missing": 40, "unexpected": 50}
    assert [tuple(r) for r in compare.field_mismatches(left, right, "id", ["v"]).collect()] == [(50, "v", "1", "9")]
    monkeypatch.undo()
    assert compare._by_key(left, right, "id") == (left, right)
