"""Greedy matches of predictions with targets, suppression, thresholds, confusion and average precision.

Boxes are rows of image_id, category, id, x, y, w, h; predictions also have score. Equal scores and equal overlaps are
settled by id: predictions ascending, targets descending."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemark.functions.geometry import iou_xywh, iou_xyxy, safe_ratio, wilson_lower, xywh_to_xyxy
from sievemark.operators import running
from sievemark.session import written

_BOX = ("x", "y", "w", "h")
# The status of a chosen threshold, and of none.
CHOSEN, NOT_AVAILABLE = "VALIDATION_DERIVED_PENDING_HUMAN_REVIEW", "NOT_AVAILABLE"


def _parts(b: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(b[k] for k in _BOX)  # type: ignore[return-value]


def top_per_image(predictions: DataFrame, most: int) -> DataFrame:
    """The best-scored predictions of each image."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "id")
    return predictions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _dealt(rows: DataFrame, spread: int) -> DataFrame:
    """The boxes of rows (x, y, w, h), a row for each cell that they touch: cells are as wide as the power of two over the
    box's longer side, and as the next `spread` powers. level: that of the cells; own: of the box."""
    own = F.ceil(F.log2(F.greatest("w", "h")) - 1e-9).cast("int")
    out = rows.withColumn("own", own).withColumn("level", F.explode(F.sequence("own", F.col("own") + spread)))
    for c, start, size in (("cell_x", "x", "w"), ("cell_y", "y", "h")):
        at = lambda v: F.floor(v / F.pow(F.lit(2.0), "level"))
        out = out.withColumn(c, F.explode(F.sequence(at(F.col(start)), at(F.col(start) + F.col(size)))))
    return out


def grid_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, l and r (structs of the rows' other columns): pairs that share the keys and whose boxes (x, y, w, h as doubles)
    may overlap by at least `least`, a share of their union above 0; each pair once.

    Boxes that overlap so much have sides whose ratio is at least that share, so a pair is looked for in cells of the larger
    box's level alone, and kept only in the cell of the upper left corner of what they share. A box touches few cells, so what
    meets goes with how many boxes lie near one another, not with the square of a group. Boxes without a size or with
    coordinates that aren't finite overlap nothing."""
    spread = math.ceil(math.log2(1 / least) + 1e-6)
    finite = " AND ".join([*(f"abs({c}) < double('infinity')" for c in _BOX), "w > 0", "h > 0"])

    def side(rows: DataFrame, name: str) -> DataFrame:
        return _dealt(rows.where(finite), spread).select(*keys, "level", "cell_x", "cell_y", F.struct("own", *[c for c in rows.columns if c not in keys]).alias(name))

    both = side(left, "l").join(side(right, "r"), [*keys, "level", "cell_x", "cell_y"])
    corner = lambda c: F.floor(F.greatest(f"l.{c}", f"r.{c}") / F.pow(F.lit(2.0), "level"))
    once = (F.greatest("l.own", "r.own") == F.col("level")) & (corner("x") == F.col("cell_x")) & (corner("y") == F.col("cell_y"))
    return both.where(once).select(*keys, "l", "r")


def iou_pairs(targets: DataFrame, predictions: DataFrame, keys: list[str], least: float = 0.0, large: int | None = None) -> DataFrame:
    """keys, target_id, prediction_id, iou of the pairs that share the keys and overlap by at least `least`. All pairs of a
    group are looked at where it is small, or where `least` is 0, as then all are asked for; those of groups of more than
    `large` boxes (LARGE) come from a grid."""
    if least <= 0:
        return _plain_pairs(targets, predictions, keys, least)
    small, big = _by_size(keys, [targets, predictions], LARGE if large is None else large)
    pairs = _plain_pairs(*small, keys, least)
    return pairs if big is None else pairs.unionByName(_near_pairs(*big, keys, least))


def _plain_pairs(targets: DataFrame, predictions: DataFrame, keys: list[str], least: float) -> DataFrame:
    side = lambda rows, p: rows.select(*keys, F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in _BOX])
    both = side(targets, "target").join(side(predictions, "prediction"), keys)
    boxes = [tuple(F.col(f"{p}_{c}") for c in _BOX) for p in ("prediction", "target")]
    return both.withColumn("iou", iou_xywh(*boxes)).where(F.col("iou") >= least).select(*keys, "target_id", "prediction_id", "iou")


def _near_pairs(targets: DataFrame, predictions: DataFrame, keys: list[str], least: float) -> DataFrame:
    side = lambda rows: rows.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in _BOX])
    both = grid_pairs(side(targets), side(predictions), keys, least).select(*keys, F.col("l.id").alias("target_id"), F.col("r.id").alias("prediction_id"), iou_xywh(_parts(F.col("r")), _parts(F.col("l"))).alias("iou"))
    return both.where(F.col("iou") >= least)


#: Groups of more boxes than this are matched and suppressed by rounds over overlapping pairs; smaller ones by a fold of arrays.
LARGE = 2000
_ROUNDS = 6


def _by_size(keys: list[str], sides: list[DataFrame], large: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The rows of groups of up to `large` boxes, and those of larger groups (None if there are none)."""
    counts = None
    for rows in sides:
        own = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        counts = own if counts is None else counts.unionByName(own)
    big = written(counts.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > large).select(*keys), "large")
    if big.isEmpty():
        return sides, None
    return [rows.join(big, keys, "left_anti") for rows in sides], [rows.join(big, keys, "left_semi") for rows in sides]


def _settled_pairs(pairs: DataFrame, keys: list[str], rounds: int = _ROUNDS) -> DataFrame:
    """keys, prediction_id, target_id that greedy matching takes, of candidate pairs (with iou and score).

    As all targets prefer the better prediction, what the greedy order gives is the one stable matching: in each round every
    prediction asks for the target that it likes best, and every target turns down all that come behind the best one that
    asked. If after some rounds there still are refusals, as among boxes that are all alike, the pairs left in those groups
    are settled in order, a group in a task."""
    wish = F.max(F.struct("iou", "target_id", "score")).alias("b")
    rank = F.struct((-F.col("score")).alias("s"), F.col("prediction_id").alias("p"))
    asked = lambda rows: rows.groupBy(*keys, "prediction_id").agg(wish).select(*keys, "prediction_id", "b.target_id", "b.score")
    pairs, before = written(pairs, "pairs"), None
    for _ in range(rounds):
        held = asked(pairs).groupBy(*keys, "target_id").agg(F.min(rank).alias("held"))
        pairs = written(pairs.join(held, [*keys, "target_id"], "left").where(F.col("held").isNull() | (rank <= F.col("held"))).drop("held"), "pairs")
        now = pairs.count()
        if now == before:
            break
        before = now
    first = written(asked(pairs), "asked")
    twice = first.groupBy(*keys, "target_id").agg(F.count("*").alias("n")).where("n > 1").select(*keys).distinct()
    rest = pairs.join(twice, keys, "left_semi")

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "prediction_id", "iou", "target_id"], ascending=[False, True, False, False])
        used, seen, kept = set(), set(), []
        for at, (p, t) in enumerate(zip(rows["prediction_id"], rows["target_id"], strict=True)):
            if p not in seen and t not in used:
                seen.add(p)
                used.add(t)
                kept.append(at)
        return rows.iloc[kept][[*keys, "prediction_id", "target_id"]]

    schema = StructType([pairs.schema[c] for c in [*keys, "prediction_id", "target_id"]])
    return first.join(twice, keys, "left_anti").select(schema.names).unionByName(rest.groupBy(*keys).applyInPandas(in_order, schema))


def _large_matches(targets: DataFrame, predictions: DataFrame, keys: list[str], match_iou: float) -> DataFrame:
    """What matches() gives, for groups of any size."""
    pairs = _near_pairs(targets, predictions, keys, match_iou)
    scores = predictions.select(*keys, F.col("id").alias("prediction_id"), F.col("score").cast("double").alias("score"))
    taken = _settled_pairs(pairs.join(scores, [*keys, "prediction_id"]), keys)
    kinds = targets.select(*keys, F.col("id").alias("target_id"), F.col("category").alias("target_category")) if "category" not in keys else None
    taken = taken.withColumn("target_category", F.col("category")) if kinds is None else taken.join(kinds, [*keys, "target_id"])
    own = predictions.select(*[F.col(c).alias(c) for c in dict.fromkeys([*keys, "category"])], "id", F.col("score").cast("double").alias("score"))
    joined = own.join(taken.withColumnRenamed("prediction_id", "id"), [*keys, "id"], "left")
    return joined.withColumn("tp", F.col("target_id").isNotNull().cast("int"))


def matches(targets: DataFrame, predictions: DataFrame, keys: list[str], match_iou: float = 0.5, large: int = LARGE) -> DataFrame:
    """keys, category, id, score, tp, target_id, target_category: a row for each prediction, matched as in greedy_match."""
    columns = [*dict.fromkeys([*keys, "category"]), "id", "score", "tp", "target_id", "target_category"]
    if match_iou <= 0:
        raise ValueError("match_iou must be positive")
    small, big = _by_size(keys, [targets, predictions], large)
    folded = greedy_match(*small, keys, match_iou).select(*keys, F.explode("matches").alias("m"))
    rows = folded.select(*[F.col(c) if c in keys else F.col(f"m.{c}") for c in columns])
    return rows if big is None else rows.unionByName(_large_matches(*big, keys, match_iou).select(columns))


def greedy_match(targets: DataFrame, predictions: DataFrame, keys: list[str], match_iou: float = 0.5) -> DataFrame:
    """keys, n_targets, matches (array of id, score, category, tp, target_id, target_category by falling score): each
    prediction takes the target of its group that it overlaps most and that no better one took, if by match_iou (which
    must be positive). One fold over a group's arrays, without Python."""
    if match_iou <= 0:
        raise ValueError("match_iou must be positive")
    own = ["id", "category", *_BOX]
    gts = targets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("gts"))
    ranked = F.struct((-F.col("score")).alias("rank"), *own, "score")
    prs = predictions.groupBy(*keys).agg(F.array_sort(F.collect_list(ranked)).alias("prs"))
    kind = {f.name: f.dataType.simpleString() for f in gts.schema.fields} | {f.name: f.dataType.simpleString() for f in prs.schema.fields}
    groups = gts.join(prs, keys, "full").select(*keys, *[F.coalesce(c, F.array().cast(kind[c])).alias(c) for c in ("gts", "prs")])
    item = targets.schema["id"].dataType.simpleString(), targets.schema["category"].dataType.simpleString()
    found = f"array<struct<id:{predictions.schema['id'].dataType.simpleString()},score:double,category:{item[1]},tp:int,target_id:{item[0]},target_category:{item[1]}>>"
    start = F.struct(F.array().cast(f"array<{item[0]}>").alias("used"), F.array().cast(found).alias("matches"))

    def step(state: Column, p: Column) -> Column:
        free = F.filter("gts", lambda g: ~F.array_contains(state["used"], g["id"]))
        best = F.array_max(F.transform(free, lambda g: F.struct(iou_xywh(_parts(p), _parts(g)).alias("iou"), g["id"].alias("id"), g["category"].alias("category"))))

        def outcome(b: Column) -> Column:
            hit = F.coalesce(b["iou"] >= match_iou, F.lit(False))
            row = F.struct(
                p["id"].alias("id"),
                p["score"].cast("double").alias("score"),
                p["category"].alias("category"),
                hit.cast("int").alias("tp"),
                F.when(hit, b["id"]).alias("target_id"),
                F.when(hit, b["category"]).alias("target_category"),
            )
            used = F.when(hit, F.concat(state["used"], F.array(b["id"]))).otherwise(state["used"])
            return F.struct(used.alias("used"), F.concat(state["matches"], F.array(row)).cast(found).alias("matches"))

        return F.element_at(F.transform(F.array(best), outcome), 1)

    folded = F.aggregate("prs", start, step, lambda s: s["matches"])
    return groups.select(*keys, F.size("gts").cast("long").alias("n_targets"), folded.alias("matches"))


def outcomes(targets: DataFrame, predictions: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """image_id, category, id, score, tp, target_id: a row for each prediction."""
    return matches(targets, predictions, ["image_id", "category"], match_iou).drop("target_category")


def match_counts(targets: DataFrame, predictions: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """category, tp, fp, fn."""
    found = outcomes(targets, predictions, match_iou).groupBy("category").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    both = found.join(targets.groupBy("category").agg(F.count("*").alias("n_targets")), "category", "full")
    tp, n, total = (F.coalesce(c, F.lit(0).cast("long")) for c in ("tp", "n", "n_targets"))
    return both.select("category", tp.alias("tp"), (n - tp).alias("fp"), (total - tp).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1 and the Wilson bound of precision."""
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = counts.withColumn("precision", p).withColumn("recall", r)
    rows = rows.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rows.withColumn("precision_wilson_lower_95", wilson_lower(F.col("tp"), F.col("tp") + F.col("fp")))


def threshold_sweep(targets: DataFrame, predictions: DataFrame, match_iou: float = 0.5, steps: int = 100) -> DataFrame:
    """curve_of the outcomes of a match."""
    return curve_of(outcomes(targets, predictions, match_iou), targets, steps)


def curve_of(found: DataFrame, targets: DataFrame, steps: int = 100) -> DataFrame:
    """category (null: all), confidence, tp, fp, fn and rates at confidences i * (1 / steps). found: outcomes.

    A prediction's match depends on better ones only, so one match serves all thresholds: each outcome falls into the
    last threshold that it reaches, and counts are summed from the top. Groups are categories by thresholds, few."""
    spark = targets.sparkSession
    found = found.select("category", "score", "tp")
    grid = spark.range(steps + 1).select((F.col("id") * F.lit(1.0 / steps)).alias("confidence"), F.col("id").cast("int").alias("step"))
    # The grid's own values are compared, as i * 0.01 isn't i / 100 for some i.
    near = F.least(F.lit(steps), F.floor(F.col("score") * steps).cast("int") + 1)
    value = lambda i: i.cast("double") * F.lit(1.0 / steps)
    reached = F.when(F.col("score") >= value(near), near).when(F.col("score") >= value(near - 1), near - 1).otherwise(near - 2)
    binned = found.withColumn("step", reached).where("step >= 0").groupBy("category", "step").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    kinds = targets.groupBy("category").agg(F.count("*").alias("n_targets"))
    categories = kinds.select("category").union(found.select("category")).distinct()
    cells = categories.join(F.broadcast(grid)).join(binned, ["category", "step"], "left").join(kinds, "category", "left")
    cells = cells.select("category", "step", "confidence", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "n", "n_targets")])
    total = cells.groupBy("step", "confidence").agg(*[F.sum(c).alias(c) for c in ("tp", "n", "n_targets")])
    cells = cells.unionByName(total.withColumn("category", F.lit(None).cast("string")))
    down = Window.partitionBy("category").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.sum("tp").over(down), F.sum("n").over(down)
    rows = cells.select("category", "confidence", tp.alias("tp"), (n - tp).alias("fp"), (F.col("n_targets") - tp).alias("fn"))
    return rates(rows)


def choose_threshold(curve: DataFrame, target: float, least_bound: float) -> DataFrame:
    """The row of each category with the highest recall, then precision, then lowest confidence, among those that reach
    the target precision and bound; status NOT_AVAILABLE, and nulls, where none does."""
    fit = (F.col("tp") > 0) & (F.col("precision") >= target) & (F.col("precision_wilson_lower_95") >= least_bound)
    fields = ["confidence", "precision", "precision_wilson_lower_95", "recall", "f1", "tp", "fp", "fn"]
    best = F.max_by(F.struct(*fields), F.when(fit, F.struct("recall", "precision", -F.col("confidence"))))
    grouped = curve.groupBy("category").agg(F.max(fit).alias("some"), best.alias("b"))
    status = F.when(F.col("some"), CHOSEN).otherwise(NOT_AVAILABLE)
    return grouped.select("category", status.alias("status"), *[F.when(F.col("some"), F.col(f"b.{c}")).alias(c) for c in fields])


def best_f1(curve: DataFrame) -> DataFrame:
    """The row of each category with the highest F1, the lowest confidence among equals."""
    best = F.max_by(F.struct("confidence", "f1"), F.struct("f1", -F.col("confidence")))
    return curve.groupBy("category").agg(best.alias("b")).select("category", "b.confidence", "b.f1")


def confusion(targets: DataFrame, predictions: DataFrame, match_iou: float = 0.5, background: str = "background") -> DataFrame:
    """true, predicted, n, share (of the true class): matches within an image whatever the category; what has no match
    stands against the background."""
    found = matches(targets, predictions, ["image_id"], match_iou)
    cells = written(found.groupBy(F.col("target_category").alias("true"), F.col("category").alias("predicted")).agg(F.count("*").alias("n")), "cells")
    took = cells.where("true is not null").groupBy("true").agg(F.sum("n").alias("taken"))
    all_of = targets.groupBy(F.col("category").alias("true")).agg(F.count("*").alias("total")).join(took, "true", "left")
    missed = all_of.select("true", F.lit(background).alias("predicted"), (F.col("total") - F.coalesce("taken", F.lit(0))).alias("n")).where("n > 0")
    rows = cells.withColumn("true", F.coalesce("true", F.lit(background))).unionByName(missed).groupBy("true", "predicted").agg(F.sum("n").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def _large_suppressed(boxes: DataFrame, iou: float, strict: bool, keys: list[str], rounds: int = _ROUNDS) -> DataFrame:
    """keys, id of the boxes that stay, for groups of any size: of the undecided, those that no better one overlaps stay and
    those that they overlap go, round by round; what is left then is decided in order, a group and category in a task."""
    kind = "float" if strict else "double"
    corners = lambda b: xywh_to_xyxy(tuple(x.cast(kind) for x in _parts(b)))
    own = [*keys, "category"]
    rows = written(boxes.select(*own, "id", "score", *[F.col(c).cast("double").alias(c) for c in _BOX]), "boxes")
    # 32 bits may round an overlap up to the limit, so the grid looks a little below it.
    pairs = grid_pairs(rows, rows, own, min(1.0, iou) * (1 - 1e-5))
    rank = lambda b: F.struct((-F.col(f"{b}.score")).alias("s"), F.col(f"{b}.id").alias("i"))
    overlap, limit = iou_xyxy(corners(F.col("l")), corners(F.col("r"))).cast(kind), F.lit(iou).cast(kind)
    pairs = pairs.where((rank("l") < rank("r")) & ((overlap > limit) if strict else (overlap >= limit)))
    pairs = written(pairs.select(*own, F.col("l.id").alias("better"), F.col("r.id").alias("worse")), "overlaps")
    gone = None
    for _ in range(rounds):
        if pairs.isEmpty():
            break
        worse = pairs.select(*own, F.col("worse").alias("better")).distinct()
        stay = pairs.select(*own, "better").distinct().join(worse, [*own, "better"], "left_anti")
        out = written(pairs.join(stay, [*own, "better"], "left_semi").select(*own, F.col("worse").alias("id")).distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        left = lambda rows, c: rows.join(out.withColumnRenamed("id", c), [*own, c], "left_anti")
        pairs = written(left(left(pairs, "better"), "worse"), "overlaps")

    def in_order(x: pd.DataFrame) -> pd.DataFrame:
        better: dict = {}
        for b, w in zip(x["better"], x["worse"], strict=True):
            better.setdefault(w, []).append(b)
        lost: set = set()
        for w in x.sort_values("place")["worse"].drop_duplicates():
            if any(b not in lost for b in better[w]):
                lost.add(w)
        return x[x["worse"].isin(lost)].drop_duplicates("worse")[[*own, "worse"]].rename(columns={"worse": "id"})

    if not pairs.isEmpty():
        scores = rows.select(*own, F.col("id").alias("worse"), "score")
        order = Window.partitionBy(*own).orderBy(F.desc("score"), "worse")
        rest = pairs.join(scores, [*own, "worse"]).withColumn("place", F.dense_rank().over(order))
        out = rest.groupBy(*own).applyInPandas(in_order, StructType([rows.schema[c] for c in [*own, "id"]]))
        gone = out if gone is None else gone.unionByName(out)
    kept = rows if gone is None else rows.join(gone, [*own, "id"], "left_anti")
    return kept.select(*keys, "id", "score")


def suppress(boxes: DataFrame, iou: float, strict: bool, keys: list[str], most: int | None = None, large: int = LARGE) -> DataFrame:
    """keys, id of the boxes that stay: by falling score, a box goes if it overlaps one that stayed, of its category, by at
    least `iou` (or more than it, if strict). Overlaps are those of corners, so a box without a size has no area; strict ones
    are reckoned in 32 bits. most: so many stay, the best. A fold over each group's array, or rounds over the overlapping
    pairs of a large group (ids are unique within one)."""
    small, big = ([boxes], None) if iou <= 0 else _by_size(keys, [boxes], large)
    out = _folded_suppressed(small[0], iou, strict, keys, most)
    if big is None:
        return out
    kept = _large_suppressed(big[0], iou, strict, keys)
    if most:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        kept = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return out.unionByName(kept.select(*keys, "id"))


def _folded_suppressed(boxes: DataFrame, iou: float, strict: bool, keys: list[str], most: int | None) -> DataFrame:
    kind_of = "float" if strict else "double"
    corners = lambda k: xywh_to_xyxy(tuple(x.cast(kind_of) for x in _parts(k)))
    limit = F.lit(iou).cast(kind_of)
    ranked = F.struct((-F.col("score")).alias("rank"), "id", "category", *_BOX)
    groups = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(ranked)).alias("all"))
    kind = groups.schema["all"].dataType.simpleString()

    def step(kept: Column, b: Column) -> Column:
        def covers(k: Column) -> Column:
            overlap = iou_xyxy(corners(k), corners(b)).cast(kind_of)
            return (k["category"] == b["category"]) & ((overlap > limit) if strict else (overlap >= limit))

        return F.when(F.exists(kept, covers), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.array().cast(kind), step)
    return groups.select(*keys, F.explode(F.slice(kept, 1, most) if most else kept).alias("k")).select(*keys, "k.id")


AP_IOUS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
_AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


#: A cell is one of the area ranges at one of the overlaps; a prediction's outcomes are a bit for each.
_CELLS = [(area, t) for area in _AREAS for t in AP_IOUS]
_MOST_PLACES, _MOST_HELD = 100, 4 << 20


def _bits(cells: np.ndarray) -> np.ndarray:
    return cells @ (1 << np.arange(len(_CELLS), dtype=np.int64))


def _coco_matches(rows: pd.DataFrame) -> pd.DataFrame:
    """category, image_id, id, score, place (from 1), tp, counted of the best predictions of every image and category: bits of
    the cells in which it takes a target, and of those in which it counts.

    A target outside of the range is ignored, and so is a prediction that takes one, or takes none and is itself outside.
    Each takes the free target that it overlaps most, counted ones before ignored ones, the highest id among equals. Groups
    of alike many targets are matched side by side: the first prediction of each, then the second."""
    group = rows.groupby(["image_id", "category"], dropna=False, sort=False).ngroup().to_numpy()
    rows = rows.assign(group=group)
    gts = rows[rows["is_gt"]].sort_values("id", ascending=False)
    prs = rows[~rows["is_gt"]].sort_values(["score", "id"], ascending=[False, True])
    place = prs.groupby("group").cumcount().to_numpy()
    prs, place = prs[place < _MOST_PLACES], place[place < _MOST_PLACES]
    slot, g_of, p_of = gts.groupby("group").cumcount().to_numpy(), gts["group"].to_numpy(), prs["group"].to_numpy()
    n = int(group.max()) + 1 if len(group) else 0
    n_gt, n_pr = np.bincount(g_of, minlength=n), np.bincount(p_of, minlength=n)
    g, p = gts[list(_BOX)].to_numpy(float), prs[list(_BOX)].to_numpy(float)
    bounds, least = np.array([_AREAS[a] for a, _ in _CELLS]), np.array([t for _, t in _CELLS])
    beyond = lambda area: (area[..., None] < bounds[:, 0]) | (area[..., None] > bounds[:, 1])
    outside = beyond(p[:, 2] * p[:, 3])
    tp, counted = np.zeros((len(p), len(_CELLS)), bool), ~outside
    order = np.flatnonzero((n_pr > 0) & (n_gt > 0))
    order = order[np.argsort(n_gt[order], kind="stable")]
    local, at = np.full(n, -1), 0
    while at < len(order):
        # Sorted by their targets: no more groups than what the largest one lets be held.
        to = at + 1
        while to < len(order) and (to + 1 - at) * int(n_gt[order[to]]) * len(_CELLS) <= _MOST_HELD:
            to += 1
        own, at = order[at:to], to
        local[own] = np.arange(len(own))
        some, mine = np.flatnonzero(local[g_of] >= 0), np.flatnonzero(local[p_of] >= 0)
        held = np.full((len(own), int(n_gt[own].max()), 4), np.nan)
        held[local[g_of[some]], slot[some]] = g[some]
        row = np.full((len(own), int(n_pr[own].clip(max=_MOST_PLACES).max())), -1)
        row[local[p_of[mine]], place[mine]] = mine
        local[own] = -1
        ignored = np.ascontiguousarray(beyond(held[:, :, 2] * held[:, :, 3]).transpose(0, 2, 1))
        free = np.ones(ignored.shape, bool)
        for d in range(row.shape[1]):
            now = np.flatnonzero(row[:, d] >= 0)
            one, boxes = row[now, d], held[now]
            box = p[one][:, None]
            common = np.clip(np.minimum(box[..., :2] + box[..., 2:], boxes[..., :2] + boxes[..., 2:]) - np.maximum(box[..., :2], boxes[..., :2]), 0, None).prod(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                ious = (common / (box[..., 2] * box[..., 3] + boxes[..., 2] * boxes[..., 3] - common))[:, None, :]
                open_ = free[now] & (ious >= least[:, None])
            taken, hits = np.full((len(now), len(_CELLS)), -1), []
            for kind in (ignored[now], ~ignored[now]):
                overlap = np.where(open_ & ~kind, ious, -1.0)
                best = overlap.argmax(axis=2)
                hit = (np.take_along_axis(overlap, best[:, :, None], axis=2)[:, :, 0] >= 0) & (taken < 0)
                taken[hit] = best[hit]
                hits.append(hit)
            i, c = np.nonzero(taken >= 0)
            free[now[i], c, taken[i, c]] = False
            tp[one] = hits[0]
            counted[one] = hits[0] | (~hits[1] & ~outside[one])
    out = prs[["category", "image_id", "id", "score"]]
    return out.assign(place=place + 1, tp=_bits(tp), counted=_bits(counted))


def _cell_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a range of predictions, by cell: how many count, and how many of the first 1, 10, 100 of their image take a target."""
    place, out = rows["place"].to_numpy(), []
    for cell in range(len(_CELLS)):
        tp, counted = (rows[c].to_numpy() >> cell & 1 for c in ("tp", "counted"))
        out.append((cell, int(counted.sum()), *[int(tp[place <= k].sum()) for k in (1, 10, 100)]))
    return pd.DataFrame(out, columns=["cell", "seen", "tp1", "tp10", "tp100"]).assign(category=rows["category"].iloc[0], **{running.RANGE: rows[running.RANGE].iloc[0]})


def _cell_points(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """Of a range of predictions, by cell: its best precision (point -1), and for each recall that it is the first to reach the
    best one from there to its end. before: what the ranges ahead hold (tps, seen), and the targets (n)."""
    if not len(rows) or not len(before):
        return pd.DataFrame({"category": [], running.RANGE: [], "cell": [], "point": [], "best": []})
    rows = rows.sort_values(["score", "image_id", "id"], ascending=[False, True, True])
    hit, counts, points, out = rows["tp"].to_numpy(), rows["counted"].to_numpy(), np.arange(101) * 0.01, []
    for cell, tps, seen, n in zip(*(before[c].tolist() for c in ("cell", "tps", "seen", "n")), strict=True):
        own = (hit >> cell & 1)[counts >> cell & 1 == 1]
        if not len(own) or not n:
            continue
        upto = np.cumsum(own) + tps
        best = np.maximum.accumulate((upto / (seen + np.arange(1, len(own) + 1)))[::-1])[::-1]
        first = np.searchsorted(upto / n, points, side="left")
        new = np.flatnonzero((first < len(own)) & ((points > tps / n) | (seen == 0)))
        out.append(pd.DataFrame({"cell": cell, "point": [-1, *new], "best": [best[0], *best[first[new]]]}))
    found = pd.concat(out) if out else pd.DataFrame({"cell": [], "point": [], "best": []})
    return found.assign(category=rows["category"].iloc[0], **{running.RANGE: rows[running.RANGE].iloc[0]})


_BEST_FIRST = [("score", False), ("image_id", True), ("id", True)]


def curve_average(hits: DataFrame, totals: DataFrame, own: list[str]) -> DataFrame:
    """own, ap: the mean at 101 recalls of the best precision at any higher recall, of predictions (own, image_id, id, score,
    tp) and numbers of targets (n, by some of own). A curve may have any number of predictions: see running."""
    rows = hits.join(totals, [c for c in totals.columns if c != "n"]).where("n > 0")
    counted = running.running(running.in_ranges(rows, own, _BEST_FIRST), own, _BEST_FIRST, {"tps": F.col("tp").cast("long"), "seen": F.lit(1).cast("long")})
    precise = written(counted.withColumn("precision", F.col("tps") / F.col("seen")), "curve")
    best = running.running(precise, own, _BEST_FIRST, maxima_behind={"best": F.col("precision")})
    # A recall point takes the first place that reaches it; only hits, and the first place, reach any that none before did.
    recall, prior = F.col("tps") / F.col("n"), (F.col("tps") - F.col("tp")) / F.col("n")
    points = F.size(F.filter(F.sequence(F.lit(0), F.lit(100)), lambda i: (i * F.lit(0.01) <= recall) & ((F.col("seen") == 1) | (i * F.lit(0.01) > prior))))
    return best.where("tp = 1 OR seen = 1").groupBy(*own).agg((F.sum(F.col("best") * points) / 101).alias("ap"))


#: About so many boxes are matched at a time.
_DEAL = 20_000


def average_precision(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """category, area, iou, ap, ar1, ar10, ar100 by the published COCO definition: precision as the best at any higher
    recall, its mean at 101 recalls. Null without targets in the range, 0 without predictions.

    Images' categories are dealt to batches and matched side by side, for all overlaps and areas at once: a row for each
    prediction. A category's predictions are in ranges by score, of which only sums, maxima and recall points meet."""
    side = lambda rows, gt: rows.select("image_id", "category", F.col("id").cast("long"), *[F.col(c).cast("double") for c in _BOX], (F.lit(0.0) if gt else F.col("score").cast("double")).alias("score"), F.lit(gt).alias("is_gt"))
    rows = side(targets, True).unionByName(side(predictions, False)).where("category IS NOT NULL")
    image, kind = rows.schema["image_id"].dataType.simpleString(), rows.schema["category"].dataType.simpleString()
    deals = max(1, rows.count() // _DEAL)
    dealt = rows.groupBy(F.pmod(F.xxhash64("image_id", "category"), F.lit(deals)).alias("deal"))
    found = dealt.applyInPandas(_coco_matches, f"category {kind}, image_id {image}, id long, score double, place int, tp long, counted long")
    ranged = running.in_ranges(found, ["category"], _BEST_FIRST)
    own, cell = ["category", running.RANGE], ["category", "cell"]
    sums = written(ranged.groupBy(*own).applyInPandas(_cell_sums, f"category {kind}, {running.RANGE} int, cell int, seen long, tp1 long, tp10 long, tp100 long"), "sums")
    area = F.col("w") * F.col("h")
    inside = lambda a: F.col("is_gt") & (F.isnan(area) | ~((area < _AREAS[a][0]) | (area > _AREAS[a][1])))
    totals = rows.groupBy("category").agg(*[F.count_if(inside(a)).alias(a) for a in _AREAS])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(a).alias("area"), F.lit(t).alias("iou"), F.col(a).alias("n")) for i, (a, t) in enumerate(_CELLS)])).alias("c")
    grid = written(totals.select("category", each).select("category", "c.*"), "cells")
    ahead = Window.partitionBy(*cell).orderBy(running.RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.join(grid, cell).select(*own, "cell", "n", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(k) for k, c in (("tps", "tp100"), ("seen", "seen"))])
    points = written(ranged.groupBy(*own).cogroup(before.groupBy(*own)).applyInPandas(_cell_points, f"category {kind}, {running.RANGE} int, cell int, point int, best double"), "points")
    behind = Window.partitionBy(*cell).orderBy(F.desc(running.RANGE)).rangeBetween(Window.unboundedPreceding, -1)
    later = points.withColumn("later", F.max(F.when(F.col("point") < 0, F.col("best"))).over(behind)).where("point >= 0")
    curves = later.groupBy(*cell).agg((F.sum(F.greatest("best", "later")) / 101).alias("ap"))
    recalls = sums.groupBy(*cell).agg(*[F.sum(f"tp{k}").alias(f"tp{k}") for k in (1, 10, 100)])
    joined = grid.join(curves, cell, "left").join(recalls, cell, "left")
    some = lambda c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(0.0)))
    return joined.select("category", "area", "iou", some(F.col("ap")).alias("ap"), *[some(F.col(f"tp{k}") / F.nullif("n", F.lit(0))).alias(f"ar{k}") for k in (1, 10, 100)])


# The twelve summary figures, each a mean over categories (and overlaps, if not one of them) of a column.
STATS = {
    "ap50_95": ("ap", "all", None), "ap50": ("ap", "all", 0.5), "ap75": ("ap", "all", 0.75), "ap_small": ("ap", "small", None), "ap_medium": ("ap", "medium", None), "ap_large": ("ap", "large", None),
    "ar1": ("ar1", "all", None), "ar10": ("ar10", "all", None), "ar100": ("ar100", "all", None), "ar_small": ("ar100", "small", None), "ar_medium": ("ar100", "medium", None), "ar_large": ("ar100", "large", None),
}


def summary_stats(averages: DataFrame, some_predictions: Column) -> DataFrame:
    """name, value: the twelve figures of average_precision's rows; null without targets in the range, but 0 over all areas
    where there are no predictions either."""
    one = lambda c, area, iou: F.avg(F.when((F.col("area") == area) & (F.lit(True) if iou is None else F.col("iou") == iou), F.col(c)))
    wide = averages.agg(*[one(*x).alias(k) for k, x in STATS.items()])
    value = lambda k: F.col(k) if STATS[k][1] != "all" else F.coalesce(F.col(k), F.when(~some_predictions, 0.0))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), value(k).alias("value")) for k in STATS])).alias("s")).select("s.*")
