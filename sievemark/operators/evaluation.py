"""The whole evaluation of a detector on one part of a dataset, as one table of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.geometry import size_class
from sievemark.operators import matching
from sievemark.session import written

# Parts on which thresholds may be chosen, the one on which they may not, and what stands for a choice there.
CHOOSING, DIAGNOSTIC = ("validation", "val"), "test"
FORBIDDEN = "NOT_FOR_THRESHOLD_SELECTION"
MOST_PER_IMAGE = 100
_SCHEMA = ("section", "category", "against", "confidence", "name", "value", "status")


def _figures(rows: DataFrame, section: str, names: list[str], category: Column | None = None, against: Column | None = None, confidence: Column | None = None, status: Column | None = None) -> DataFrame:
    """A row for each of the named columns of each row."""
    null = F.lit(None)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    fixed = [F.lit(section), *[(null if c is None else c).cast(k) for c, k in ((category, "string"), (against, "string"), (confidence, "double"))]]
    out = rows.select(*[c.alias(n) for c, n in zip(fixed, _SCHEMA[:4], strict=True)], (null if status is None else status).cast("string").alias("status"), each.alias("f"))
    return out.select("section", "category", "against", "confidence", "f.name", "f.value", "status")


def operating_figures(targets: DataFrame, predictions: DataFrame, part: str, confidence: float = 0.25, match_iou: float = 0.5, target_precision: float = 0.98, least_bound: float = 0.95) -> DataFrame:
    """section, category, against, confidence, name, value, status: everything but average precision.

    metrics: counts and rates at the operating confidence, and the best F1 of the curve; per_class: the same by category;
    areas: targets by size; curve and class_curve: counts and rates at 101 confidences; calibration: the threshold chosen for
    all (category null) and for each category; confusion: n and share of a true category against a predicted one. Only the
    best predictions of each image take part. On the test part no threshold is chosen: no best F1, and statuses say so."""
    if part not in (*CHOOSING, DIAGNOSTIC):
        raise ValueError(f"unknown part: {part}")
    best = written(matching.top_per_image(predictions, MOST_PER_IMAGE).drop("rank"), "best")
    found = written(matching.outcomes(targets, best, match_iou), "outcomes")
    sizes = written(targets.groupBy("category").agg(F.count("*").alias("n"), *[F.count_if(size_class(F.col("w") * F.col("h")) == s).alias(s) for s in ("small", "medium", "large")]), "sizes")
    at = found.where(F.col("score") >= confidence).groupBy("category").agg(F.sum("tp").alias("tp"), F.count("*").alias("k"))
    at = found.select("category").union(sizes.select("category")).distinct().join(at, "category", "left").join(sizes, "category", "left")
    tp, k, n = (F.coalesce(c, F.lit(0).cast("long")) for c in ("tp", "k", "n"))
    classes = written(at.select("category", tp.alias("tp"), (k - tp).alias("fp"), (n - tp).alias("fn")), "classes")
    total = classes.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")])
    names = ["tp", "fp", "fn", "precision", "recall", "f1"]
    out = _figures(matching.rates(total), "metrics", names).unionByName(_figures(matching.rates(classes), "per_class", names, F.col("category")))
    areas = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("small", "medium", "large")])
    out = out.unionByName(_figures(areas, "areas", ["small", "medium", "large"]))
    curve = written(matching.curve_of(found, targets), "curve")
    section = F.when(F.col("category").isNull(), "curve").otherwise("class_curve")
    out = out.unionByName(_figures(curve, "curve", [*names, "precision_wilson_lower_95"], F.col("category"), None, F.col("confidence")).withColumn("section", section))
    cells = matching.confusion(targets, best.where(F.col("score") >= confidence), match_iou)
    out = out.unionByName(_figures(cells, "confusion", ["n", "share"], F.col("true"), F.col("predicted")))
    if part in CHOOSING:
        top = matching.best_f1(curve.where("category is null")).select(F.col("f1").alias("best_f1"), F.col("confidence").alias("best_f1_confidence"))
        chosen = matching.choose_threshold(curve, target_precision, least_bound)
        told = _figures(chosen, "calibration", ["confidence", *names, "precision_wilson_lower_95"], F.col("category"), status=F.col("status"))
        return out.unionByName(_figures(top, "metrics", ["best_f1", "best_f1_confidence"])).unionByName(told)
    none = curve.select("category").distinct().withColumn("confidence", F.lit(None).cast("double"))
    return out.unionByName(_figures(none, "calibration", ["confidence"], F.col("category"), status=F.lit(FORBIDDEN)))


def average_figures(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """The twelve summary figures (section metrics), and each category's mean average precision over all overlaps (section
    per_class, 0 without targets), in the columns of operating_figures. All predictions take part; COCO's own limit holds."""
    averages = written(matching.average_precision(targets, predictions), "averages")
    some = not predictions.isEmpty()
    stats = matching.summary_stats(averages, F.lit(some))
    null = lambda kind: F.lit(None).cast(kind)
    overall = stats.select(F.lit("metrics").alias("section"), null("string").alias("category"), null("string").alias("against"), null("double").alias("confidence"), "name", "value", null("string").alias("status"))
    kinds = targets.select("category").union(predictions.select("category")).distinct()
    own = averages.where("area = 'all'").groupBy("category").agg(F.avg("ap").alias("mean"))
    classes = kinds.join(own, "category", "left").select("category", F.coalesce("mean", F.lit(0.0)).alias("ap50_95"))
    return overall.unionByName(_figures(classes, "per_class", ["ap50_95"], F.col("category")))


def full_evaluation(targets: DataFrame, predictions: DataFrame, part: str, **settings: float) -> DataFrame:
    """operating_figures and average_figures in one table."""
    return operating_figures(targets, predictions, part, **settings).unionByName(average_figures(targets, predictions))
