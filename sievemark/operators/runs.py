"""Runs' documents as one row a run, and models' aggregates of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators import exact

# The columns of the comparison, in order, by the document that they come from and their place in it.
_METRICS = ("ap50_95", "ap50", "ap75", "ap_small", "ap_medium", "ap_large", "ar100", "precision", "recall", "f1", "tp", "fp", "fn", "best_f1", "best_f1_confidence")
_PLACES = {
    "params": ("manifest", "$.model_details.parameters"), "checkpoint_mib": ("manifest", "$.best_checkpoint.mib"),
    "latency_p50_ms": ("latency", "$.e2e_p50_ms"), "latency_p95_ms": ("latency", "$.e2e_p95_ms"), "fps": ("latency", "$.sustained_fps"),
    "system_peak_gpu_memory_mib": ("gpu", "$.peak_memory_used_mib"), "seed": ("manifest", "$.protocol.seed"),
    "dataset_sha256": ("manifest", "$.dataset.val_annotation_sha256"), "protocol_sha256": ("manifest", "$.protocol_config.sha256"),
}
COLUMNS = (
    "run_id", "model", "status", *_METRICS, "params", "checkpoint_mib", "latency_p50_ms", "latency_p95_ms", "fps", "peak_gpu_memory_mib",
    "system_peak_gpu_memory_mib", "train_elapsed_s", "seed", "dataset_sha256", "protocol_sha256",
)
AGGREGATED = ("ap50_95", "ap50", "ap75", "ap_small", "ap_medium", "ap_large", "ar100", "precision", "recall", "f1", "latency_p50_ms", "latency_p95_ms", "fps", "peak_gpu_memory_mib", "train_elapsed_s")
_FROM_EPOCHS = {"ap50": "map50", "ap50_95": "map50_95", "precision": "precision", "recall": "recall"}
_WHOLE = {"tp", "fp", "fn", "params", "seed"}
DOCUMENTS = ("manifest", "metrics", "latency", "gpu")


def _kind(name: str) -> str:
    return "string" if name.endswith("_sha256") else "long" if name in _WHOLE else "double"


def _has(document: str, name: str) -> Column:
    """Whether the document names it, be it as null."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.col(document)), name), F.lit(False))


def run_rows(documents: DataFrame, epochs: DataFrame, extra: DataFrame) -> DataFrame:
    """The 29 columns of COLUMNS, a row for each run.

    documents: run (its folder's name) and the JSON texts manifest, metrics, latency and gpu (null where a run has none);
    metrics holds the figures under `metrics`, or else `metrics_common`. epochs: run, epoch, elapsed_s, map50, map50_95,
    precision, recall, gpu_peak_allocated_mib, train_peak_allocated_mib; extra: run, line, epoch_peak_allocated_mib,
    train_peak_allocated_mib. A figure that the metrics don't name comes from the last epoch, one that they name as null
    stays null. Peaks come from the last epoch, then from the last extra line, and that of training before that of epochs;
    zero counts as none."""
    last = epochs.groupBy("run").agg(F.max_by(F.struct("elapsed_s", *dict.fromkeys(_FROM_EPOCHS.values()), "gpu_peak_allocated_mib", "train_peak_allocated_mib"), "epoch").alias("last"))
    more = extra.groupBy("run").agg(F.max_by(F.struct("epoch_peak_allocated_mib", "train_peak_allocated_mib"), "line").alias("more"))
    figures = F.coalesce(F.get_json_object("metrics", "$.metrics"), F.get_json_object("metrics", "$.metrics_common"), F.lit("{}"))
    rows = documents.withColumn("figures", figures).join(last, "run", "left").join(more, "run", "left")
    some = lambda *cs: F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in cs])
    found: dict[str, Column] = {
        "run_id": F.coalesce(F.get_json_object("manifest", "$.run_id"), F.col("run")),
        "model": F.coalesce(F.get_json_object("manifest", "$.model"), F.get_json_object("manifest", "$.framework"), F.col("run")),
        "status": F.coalesce(F.get_json_object("manifest", "$.status"), F.lit("unknown")),
        "peak_gpu_memory_mib": some(F.col("last.train_peak_allocated_mib"), F.col("more.train_peak_allocated_mib"), F.col("last.gpu_peak_allocated_mib"), F.col("more.epoch_peak_allocated_mib")),
        "train_elapsed_s": F.col("last.elapsed_s").cast("double"),
    }
    for name in _METRICS:
        own = F.get_json_object("figures", f"$.{name}").cast(_kind(name))
        found[name] = F.when(_has("figures", name), own).otherwise(F.col(f"last.{_FROM_EPOCHS[name]}").cast("double")) if name in _FROM_EPOCHS else own
    for name, (document, place) in _PLACES.items():
        found[name] = F.get_json_object(document, place).cast(_kind(name))
    return rows.select(*[found[c].alias(c) for c in COLUMNS])


def repeated_runs(rows: DataFrame) -> DataFrame:
    """run_id, n of those that several rows have: a comparison takes each run once."""
    return rows.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1")


def aggregates(rows: DataFrame) -> DataFrame:
    """model, runs, and {metric}_mean, {metric}_std of 15 metrics, by exact sums (see exact.exact_moments)."""
    return exact.aggregate_runs(rows, AGGREGATED)
