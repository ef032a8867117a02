"""Device samples, camera frames and resumable collection as streams. Each function also takes a batch table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def device_summary(samples: DataFrame, key: str, at: str, value: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """key, window_start, n, max_value, mean_value per window of event time; later rows than `late` are left out of a stream."""
    rows = samples.withWatermark(at, late) if samples.isStreaming else samples
    grouped = rows.groupBy(key, F.window(at, window).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))
    return grouped.select(key, F.col("w.start").alias("window_start"), "n", "max_value", "mean_value")


def new_items(found: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a stream forgets keys after `late`."""
    return found.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if found.isStreaming else found.dropDuplicates([key])


def not_yet_collected(found: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return found.join(history.select(key), key, "left_anti")


def epoch_means(steps: DataFrame, key: str, epoch: str, value: str) -> DataFrame:
    """key, epoch, n, mean_value: updated as steps arrive."""
    return steps.groupBy(key, epoch).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))


def measured_frames(frames: DataFrame, warmup: int) -> DataFrame:
    """camera, frame, latency_ms of a stream's (or table's) frames without the first `warmup` of each camera, as they come:
    a counter per camera is the state."""

    def after(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values("frame")
            keep = rows.iloc[max(0, warmup - seen) :]
            seen += len(rows)
            yield keep[["camera", "frame", "latency_ms"]]
        state.update((seen,))

    rows = frames.select(F.col("camera").cast("long"), F.col("frame").cast("long"), F.col("latency_ms").cast("double"))
    return rows.groupBy("camera").applyInPandasWithState(after, "camera long, frame long, latency_ms double", "seen long", "append", GroupStateTimeout.NoTimeout)


def frames_behind_warmup(frames: DataFrame, warmup: int) -> DataFrame:
    """The rows of a table of camera, frame and more without the first `warmup` of each camera: what measured_frames leaves
    out of a stream. Only the first frames of a camera are put in order, so a camera with most of the rows is no harder."""
    order = Window.partitionBy("camera").orderBy("frame")
    first = frames.select("camera", "frame").withColumn("place", F.row_number().over(order)).where(F.col("place") <= warmup)
    last = first.groupBy("camera").agg(F.max("frame").alias("__last"))
    return frames.join(last, "camera").where(F.col("frame") > F.col("__last")) if warmup > 0 else frames


def collection_gate(frames: DataFrame, warmup: int, least: int) -> DataFrame:
    """camera, frames, measured, status: PASS if at least `least` frames with a latency lie behind the warm-up."""
    counts = frames.groupBy("camera").agg(F.count("*").alias("frames"))
    measured = frames_behind_warmup(frames, warmup).groupBy("camera").agg(F.count("latency_ms").alias("measured"))
    both = counts.join(measured, "camera", "left").withColumn("measured", F.coalesce("measured", F.lit(0).cast("long")))
    return both.withColumn("status", F.when(F.col("measured") >= least, "PASS").otherwise("FAIL"))
