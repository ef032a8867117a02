"""Proposals, their review, and what is promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An image's states, the most urgent first.
STATES = ("empty_prediction_review_required", "proposal_review_required", "high_confidence_candidates_still_require_review")


def review_queue(images: DataFrame, proposals: DataFrame) -> DataFrame:
    """image, proposals, high_confidence, review_required, min_confidence, max_confidence, image_status, priority: of every
    image, also without proposals (image, confidence, high)."""
    counts = proposals.groupBy("image").agg(
        F.count("*").alias("proposals"), F.count_if("high").alias("high_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence")
    )
    rows = images.select("image").join(counts, "image", "left").fillna(0, ["proposals", "high_confidence"])
    state = F.when(F.col("proposals") == 0, STATES[0]).when(F.col("high_confidence") < F.col("proposals"), STATES[1]).otherwise(STATES[2])
    rows = rows.withColumn("review_required", F.col("proposals") - F.col("high_confidence")).withColumn("image_status", state)
    return rows.withColumn("priority", F.array_position(F.array(*map(F.lit, STATES)), F.col("image_status")) - 1)


def in_review_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy("priority", F.coalesce("min_confidence", F.lit(-1.0)), "image")


def funnel(rows: DataFrame, reasons: list[Column]) -> DataFrame:
    """rows with reason: the first of the reasons that isn't null; null: accepted."""
    return rows.withColumn("reason", F.coalesce(*reasons))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def promoted(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Annotations of the images whose disposition is include. decisions: image, disposition."""
    return annotations.join(decisions.where(F.col("disposition") == "include"), "image", "left_semi")


def disposition_problems(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """image, problem: included without an annotation, or marked empty with one."""
    counts = annotations.groupBy("image").agg(F.count("*").alias("n"))
    rows = decisions.join(counts, "image", "left").fillna(0, ["n"])
    why = F.when((F.col("disposition") == "include") & (F.col("n") == 0), "included_without_annotation").when((F.col("disposition") == "empty") & (F.col("n") > 0), "empty_with_annotation")
    return rows.select("image", why.alias("problem")).where("problem is not null")


def resolved_members(references: DataFrame, members: DataFrame) -> DataFrame:
    """reference, member, status: a path beside the annotation (base), else as it is, else by a basename that only one
    member has. references: reference, base; members: member."""
    name = F.element_at(F.split("member", "/"), -1)
    unique = members.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("member").alias("by_name"))
    beside = members.select(F.col("member").alias("beside"))
    plain = members.select(F.col("member").alias("plain"))
    rows = references.withColumn("near", F.when(F.col("base") != "", F.concat_ws("/", "base", "reference")).otherwise(F.col("reference")))
    rows = rows.join(beside, F.col("near") == F.col("beside"), "left").join(plain, F.col("reference") == F.col("plain"), "left")
    rows = rows.withColumn("name", F.element_at(F.split("reference", "/"), -1)).join(unique, "name", "left")
    member = F.coalesce("beside", "plain", F.when(F.col("n") == 1, F.col("by_name")))
    status = F.when(member.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return rows.select("reference", member.alias("member"), status.alias("status"))
