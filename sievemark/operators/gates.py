"""Rule tables of releases and promotions: every broken rule is a row, and a gate passes if there is none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions import text
from sievemark.operators import compare

# Settings that compared runs share, with what a run has that doesn't name them.
SHARED_SETTINGS = (
    "train_annotation_sha256",
    "val_annotation_sha256",
    "epochs",
    "batch",
    "imgsz",
    "workers",
    "amp",
    "fraction",
    "multiscale_range",
    "prediction_floor",
    "nms_iou",
    "class_agnostic_nms",
    "common_operating_confidence",
    "common_match_iou",
    "protocol_config_sha256",
)
SETTING_DEFAULTS = {"fraction": "1.0", "multiscale_range": "0"}
# What a released run must have.
RUN_EVIDENCE = ("epoch_metrics_exists", "final_metrics_exists", "latency_exists", "gpu_summary_exists", "checkpoint_exists", "checkpoint_hash_matches")
FINAL_METRICS = ("ap50_95", "ap50", "ap75", "ar100", "precision", "recall", "f1", "tp", "fp", "fn")
LATENCY_METRICS = ("e2e_p50_ms", "e2e_p95_ms", "sustained_fps")
GPU_METRICS = ("peak_memory_used_mib",)
SMOKE_STAGE = "smoke_not_comparable"
# States of a pending run, of a reviewed image, and of a threshold's origin.
PENDING_STATE, PENDING_ROLE = "PENDING_HUMAN_REVIEW", "unlabeled_train"
KEPT_DISPOSITIONS, EMPTY_DISPOSITION, REJECTED = ("approved", "corrected"), "confirmed_empty", "rejected"
DRAFT, REVIEW_STATE = "DRAFT_REQUIRES_HUMAN_REVIEW", "PENDING_HUMAN_REVIEW"
COLLECTED, COLLECTED_USE, COLLECTOR_SCHEMA = "ACCEPTED", "PROHIBITED_PENDING_HUMAN_REVIEW", 2
VALIDATION_STATE, TEST_STATE, TEST_USE = "VALIDATION_DERIVED_CANDIDATE", "NOT_FOR_THRESHOLD_SELECTION", "diagnostic_metrics_only"


def _broken(rows: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """keys, field, expected, actual (texts) of each rule (field, whether it is kept, expected, actual); null counts as broken."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("field"), want.cast("string").alias("expected"), got.cast("string").alias("actual"))) for name, ok, want, got in rules]
    return rows.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def _setting(name: str) -> Column:
    return F.coalesce(F.try_element_at("settings", F.lit(name)), F.lit(SETTING_DEFAULTS.get(name)))


def _whole_seed() -> Column:
    """Whether the JSON text of a seed is an integer: no bool, text or fraction."""
    return F.col("seed").rlike("^-?[0-9]+$")


def differing_settings(runs: DataFrame, evidence: Sequence[str] = ()) -> DataFrame:
    """field, n_values: settings (JSON texts; absent is a value) on which runs differ, and seed_set if models have other seeds.
    runs: run_id, model, seed (JSON text), settings (map of JSON texts)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(_setting(f), F.lit("null")).alias("value")) for f in (*SHARED_SETTINGS, *evidence)]))
    uneven = runs.select(each.alias("x")).groupBy("x.field").agg(F.count_distinct("x.value").alias("n_values"))
    sets = runs.groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"))
    return uneven.unionByName(sets.agg(F.count_distinct("seeds").alias("n_values")).select(F.lit("seed_set").alias("field"), "n_values")).where("n_values > 1")


def release_blockers(runs: DataFrame, policy: dict) -> DataFrame:
    """field, run_id (null for rules about all runs), expected, actual: why runs can't be released together.

    runs: run_id, model, seed, settings as in differing_settings; status, stage, epoch_rows, evidence (map of booleans),
    metrics (map of doubles). policy: models, seeds, settings (expected JSON texts by name), evidence (expected texts of
    data by name; None asks only that there is one), protocol_sha256 (or None). Models are compared by letters and digits."""
    wanted, named = policy.get("settings", {}), policy.get("evidence", {})
    finite = lambda m: F.try_element_at("metrics", F.lit(m)).isNotNull() & ~F.isnan(F.try_element_at("metrics", F.lit(m))) & (F.abs(F.try_element_at("metrics", F.lit(m))) != float("inf"))
    none = F.lit(None)
    rules = [("run_seed_types", _whole_seed(), F.lit("int"), F.col("seed"))]
    rules.append(("complete_non_smoke_runs", (F.col("status") == "complete") & ~F.col("stage").eqNullSafe(SMOKE_STAGE), F.lit("complete"), F.concat_ws("/", "status", "stage")))
    rules += [(f"expected:{f}", _setting(f).eqNullSafe(F.lit(want)), F.lit(want), _setting(f)) for f, want in wanted.items() if want is not None]
    if wanted.get("epochs") is not None:
        rules.append(("completed_epoch_rows", F.col("epoch_rows").cast("string") == wanted["epochs"], F.lit(wanted["epochs"]), F.col("epoch_rows")))
    rules += [(f"dataset_evidence:{f}", F.coalesce(F.length(_setting(f)), F.lit(0)) > 0, none, _setting(f)) for f in named]
    rules += [(f"expected_dataset_evidence:{f}", _setting(f).eqNullSafe(F.lit(want)), F.lit(want), _setting(f)) for f, want in named.items() if want is not None]
    if policy.get("protocol_sha256"):
        rules.append(("protocol_snapshot_integrity", _setting("protocol_config_sha256").eqNullSafe(F.lit(policy["protocol_sha256"])), F.lit(policy["protocol_sha256"]), _setting("protocol_config_sha256")))
    rules += [(f"run_evidence:{f}", F.try_element_at("evidence", F.lit(f)), F.lit("true"), F.try_element_at("evidence", F.lit(f))) for f in RUN_EVIDENCE]
    for kind, names in (("final_metric", FINAL_METRICS), ("latency_metric", LATENCY_METRICS), ("gpu_metric", GPU_METRICS)):
        rules += [(f"{kind}:{m}", finite(m), F.lit("finite"), F.try_element_at("metrics", F.lit(m))) for m in names]
    each = _broken(runs, ["run_id"], rules).select("field", "run_id", "expected", "actual")
    return each.unionByName(_matrix_blockers(runs, policy)).unionByName(
        differing_settings(runs, list(named)).limit(1).select(F.lit("protocol_comparability").alias("field"), F.lit(None).cast("string").alias("run_id"), F.lit("equal").alias("expected"), F.lit("different").alias("actual"))
    )


def _matrix_blockers(runs: DataFrame, policy: dict) -> DataFrame:
    """Rules about the models and seeds of all runs, from one row for each model and seed there is."""
    spark = runs.sparkSession
    plain = {"".join(c for c in m.lower() if c.isascii() and c.isalnum()): m for m in policy["models"]}
    seeds = [s for s in policy["seeds"] if type(s) is int]
    there = runs.groupBy(text.model_key(F.col("model")).alias("model"), "seed").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(m, str(s)) for m in plain for s in seeds], "model string, seed string").withColumn("asked", F.lit(True))
    both = there.join(F.broadcast(asked), ["model", "seed"], "full").withColumns({"n": F.coalesce("n", F.lit(0)), "asked": F.coalesce("asked", F.lit(False))})
    known = F.col("model").isin(list(plain))
    counts = both.agg(
        F.count_if(~F.col("asked") | (F.col("n") != 1)).alias("gaps"), F.sum("n").alias("runs"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if(~known).alias("strange"),
        F.count_distinct(F.when((F.col("n") > 0) & known, F.col("model"))).alias("models"),
    )
    whole = [
        ("model_set", (F.col("strange") == 0) & (F.col("models") == len(plain)), F.lit(",".join(sorted(plain.values()))), F.col("models")),
        ("complete_model_seed_matrix", F.col("gaps") == 0, F.lit(str(len(plain) * len(seeds))), F.col("runs")),
        ("duplicate_model_seed_pair", F.col("twice") == 0, F.lit("0"), F.col("twice")),
        ("expected_seed_types", F.lit(len(seeds) == len(policy["seeds"])), F.lit("int"), F.lit(None)),
    ]
    by_model = both.where(known).groupBy("model").agg(F.count_if(F.col("asked") != (F.col("n") > 0)).alias("off"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("seed")))), ",").alias("seeds"))
    uneven = by_model.where("off > 0").select(F.concat(F.lit("seed_set:"), "model").alias("field"), F.lit(",".join(map(str, sorted(seeds)))).alias("expected"), F.col("seeds").alias("actual"))
    found = _broken(counts, [], whole).unionByName(uneven)
    return found.select("field", F.lit(None).cast("string").alias("run_id"), "expected", "actual")


def pending_problems(run: DataFrame, images: DataFrame, ontology_sha256: str) -> DataFrame:
    """field, key, expected, actual: why a pending run's images can't be reviewed. run (one row): annotation_state, status, role,
    ontology_sha256, automatic_promotion; images: path, image_id, sha256, width, height, role."""
    head = [("annotation_state", F.col("annotation_state") == PENDING_STATE, F.lit(PENDING_STATE), F.col("annotation_state"))]
    head.append(("status", F.col("status") == "complete", F.lit("complete"), F.col("status")))
    head.append(("role", F.col("role") == PENDING_ROLE, F.lit(PENDING_ROLE), F.col("role")))
    head.append(("ontology_sha256", text.sha256_or_null(F.col("ontology_sha256")).eqNullSafe(F.lit(ontology_sha256)), F.lit(ontology_sha256), F.col("ontology_sha256")))
    head.append(("automatic_promotion", F.col("automatic_promotion").eqNullSafe(F.lit(False)), F.lit("false"), F.col("automatic_promotion")))
    each = [("safe_path", text.is_safe_relative_path(F.col("path")), F.lit(None), F.col("path"))]
    each.append(("image_role", F.col("role") == PENDING_ROLE, F.lit(PENDING_ROLE), F.col("role")))
    each.append(("image_id", F.length(F.trim("image_id")) > 0, F.lit(None), F.col("image_id")))
    each += [(f"positive_{c}", F.col(c) > 0, F.lit("> 0"), F.col(c)) for c in ("width", "height")]
    each.append(("sha256", text.sha256_or_null(F.col("sha256")).isNotNull(), F.lit(None), F.col("sha256")))
    key = F.coalesce("path", F.lit("")).alias("key")
    parts = [_broken(run, [], head).select("field", F.lit("run").alias("key"), "expected", "actual"), _broken(images.withColumn("key", key), ["key"], each)]
    for c in ("path", "image_id"):
        again = compare.repeated_values(images.where(F.col(c).isNotNull()), c)
        parts.append(again.select(F.lit(f"repeated_{c}").alias("field"), F.col(c).alias("key"), F.lit("1").alias("expected"), F.col("n").cast("string").alias("actual")))
    parts.append(images.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("images").alias("field"), F.lit("run").alias("key"), F.lit("> 0").alias("expected"), F.lit("0").alias("actual")))
    return reduce(DataFrame.unionByName, [x.select("field", "key", "expected", "actual") for x in parts])


def promotion_problems(pending: DataFrame, reviewed: DataFrame, exported: DataFrame, annotations: DataFrame) -> DataFrame:
    """field, key (a path; of annotations, their image's id): why reviewed annotations can't be promoted.

    pending: path, image_id, sha256, width, height; reviewed: the same and disposition; exported: id, path, width, height;
    annotations: image_id (an exported id). Every pending image is reviewed once, as itself, with a settled disposition, and
    exported once with its size; an approved image has annotations, and one confirmed as empty has none."""
    named = lambda rows, key, name: rows.select(F.lit(name).alias("field"), F.col(key).cast("string").alias("key"))
    settled = F.col("disposition").isin(*KEPT_DISPOSITIONS, EMPTY_DISPOSITION, REJECTED)
    parts = [named(reviewed.where(~F.coalesce(settled, F.lit(False))), "path", "unresolved_disposition")]
    parts += [named(compare.repeated_values(rows, c), c, name) for rows, c, name in ((reviewed, "path", "repeated_review"), (exported, "path", "repeated_export"), (exported, "id", "repeated_export_id"))]
    for rows, name in ((reviewed, "review"), (exported, "export")):
        gaps = compare.set_difference(pending, rows, "path")
        parts.append(gaps.select(F.concat_ws("_", "problem", F.lit(name)).alias("field"), F.col("path").alias("key")))
    identity = compare.field_mismatches(pending, reviewed, "path", ["image_id", "sha256", "width", "height"])
    parts.append(identity.select(F.concat(F.lit("identity:"), "field").alias("field"), F.col("path").alias("key")))
    parts.append(compare.field_mismatches(pending, exported, "path", ["width", "height"]).select(F.concat(F.lit("export:"), "field").alias("field"), F.col("path").alias("key")))
    parts.append(named(annotations.join(exported.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "image_id", "unknown_image"))
    counts = annotations.groupBy("image_id").agg(F.count("*").alias("n")).join(exported.select(F.col("id").alias("image_id"), "path"), "image_id").groupBy("path").agg(F.sum("n").alias("n"))
    held = reviewed.select("path", "disposition").join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    why = F.when((F.col("disposition") == EMPTY_DISPOSITION) & (F.col("n") > 0), "empty_with_annotations").when(F.col("disposition").isin(*KEPT_DISPOSITIONS) & (F.col("n") == 0), "approved_without_annotations")
    parts.append(held.select(why.alias("field"), F.col("path").alias("key")).where("field is not null"))
    left = reviewed.agg(F.count_if(F.col("disposition") != REJECTED).alias("n")).where("n = 0")
    parts.append(left.select(F.lit("nothing_included").alias("field"), F.lit("review").alias("key")))
    return reduce(DataFrame.unionByName, parts)


def reviewed_train(reviewed: DataFrame, exported: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of images that the review didn't reject, with path, the image's own id and sha256."""
    kept = reviewed.where(F.col("disposition") != REJECTED).select("path", F.col("image_id").alias("own_image_id"), "sha256")
    return annotations.join(exported.select(F.col("id").alias("image_id"), "path"), "image_id").join(kept, "path")


def threshold_problems(evaluations: DataFrame) -> DataFrame:
    """split, field, expected, actual: a test part must not choose thresholds, and a validation part's are candidates only.

    evaluations: split, policy (status, usage, test_data_used, test_data_used_for_selection), final_policy (the same, as its
    metrics record it), metrics (map of doubles), calibration and class_calibrations (status, confidence; an array of them),
    protocol (map of texts), has_threshold_file."""
    p, test = F.col("policy"), F.col("split") == "test"
    asked = lambda ok: ~test | ok
    off = lambda c: (c["status"] == TEST_STATE) & c["confidence"].isNull()
    rules = [("policy_of_metrics", F.to_json(p) == F.to_json("final_policy"), F.to_json("final_policy"), F.to_json(p))]
    rules.append(("validation_candidate", test | ((p["status"] == VALIDATION_STATE) & p["test_data_used"].eqNullSafe(F.lit(False))), F.lit(VALIDATION_STATE), p["status"]))
    rules.append(("test_not_for_selection", asked((p["status"] == TEST_STATE) & (p["usage"] == TEST_USE) & p["test_data_used_for_selection"].eqNullSafe(F.lit(False))), F.lit(TEST_STATE), p["status"]))
    rules.append(("test_threshold_file", asked(~F.col("has_threshold_file")), F.lit("false"), F.col("has_threshold_file")))
    rules.append(("test_best_f1", asked(~F.map_contains_key("metrics", F.lit("best_f1")) & ~F.map_contains_key("metrics", F.lit("best_f1_confidence"))), F.lit(None), F.lit("best_f1")))
    rules.append(("test_calibration", asked(off(F.col("calibration"))), F.lit(TEST_STATE), F.col("calibration")["status"]))
    rules.append(("test_class_calibration", asked(F.forall("class_calibrations", off)), F.lit(TEST_STATE), F.size("class_calibrations")))
    rules.append(("test_calibration_targets", asked(~F.exists(F.map_keys("protocol"), lambda k: k.startswith("pseudo_label_"))), F.lit(None), F.array_join(F.map_keys("protocol"), ",")))
    return _broken(evaluations, ["split"], rules)


def evaluation_problems(evaluations: DataFrame, deployment: dict, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """split, field, expected, actual: why a formal evaluation doesn't fit its deployment and files.

    evaluations: split, schema_version, status, mode, framework, profile, bindings (map of statuses), assignment_sha256, names (array),
    protocol (map of texts), image_count; deployment: framework, names, protocol (expected texts by name); artifacts: split,
    name, path, sha256; files: path, sha256, generated (null for what is no image)."""
    asked = ("protocol_binding", "split_binding")
    val = F.col("split") == "val"
    rules = [(f, F.col(f).cast("string") == want, F.lit(want), F.col(f)) for f, want in (("schema_version", "1"), ("status", "PASS"), ("mode", "formal"), ("profile", "fixed_batch1_fp32_onnxruntime"), ("framework", deployment["framework"]))]
    bound = lambda f: F.try_element_at("bindings", F.lit(f)) == "PASS"
    rules += [(f, bound(f), F.lit("PASS"), F.try_element_at("bindings", F.lit(f))) for f in asked]
    rules += [(f, ~val | bound(f), F.lit("PASS"), F.try_element_at("bindings", F.lit(f))) for f in ("native_metric_equivalence", "native_reference_binding")]
    rules.append(("assignment_sha256", F.lower("assignment_sha256").rlike("^[0-9a-f]{64}$"), F.lit(None), F.col("assignment_sha256")))
    rules.append(("category_names", F.col("names") == F.array(*map(F.lit, deployment["names"])), F.lit(",".join(deployment["names"])), F.array_join("names", ",")))
    rules += [(f"protocol:{f}", F.try_element_at("protocol", F.lit(f)).eqNullSafe(F.lit(want)), F.lit(want), F.try_element_at("protocol", F.lit(f))) for f, want in deployment["protocol"].items()]
    found = artifacts.join(files.select("path", F.col("sha256").alias("found"), "generated"), "path", "left")
    broken = found.where("not (found <=> sha256)").select("split", F.concat(F.lit("artifact:"), "name").alias("field"), F.col("sha256").alias("expected"), F.col("found").alias("actual"))
    images = found.where("name = 'image'").groupBy("split").agg(F.count("*").alias("n"), F.count_if(~F.col("generated").eqNullSafe(F.lit(False))).alias("generated"))
    counted = evaluations.select("split", "image_count").join(images, "split", "left").fillna(0, ["n", "generated"])
    more = [("image_count", F.col("n") == F.col("image_count"), F.col("image_count"), F.col("n")), ("generated_images", F.col("generated") == 0, F.lit("0"), F.col("generated"))]
    return _broken(evaluations, ["split"], rules).unionByName(broken).unionByName(_broken(counted, ["split"], more))


def proposal_problems(head: DataFrame, proposals: DataFrame, eligible: DataFrame, class_name: str, ontology_sha256: str) -> DataFrame:
    """field, key, expected, actual: why proposed boxes of a seed can't be used. head (one row): status, class_name,
    ontology_sha256, human_review_completed, ground_truth, training_use_allowed; proposals: source_page_id, leakage_group_id, bbox
    (array of whole numbers), attributes (map of booleans), review_state; eligible: source_page_id, leakage_group_id, width, height."""
    rules = [("status", F.col("status") == DRAFT, F.lit(DRAFT), F.col("status")), ("class_name", F.col("class_name") == class_name, F.lit(class_name), F.col("class_name"))]
    rules.append(("ontology_sha256", text.sha256_or_null(F.col("ontology_sha256")).eqNullSafe(F.lit(ontology_sha256)), F.lit(ontology_sha256), F.col("ontology_sha256")))
    rules += [(f, F.col(f).eqNullSafe(F.lit(False)), F.lit("false"), F.col(f)) for f in ("human_review_completed", "ground_truth", "training_use_allowed")]
    parts = [_broken(head, [], rules).select("field", F.lit("proposal").alias("key"), "expected", "actual")]
    page = eligible.select("source_page_id", F.col("leakage_group_id").alias("group"), "width", "height")
    rows = proposals.join(page, "source_page_id").withColumn("key", F.col("source_page_id").cast("string"))
    x, y, w, h = (F.get("bbox", i) for i in range(4))
    four = F.size("bbox") == 4
    each = [("leakage_group_id", F.col("leakage_group_id") == F.col("group"), F.col("group"), F.col("leakage_group_id"))]
    each.append(("bbox", four & (x >= 0) & (y >= 0), F.lit("four whole numbers"), F.array_join("bbox", ",")))
    each.append(("positive_area", four & (w > 0) & (h > 0), F.lit("> 0"), F.array_join("bbox", ",")))
    each.append(("inside", four & (x + w <= F.col("width")) & (y + h <= F.col("height")), F.concat_ws("x", "width", "height"), F.array_join("bbox", ",")))
    names = F.array_sort(F.map_keys("attributes"))
    each.append(("attributes", (names == F.array(F.lit("occluded"), F.lit("truncated"))) & F.forall(F.map_values("attributes"), lambda v: v.isNotNull()), F.lit("occluded,truncated"), F.array_join(names, ",")))
    each.append(("review_state", F.col("review_state") == REVIEW_STATE, F.lit(REVIEW_STATE), F.col("review_state")))
    parts.append(_broken(rows, ["key"], each).select("field", "key", "expected", "actual"))
    again = compare.repeated_values(proposals, "source_page_id")
    parts.append(again.select(F.lit("repeated_page").alias("field"), F.col("source_page_id").cast("string").alias("key"), F.lit("1").alias("expected"), F.col("n").cast("string").alias("actual")))
    gaps = compare.set_difference(eligible, proposals, "source_page_id").where("source_page_id is not null")
    parts.append(gaps.select(F.concat(F.col("problem"), F.lit("_page")).alias("field"), F.col("source_page_id").cast("string").alias("key"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    return reduce(DataFrame.unionByName, parts)


def calibration_thresholds(by_class: DataFrame, overall: DataFrame) -> DataFrame:
    """class_name, threshold, problem (null: usable): thresholds of classes (category_name, confidence) and of all, as
    __global__ (overall: confidence). Rows without a confidence give none; a class may have one only, from 0 to 1."""
    own = by_class.where("confidence is not null").select(F.col("category_name").alias("class_name"), F.col("confidence").cast("double").alias("threshold"))
    rows = own.unionByName(overall.where("confidence is not null").select(F.lit("__global__").alias("class_name"), F.col("confidence").cast("double").alias("threshold")))
    n = rows.groupBy(F.col("class_name").alias("name")).agg(F.count("*").alias("n"))
    named = rows.join(n, F.col("class_name").eqNullSafe(F.col("name")))
    why = F.when(F.coalesce("class_name", F.lit("")) == "", "invalid_category").when(F.col("n") > 1, "repeated_category").when(F.isnan("threshold") | ~F.col("threshold").between(0, 1), "out_of_range")
    return named.select("class_name", "threshold", why.alias("problem"))


def resume_problems(records: DataFrame, files: DataFrame, class_name: str) -> DataFrame:
    """field, key: why a collection can't go on. records: source_page_id, relative_path, sha256, bytes, status, class_name,
    qa_status, schema_version, and of the present schema config_sha256, metadata_sha256, revision_id, image_timestamp (text),
    source_sha1, license, license_url, usage_terms, artist, credit, training_eligibility; files: relative_path, sha256, bytes."""
    digest = lambda c: text.sha256_or_null(F.col(c)).isNotNull()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    old, none = F.coalesce("schema_version", F.lit(1)) < COLLECTOR_SCHEMA, F.lit(None)
    rules = [("status", F.col("status") == COLLECTED), ("class_name", F.col("class_name") == class_name), ("qa_status", F.col("qa_status") == REVIEW_STATE), ("page_id", F.col("source_page_id") > 0)]
    rules += [("sha256", digest("sha256")), ("newer_schema", F.coalesce("schema_version", F.lit(1)) <= COLLECTOR_SCHEMA), ("safe_path", text.is_safe_relative_path(F.col("relative_path")))]
    now = [("config_hash", digest("config_sha256")), ("metadata_hash", digest("metadata_sha256")), ("page_revision", F.col("revision_id") > 0), ("image_timestamp", text.utc_or_null(F.col("image_timestamp")).isNotNull())]
    now += [("source_sha1", F.col("source_sha1").rlike("^[0-9a-f]{40}$")), ("license_metadata", ~blank("license") & ~blank("license_url") & ~blank("usage_terms") & ~(blank("artist") & blank("credit")))]
    now += [("license_url", F.col("license_url").rlike("^https?://[^/]+")), ("training_eligibility", F.col("training_eligibility") == COLLECTED_USE)]
    rules += [(f, old | ok) for f, ok in now]
    keyed = records.withColumn("key", F.coalesce("relative_path", F.lit("")))
    parts = [_broken(keyed, ["key"], [(f, ok, none, none) for f, ok in rules]).select("field", "key")]
    for c, rows in (("source_page_id", records), ("sha256", records.withColumn("sha256", F.lower("sha256"))), ("relative_path", records)):
        again = compare.repeated_values(rows.where(F.col(c).isNotNull()), c)
        parts.append(again.select(F.lit(f"repeated_{c}").alias("field"), F.col(c).cast("string").alias("key")))
    found = files.select("relative_path", F.col("sha256").alias("found"), F.col("bytes").alias("size"))
    both = records.join(found, "relative_path", "left")
    why = F.when(F.col("found").isNull(), "file_missing").when(F.lower("sha256") != F.col("found"), "hash_mismatch").when(F.col("bytes") != F.col("size"), "size_mismatch")
    parts.append(both.select(why.alias("field"), F.col("relative_path").alias("key")).where("field is not null and key is not null"))
    parts.append(files.join(records, "relative_path", "left_anti").select(F.lit("unmanifested_file").alias("field"), F.col("relative_path").alias("key")))
    return reduce(DataFrame.unionByName, parts)
