"""Rule tables against small fixtures: each broken rule is a row, and whole ones give none."""

from sievemark.operators import gates

SHA = "ab" * 32
SETTINGS = {f: '"x"' for f in gates.SHARED_SETTINGS if f not in ("fraction", "multiscale_range")} | {"epochs": "100", "protocol_config_sha256": SHA}
METRICS = {m: 0.5 for m in (*gates.FINAL_METRICS, *gates.LATENCY_METRICS, *gates.GPU_METRICS)}
POLICY = {"models": ["YOLO-11m", "yolox_s"], "seeds": [42, 43], "settings": {"epochs": "100", "fraction": "1.0", "amp": None}, "evidence": {"test_sha256": SHA}, "protocol_sha256": SHA}


def runs(spark, change=lambda rows: rows):
    rows = [
        {"run_id": f"{m}/{s}", "model": m, "seed": str(s), "settings": SETTINGS | {"test_sha256": SHA}, "status": "complete", "stage": None, "epoch_rows": 100, "evidence": dict.fromkeys(gates.RUN_EVIDENCE, True), "metrics": dict(METRICS)}
        for m in ("yolo11m", "YOLOX-S")
        for s in (42, 43)
    ]
    shape = "run_id string, model string, seed string, settings map<string,string>, status string, stage string, epoch_rows long, evidence map<string,boolean>, metrics map<string,double>"
    return spark.createDataFrame(change(rows), shape)


def blockers(spark, change, policy=POLICY):
    return sorted((r.field, r.run_id) for r in gates.release_blockers(runs(spark, change), policy).collect())


def test_whole_runs_are_released(spark):
    assert blockers(spark, lambda rows: rows) == [] and gates.differing_settings(runs(spark)).count() == 0


def test_every_rule_of_a_release(spark):
    def broken(rows):
        a, b, c, d = rows
        a |= {"settings": a["settings"] | {"epochs": "99", "test_sha256": ""}, "epoch_rows": 99}
        b |= {"seed": '"43"', "stage": gates.SMOKE_STAGE}
        c |= {"status": "running", "evidence": c["evidence"] | {"latency_exists": False, "checkpoint_exists": None}}
        d |= {"metrics": {k: v for k, v in d["metrics"].items() if k != "ap75"} | {"f1": float("nan"), "sustained_fps": float("inf")}, "settings": d["settings"] | {"fraction": "0.5", "protocol_config_sha256": "cd" * 32}}
        return rows

    found = blockers(spark, broken)
    a, b, c, d = "yolo11m/42", "yolo11m/43", "YOLOX-S/42", "YOLOX-S/43"
    want = [(f, a) for f in ("expected:epochs", "completed_epoch_rows", "dataset_evidence:test_sha256", "expected_dataset_evidence:test_sha256")]
    want += [(f, b) for f in ("run_seed_types", "complete_non_smoke_runs")] + [(f, c) for f in ("complete_non_smoke_runs", "run_evidence:latency_exists", "run_evidence:checkpoint_exists")]
    want += [(f, d) for f in ("final_metric:ap75", "final_metric:f1", "latency_metric:sustained_fps", "expected:fraction", "protocol_snapshot_integrity")]
    want += [(f, None) for f in ("seed_set:yolo11m", "complete_model_seed_matrix", "protocol_comparability")]
    assert sorted(found, key=str) == sorted(want, key=str)
    fields = {r.field for r in gates.differing_settings(runs(spark, broken), ["test_sha256"]).collect()}
    assert fields == {"epochs", "fraction", "protocol_config_sha256", "test_sha256", "seed_set"}


def test_models_and_seeds_of_a_release(spark):
    twice = {f for f, _ in blockers(spark, lambda rows: [*rows, {**rows[0], "run_id": "again"}])}
    assert twice == {"duplicate_model_seed_pair", "complete_model_seed_matrix"}
    strange = {f for f, _ in blockers(spark, lambda rows: [{**r, "model": "other"} if r["model"] == "YOLOX-S" else r for r in rows])}
    assert strange == {"model_set", "complete_model_seed_matrix", "seed_set:yoloxs"}
    assert {f for f, _ in blockers(spark, lambda rows: rows, POLICY | {"seeds": [42, 43, True]})} == {"expected_seed_types"}
    assert {f for f, _ in blockers(spark, lambda rows: [])} == {"model_set", "complete_model_seed_matrix", "seed_set:yolo11m", "seed_set:yoloxs"}


IMAGES = [("a/1.png", "i1", SHA, 10, 20), ("a/2.png", "i2", SHA, 30, 40), ("a/3.png", "i3", SHA, 5, 5), ("a/4.png", "i4", SHA, 6, 6)]
IDENTITY = "path string, image_id string, sha256 string, width int, height int"


def test_pending_runs(spark):
    head = "annotation_state string, status string, role string, ontology_sha256 string, automatic_promotion boolean"
    run = spark.createDataFrame([(gates.PENDING_STATE, "complete", gates.PENDING_ROLE, SHA.upper(), False)], head)
    images = spark.createDataFrame([(*x, gates.PENDING_ROLE) for x in IMAGES], IDENTITY + ", role string")
    assert gates.pending_problems(run, images, SHA).count() == 0
    bad_run = spark.createDataFrame([("REVIEWED", "running", "val", "cd" * 32, None)], head)
    rows = [("../x", " ", "zz", 0, None, "val"), ("a/1.png", "i1", SHA, 1, 1, gates.PENDING_ROLE), ("a/1.png", "i1", SHA, 1, 1, gates.PENDING_ROLE)]
    bad = gates.pending_problems(bad_run, spark.createDataFrame(rows, IDENTITY + ", role string"), SHA)
    want = {("annotation_state", "run"), ("status", "run"), ("role", "run"), ("ontology_sha256", "run"), ("automatic_promotion", "run"), ("repeated_path", "a/1.png"), ("repeated_image_id", "i1")}
    want |= {(f, "../x") for f in ("safe_path", "image_role", "image_id", "positive_width", "positive_height", "sha256")}
    assert {(r.field, r.key) for r in bad.collect()} == want
    assert [(r.field, r.key) for r in gates.pending_problems(run, images.where("false"), SHA).collect()] == [("images", "run")]


def test_promotion(spark):
    pending = spark.createDataFrame(IMAGES, IDENTITY)
    states = ["approved", "confirmed_empty", "rejected", "corrected"]
    reviewed = spark.createDataFrame([(*x, s) for x, s in zip(IMAGES, states, strict=True)], IDENTITY + ", disposition string")
    exported = spark.createDataFrame([(10 * i, x[0], x[3], x[4]) for i, x in enumerate(IMAGES)], "id long, path string, width int, height int")
    annotations = spark.createDataFrame([(0, "u"), (20, "r"), (30, "v")], "image_id long, label string")
    assert gates.promotion_problems(pending, reviewed, exported, annotations).count() == 0
    assert {(r.label, r.path, r.own_image_id) for r in gates.reviewed_train(reviewed, exported, annotations).collect()} == {("u", "a/1.png", "i1"), ("v", "a/4.png", "i4")}
    bad_reviews = spark.createDataFrame([(*IMAGES[0], "later"), ("a/2.png", "other", SHA, 31, 40, "confirmed_empty"), (*IMAGES[2], "approved"), (*IMAGES[2], "approved"), ("new", "i9", SHA, 1, 1, "rejected")], IDENTITY + ", disposition string")
    bad_exports = spark.createDataFrame([(0, "a/1.png", 10, 21), (10, "a/2.png", 30, 40), (10, "a/3.png", 5, 5), (30, "gone", 6, 6)], "id long, path string, width int, height int")
    marks = spark.createDataFrame([(10, "u"), (77, "v")], "image_id long, label string")
    found = {(r.field, r.key) for r in gates.promotion_problems(pending, bad_reviews, bad_exports, marks).collect()}
    want = {("unresolved_disposition", "a/1.png"), ("repeated_review", "a/3.png"), ("repeated_export_id", "10"), ("missing_review", "a/4.png"), ("unexpected_review", "new"), ("missing_export", "a/4.png"), ("unexpected_export", "gone")}
    want |= {("identity:image_id", "a/2.png"), ("identity:width", "a/2.png"), ("export:height", "a/1.png"), ("unknown_image", "77"), ("empty_with_annotations", "a/2.png")}
    assert found == want
    none = reviewed.withColumn("disposition", gates.F.lit("rejected"))
    assert {r.field for r in gates.promotion_problems(pending, none, exported, annotations).collect()} == {"nothing_included"}


POLICY_TYPE = "struct<status string, usage string, test_data_used boolean, test_data_used_for_selection boolean>"
STATE = "struct<status string, confidence double>"


def test_thresholds_come_from_validation(spark):
    shape = f"split string, policy {POLICY_TYPE}, final_policy {POLICY_TYPE}, metrics map<string,double>, calibration {STATE}, class_calibrations array<{STATE}>, protocol map<string,string>, has_threshold_file boolean"
    val, test = (gates.VALIDATION_STATE, None, False, None), (gates.TEST_STATE, gates.TEST_USE, None, False)
    good = [("val", val, val, {"best_f1": 0.5}, ("AVAILABLE", 0.4), [("AVAILABLE", 0.4)], {"pseudo_label_precision": "0.9"}, True), ("test", test, test, {"f1": 0.5}, (gates.TEST_STATE, None), [(gates.TEST_STATE, None)], {"nms": "0.5"}, False)]
    assert gates.threshold_problems(spark.createDataFrame(good, shape)).count() == 0
    bad = [("val", (gates.VALIDATION_STATE, None, True, None), val, {}, None, None, {}, False), ("test", val, test, {"best_f1": 0.5}, (gates.TEST_STATE, 0.4), [("AVAILABLE", None)], {"pseudo_label_recall": "1"}, True)]
    found = {(r.split, r.field) for r in gates.threshold_problems(spark.createDataFrame(bad, shape)).collect()}
    want = {("val", "policy_of_metrics"), ("val", "validation_candidate")}
    want |= {("test", f) for f in ("policy_of_metrics", "test_not_for_selection", "test_threshold_file", "test_best_f1", "test_calibration", "test_class_calibration", "test_calibration_targets")}
    assert found == want


def test_formal_evaluations(spark):
    shape = "split string, schema_version int, status string, mode string, framework string, profile string, bindings map<string,string>, assignment_sha256 string, names array<string>, protocol map<string,string>, image_count int"
    deployment = {"framework": "onnx", "names": ["a", "b"], "protocol": {"batch": "1", "image_size": "640"}}
    names = ("protocol_binding", "split_binding", "native_metric_equivalence", "native_reference_binding")
    good = [(s, 1, "PASS", "formal", "onnx", "fixed_batch1_fp32_onnxruntime", dict.fromkeys(names[: 4 if s == "val" else 2], "PASS"), SHA, ["a", "b"], {"batch": "1", "image_size": "640"}, 1) for s in ("val", "test")]
    artifacts = spark.createDataFrame([(s, n, f"{s}/{n}", SHA) for s in ("val", "test") for n in ("image", "predictions")], "split string, name string, path string, sha256 string")
    files = artifacts.selectExpr("path", "sha256", "if(name = 'image', false, null) as generated")
    assert gates.evaluation_problems(spark.createDataFrame(good, shape), deployment, artifacts, files).count() == 0
    bad = [("val", 2, "FAIL", "dry", "torch", "gpu", {"protocol_binding": "FAIL"}, "zz", ["b", "a"], {"batch": "2"}, 3), good[1]]
    gone = files.where("path <> 'test/predictions'").selectExpr("path", "sha256", "if(path = 'test/image', true, generated) as generated")
    found = {(r.split, r.field) for r in gates.evaluation_problems(spark.createDataFrame(bad, shape), deployment, artifacts, gone).collect()}
    want = {("val", f) for f in ("schema_version", "status", "mode", "framework", "profile", *names, "assignment_sha256", "category_names", "protocol:batch", "protocol:image_size", "image_count")}
    assert found == want | {("test", "artifact:predictions"), ("test", "generated_images")}


def test_proposals_cover_eligible_pages(spark):
    head_type = "status string, class_name string, ontology_sha256 string, human_review_completed boolean, ground_truth boolean, training_use_allowed boolean"
    head = spark.createDataFrame([(gates.DRAFT, "board", SHA, False, False, False)], head_type)
    eligible = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 10, 10)], "source_page_id long, leakage_group_id string, width int, height int")
    shape = "source_page_id long, leakage_group_id string, bbox array<int>, attributes map<string,boolean>, review_state string"
    marks = {"occluded": True, "truncated": False}
    good = [(1, "a", [0, 0, 10, 10], marks, gates.REVIEW_STATE), (2, "b", [1, 1, 2, 2], marks, gates.REVIEW_STATE)]
    assert gates.proposal_problems(head, spark.createDataFrame(good, shape), eligible, "board", SHA).count() == 0
    bad = [(1, "z", [0, 0, 11, 0], {"occluded": None}, None), (3, "b", [1], marks, gates.REVIEW_STATE), (3, "b", [1], marks, gates.REVIEW_STATE)]
    bad_head = spark.createDataFrame([("DONE", "x", None, True, None, False)], head_type)
    found = {(r.field, r.key) for r in gates.proposal_problems(bad_head, spark.createDataFrame(bad, shape), eligible, "board", SHA).collect()}
    want = {(f, "proposal") for f in ("status", "class_name", "ontology_sha256", "human_review_completed", "ground_truth")}
    want |= {(f, "1") for f in ("leakage_group_id", "positive_area", "inside", "attributes", "review_state")} | {("repeated_page", "3"), ("missing_page", "2"), ("unexpected_page", "3")}
    assert found == want


def test_calibration_thresholds(spark):
    rows = [("a", 0.5), ("b", None), ("c", 1.5), ("d", 0.1), ("d", 0.2), (None, 0.3), ("e", float("nan"))]
    by_class, overall = spark.createDataFrame(rows, "category_name string, confidence double"), spark.createDataFrame([(0.9,)], "confidence double")
    found = sorted((str(r.class_name), r.problem) for r in gates.calibration_thresholds(by_class, overall).collect())
    assert found == [("None", "invalid_category"), ("__global__", None), ("a", None), ("c", "out_of_range"), ("d", "repeated_category"), ("d", "repeated_category"), ("e", "out_of_range")]


def test_resumed_collections(spark):
    names = "source_page_id relative_path sha256 bytes status class_name qa_status schema_version config_sha256 metadata_sha256 revision_id image_timestamp source_sha1 license license_url usage_terms artist credit training_eligibility".split()
    kinds = {"source_page_id": "long", "bytes": "long", "schema_version": "int", "revision_id": "long"}
    shape = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    good = (1, "board/a.jpg", SHA, 5, gates.COLLECTED, "board", gates.REVIEW_STATE, gates.COLLECTOR_SCHEMA, SHA, SHA, 7, "2024-01-31T12:00:00Z", "ab" * 20, "CC0", "https://x.org/y", "free", None, "me", gates.COLLECTED_USE)
    old = (2, "board/b.jpg", "cd" * 32, None, *good[4:7], None, *[None] * 11)
    files = spark.createDataFrame([("board/a.jpg", SHA, 5), ("board/b.jpg", "cd" * 32, 9)], "relative_path string, sha256 string, bytes long")
    assert gates.resume_problems(spark.createDataFrame([good, old], shape), files, "board").count() == 0
    bad = [dict(zip(names, good, strict=True)) | {"source_page_id": 0, "status": "X", "class_name": "y", "qa_status": None, "sha256": "zz", "config_sha256": None, "metadata_sha256": "q", "revision_id": 0, "image_timestamp": "now", "source_sha1": "AB" * 20, "license": " ", "license_url": "ftp://x", "training_eligibility": "ALLOWED"}]
    bad += [dict(zip(names, good, strict=True)) | {"relative_path": "../b", "schema_version": 9}, dict(zip(names, good, strict=True)) | {"bytes": 6}]
    found = {(r.field, r.key) for r in gates.resume_problems(spark.createDataFrame([tuple(x.values()) for x in bad], shape), files, "board").collect()}
    want = {(f, "board/a.jpg") for f in ("status", "class_name", "qa_status", "page_id", "sha256", "config_hash", "metadata_hash", "page_revision", "image_timestamp", "source_sha1", "license_metadata", "license_url", "training_eligibility", "hash_mismatch", "size_mismatch")}
    want |= {("newer_schema", "../b"), ("safe_path", "../b"), ("file_missing", "../b"), ("repeated_source_page_id", "1"), ("repeated_sha256", SHA), ("repeated_relative_path", "board/a.jpg"), ("unmanifested_file", "board/b.jpg")}
    assert found == want
