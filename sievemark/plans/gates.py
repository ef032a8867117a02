"""Rule tables of releases and promotions over projections of the test tables, the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark.operators import gates, ingest
from sievemark.session import table

ONTOLOGY = "ab" * 32


def _releases(spark, d):
    """A run for each event type and remainder of users: its settings and figures come from its events."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5 + 41).cast("string").alias("seed"))
    e = e.agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    e = e.withColumn("seed", F.when(F.col("last") % 5 == 0, F.concat(F.lit('"'), "seed", F.lit('"'))).otherwise(F.col("seed")))
    epochs = F.when(F.col("high") > 150, "100").otherwise("99")
    settings = {"epochs": epochs, "batch": F.when(F.col("low") < 0.5, "8").otherwise("16"), "amp": F.when(F.col("last") % 7 > 0, "true"), "test_sha256": F.sha2("model", 256)}
    metrics = {m: F.col("mean") for m in (*gates.FINAL_METRICS, *gates.LATENCY_METRICS, *gates.GPU_METRICS)} | {"ap75": F.when(F.col("last") % 3 > 0, F.col("mean")), "tp": F.when(F.col("last") % 4 > 0, F.col("mean")).otherwise(float("nan"))}
    flags = {f: F.lit(True) for f in gates.RUN_EVIDENCE} | {"latency_exists": F.col("n") % 2 == 0, "checkpoint_exists": F.when(F.col("n") % 3 > 0, True)}
    pairs = lambda x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v)])
    status = F.when(F.col("n") % 7 > 0, "complete").otherwise("running").alias("status")
    stage = F.when(F.col("n") % 11 == 0, gates.SMOKE_STAGE).alias("stage")
    return e.select(F.concat_ws("/", "model", "seed").alias("run_id"), "model", "seed", pairs(settings).alias("settings"), status, stage, F.when(F.col("high") > 150, 100).otherwise(98).cast("long").alias("epoch_rows"), pairs(flags).alias("evidence"), pairs(metrics).alias("metrics"))


_POLICY = {"models": ["Click", "view", "other"], "seeds": [41, 42, 43], "settings": {"epochs": "100", "batch": "8"}, "evidence": {"test_sha256": None}}


def rc2_release_blockers(spark, d):
    return gates.release_blockers(_releases(spark, d), _POLICY).select("field", "run_id")


def rc2_differing_settings(spark, d):
    return gates.differing_settings(_releases(spark, d), ["test_sha256"])


def _images(spark, d):
    p = table(spark, d, "pages").where("html is not null")
    path = F.concat(F.when(F.length("html") % 9 == 0, "../").when(F.length("html") % 11 == 0, "C:/").otherwise("a/"), F.col("page_id").cast("string"), F.lit(".png"))
    return p.select("page_id", path.alias("path"), F.concat(F.lit("i"), (F.length("html") % 1000).cast("string")).alias("image_id"), F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"), (F.length("html") % 13).alias("width"), (F.length("html") % 17).alias("height"), F.length("html").alias("n"))


def cn13_pending_problems(spark, d):
    rows = _images(spark, d).withColumn("role", F.when(F.col("n") % 5 == 0, "val").otherwise(gates.PENDING_ROLE)).withColumn("sha256", F.when(F.col("n") % 6 == 0, F.substring("sha256", 2, 60)).otherwise(F.col("sha256")))
    run = rows.agg(F.lit(gates.PENDING_STATE).alias("annotation_state"), F.when(F.max("n") > 10_000_000, "complete").otherwise("running").alias("status"), F.lit(gates.PENDING_ROLE).alias("role"), F.lit(ONTOLOGY.upper()).alias("ontology_sha256"), F.lit(None).cast("boolean").alias("automatic_promotion"))
    return gates.pending_problems(run, rows, ONTOLOGY).select("field", "key")


def _review(spark, d):
    pending = _images(spark, d)
    state = F.element_at(F.array(*map(F.lit, (*gates.KEPT_DISPOSITIONS, gates.EMPTY_DISPOSITION, gates.REJECTED, "later"))), (F.col("n") % 5 + 1).cast("int"))
    reviewed = pending.where("n % 19 <> 0").withColumn("disposition", state).withColumn("width", F.when(F.col("n") % 8 == 0, F.col("width") + 1).otherwise(F.col("width")))
    exported = pending.where("n % 23 <> 0").select(F.col("page_id").alias("id"), "path", "width", F.when(F.col("n") % 10 == 0, 0).otherwise(F.col("height")).alias("height"))
    annotations = table(spark, d, "events").select((F.col("user_id") * 3).alias("image_id"), "event_id")
    return pending, reviewed, exported, annotations


def cn12_promotion_problems(spark, d):
    return gates.promotion_problems(*_review(spark, d))


def cn12_reviewed_train(spark, d):
    _, *rest = _review(spark, d)
    return gates.reviewed_train(*rest).select("event_id", "path", "own_image_id", "sha256")


def rc14_threshold_problems(spark, d):
    """An evaluation for each source of documents; its part, policy and figures come from its documents."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("m"))
    is_test = F.col("n") % 2 == 0
    policy = F.struct(
        F.when(is_test, gates.TEST_STATE).otherwise(gates.VALIDATION_STATE).alias("status"), F.when(F.col("m") % 3 > 0, gates.TEST_USE).alias("usage"), (F.col("m") % 4 == 0).alias("test_data_used"), F.lit(False).alias("test_data_used_for_selection")
    )
    off = F.struct(F.lit(gates.TEST_STATE).alias("status"), F.when(F.col("m") % 5 == 0, 0.5).alias("confidence"))
    metrics = F.when(F.col("m") % 7 > 3, F.create_map(F.lit("best_f1"), F.lit(0.5))).otherwise(F.create_map(F.lit("f1"), F.lit(0.5)))
    rows = rows.select(
        F.concat_ws(":", "source", F.when(is_test, "test").otherwise("val")).alias("name"), F.when(is_test, "test").otherwise("val").alias("split"), policy.alias("policy"), policy.alias("final_policy"), metrics.alias("metrics"), off.alias("calibration"),
        F.array(off, off).alias("class_calibrations"), F.create_map(F.when(F.col("n") % 3 == 0, "pseudo_label_recall").otherwise("nms"), F.lit("0.5")).alias("protocol"), (F.col("n") % 5 == 0).alias("has_threshold_file"),
    )
    return gates.threshold_problems(rows).groupBy("split", "field").agg(F.count("*").alias("n"))


def cn15_proposal_problems(spark, d):
    """A proposal for most pages and some twice; its boxes, groups and states come from the pages."""
    n = F.length("html")
    eligible = table(spark, d, "pages").select(F.col("page_id").alias("source_page_id"), F.concat(F.lit("g"), (F.col("page_id") % 9).cast("string")).alias("leakage_group_id"), (n % 60 + 20).alias("width"), (n % 50 + 20).alias("height"), n.alias("n")).where("n % 12 <> 0")
    made = table(spark, d, "pages").select(F.col("page_id").alias("source_page_id"), F.length("html").alias("n")).where("n % 7 <> 0")
    made = made.unionByName(made.where("n % 15 = 0"))
    bbox = F.when(F.col("n") % 8 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.col("n") % 30 - 1, F.col("n") % 20, F.col("n") % 25, F.lit(10)))
    marks = F.when(F.col("n") % 5 == 0, F.create_map(F.lit("occluded"), F.lit(True))).otherwise(F.create_map(F.lit("truncated"), F.when(F.col("n") % 11 > 0, True), F.lit("occluded"), F.lit(False)))
    state = F.when(F.col("n") % 6 == 0, "REVIEWED").otherwise(gates.REVIEW_STATE)
    made = made.select("source_page_id", F.concat(F.lit("g"), ((F.col("source_page_id") + (F.col("n") % 10 == 0).cast("int")) % 9).cast("string")).alias("leakage_group_id"), bbox.alias("bbox"), marks.alias("attributes"), state.alias("review_state"))
    head = spark.range(1).select(F.lit(gates.DRAFT).alias("status"), F.lit("other").alias("class_name"), F.lit(ONTOLOGY).alias("ontology_sha256"), F.lit(False).alias("human_review_completed"), F.lit(True).alias("ground_truth"), F.lit(None).cast("boolean").alias("training_use_allowed"))
    return gates.proposal_problems(head, made, eligible, "board", ONTOLOGY).select("field", "key")


def cn19_thresholds(spark, d):
    """A class for each source of documents, some without a figure, twice or out of range, and one for all."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    by_class = rows.select(F.when(F.col("n") % 7 > 0, F.col("source")).otherwise("").alias("category_name"), F.when(F.col("n") % 3 > 0, F.col("m") / 4000).alias("confidence"))
    return gates.calibration_thresholds(by_class.unionByName(by_class.limit(0)), rows.agg((F.min("m") / 10_000).alias("confidence")))


def cn20_resume_problems(spark, d):
    """Records of pages and the files that are there."""
    n = F.length("html")
    p = table(spark, d, "pages").where("html is not null").select("page_id", n.alias("n"), F.sha2(F.encode("html", "UTF-8"), 256).alias("h"), F.sha1(F.encode("html", "UTF-8")).alias("s"), F.octet_length(F.encode("html", "UTF-8")).alias("b"))
    at = lambda k, bad, good: F.when(F.col("n") % k == 0, bad).otherwise(good)
    path = F.concat(F.lit("board/"), (F.col("n") % 3000).cast("string"), F.lit(".jpg"))
    records = p.select(
        (F.col("n") % 4000).alias("source_page_id"), path.alias("relative_path"), at(9, F.lit("x"), F.upper("h")).alias("sha256"), at(10, F.col("b") + 1, F.col("b")).alias("bytes"), at(11, F.lit("NEW"), F.lit(gates.COLLECTED)).alias("status"),
        at(13, F.lit("other"), F.lit("board")).alias("class_name"), at(14, F.lit(None), F.lit(gates.REVIEW_STATE)).alias("qa_status"), at(4, F.lit(1), at(33, F.lit(3), F.lit(2))).alias("schema_version"), F.col("h").alias("config_sha256"),
        at(15, F.lit(None), F.col("h")).alias("metadata_sha256"), (F.col("n") % 16).alias("revision_id"), at(17, F.lit("2024-13-01T00:00:00Z"), F.lit("2024-01-01T00:00:00Z")).alias("image_timestamp"), at(18, F.upper("s"), F.col("s")).alias("source_sha1"),
        F.lit("CC0").alias("license"), at(19, F.lit("ftp://x"), F.lit("https://x.org/y")).alias("license_url"), F.lit("free").alias("usage_terms"), at(20, F.lit(" "), F.lit("a")).alias("artist"), F.lit(None).cast("string").alias("credit"),
        at(21, F.lit("ALLOWED"), F.lit(gates.COLLECTED_USE)).alias("training_eligibility"),
    )
    files = p.where("n % 22 <> 0").groupBy(path.alias("relative_path")).agg(F.min("h").alias("sha256"), F.min("b").alias("bytes"))
    files = files.unionByName(p.where("n % 23 = 0").select(F.concat(F.lit("board/new"), F.col("page_id").cast("string")).alias("relative_path"), F.col("h").alias("sha256"), F.col("b").alias("bytes")))
    return gates.resume_problems(records, files, "board").groupBy("field").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def rc23_evaluation_problems(spark, d):
    """An evaluation for each segment's customers: its fields come from them, its artifacts are their orders' clerks."""
    c = table(spark, d, "customer").withColumn("split", F.concat_ws("/", F.when(F.col("c_custkey") % 4 == 0, "val").otherwise("test"), "c_mktsegment", (F.col("c_custkey") % 7).cast("string")))
    n, k = F.col("n"), F.col("k")
    e = c.groupBy("split").agg(F.count("*").alias("n"), F.max("c_custkey").alias("k"))
    pairs = lambda x: F.create_map(*[y for name, v in x.items() for y in (F.lit(name), v)])
    passed = lambda by: F.when(k % by > 0, "PASS").otherwise("FAIL")
    evaluations = e.select(
        "split", F.when(n % 5 > 0, 1).otherwise(2).alias("schema_version"), passed(6).alias("status"), F.lit("formal").alias("mode"), F.when(n % 4 > 0, "onnx").otherwise("torch").alias("framework"), F.lit("fixed_batch1_fp32_onnxruntime").alias("profile"),
        pairs({"protocol_binding": passed(8), "split_binding": F.lit("PASS")}).alias("bindings"), F.sha2(F.when(n % 3 > 0, "split").otherwise(""), 256).alias("assignment_sha256"), F.when(k % 9 > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("names"),
        pairs({"batch": F.when(k % 5 > 0, "1").otherwise("2")}).alias("protocol"), (n - F.when(k % 11 == 0, 1).otherwise(0)).alias("image_count"),
    )
    artifacts = c.select("split", F.lit("image").alias("name"), F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256"))
    found = F.when(F.col("c_custkey") % 50 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("c_name", 256))
    files = c.where("c_custkey % 40 <> 9").select(F.col("c_custkey").cast("string").alias("path"), found.alias("sha256"), (F.col("c_custkey") % 60 == 5).alias("generated"))
    return gates.evaluation_problems(evaluations, {"framework": "onnx", "names": ["a", "b"], "protocol": {"batch": "1"}}, artifacts, files).groupBy("split", "field").agg(F.count("*").alias("problems"))


def _ingest(spark, d):
    """A document for each of twenty archives: pages as its images, events as its annotations."""
    p = table(spark, d, "pages").select("page_id", F.coalesce(F.length("html"), F.lit(0)).alias("n"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    archive = lambda c: F.concat(F.lit("a"), (c % 20).cast("string"), F.lit(".zip"))
    name = F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    image = F.struct(F.col("page_id").alias("id"), name.alias("file_name"), (F.col("n") % 50 + 1).alias("width"), (F.col("page_id") % 40 + 1).alias("height"))
    images = p.groupBy(archive(F.col("page_id")).alias("archive")).agg(F.sort_array(F.collect_list(image)).alias("images"))
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 7 % 300).alias("image_id"))
    box = F.array(F.col("event_id") % 30, F.col("event_id") % 20, 1 + F.col("event_id") % 9, 1 + F.col("event_id") % 7)
    note = F.struct(F.col("event_id").alias("id"), "image_id", (F.col("event_id") % 4).alias("category_id"), box.alias("bbox"), F.when(F.col("event_id") % 23 == 0, 1).otherwise(0).alias("iscrowd"))
    notes = e.groupBy(archive(F.col("image_id")).alias("archive")).agg(F.sort_array(F.collect_list(note)).alias("annotations"))
    kinds = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(("board", "Chip", "cat"))])
    both = images.join(notes, "archive", "left").select("archive", F.lit("x.json").alias("member"), F.to_json(F.struct("images", F.coalesce("annotations", F.array().cast(notes.schema["annotations"].dataType)).alias("annotations"), kinds.alias("categories"))).alias("text"))
    off = F.when(F.col("page_id") % 13 == 0, 2).otherwise(1)
    probes = p.where("page_id % 19 <> 0").select(archive(F.col("page_id")).alias("archive"), name.alias("member"), "sha256", (F.col("n") % 50 + off).alias("width"), (F.col("page_id") % 40 + 1).alias("height"), (F.col("page_id") % 17 > 0).alias("decode_ok"))
    return ingest.ingested(both, probes, {"board": (0, "board"), "Chip": (1, "chip")})


def cn10_ingest_problems(spark, d):
    return _ingest(spark, d)[0].groupBy("archive", "problem").agg(F.count("*").alias("n"))


def cn10_ingested(spark, d):
    """Annotations that broke no rule, and how many images of an archive hold them, by class."""
    _, images, annotations = _ingest(spark, d)
    own = annotations.select("archive", "image_id", "category_id", "area")
    return own.groupBy("archive", "category_id").agg(F.count("*").alias("instances"), F.count_distinct("image_id").alias("images"), F.sum("area").alias("area"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:2] in ("rc", "cn") and k[2].isdigit()}

_FIELDS = ["epochs", "batch", "amp", "test_sha256"]
_SQL_RELEASES = """g AS (SELECT event_type AS model, CAST(user_id % 5 + 41 AS VARCHAR) AS s, count(*) AS n, max(event_id) AS last, min(value) AS low, max(value) AS high, avg(value) AS mean FROM events GROUP BY 1, 2),
r AS (SELECT *, model || '/' || seed AS run_id FROM (SELECT *, CASE WHEN last % 5 = 0 THEN '"' || s || '"' ELSE s END AS seed, CASE WHEN high > 150 THEN '100' ELSE '99' END AS epochs, CASE WHEN low < 0.5 THEN '8' ELSE '16' END AS batch,
 CASE WHEN last % 7 > 0 THEN 'true' ELSE 'null' END AS amp, sha256(model) AS test_sha256 FROM g)),
q AS (SELECT field, count(DISTINCT v) AS n_values FROM (SELECT unnest(['epochs', 'batch', 'amp', 'test_sha256']) AS field, unnest([epochs, batch, amp, test_sha256]) AS v FROM r) GROUP BY 1
 UNION ALL SELECT 'seed_set', count(DISTINCT x) FROM (SELECT string_agg(DISTINCT seed, ',' ORDER BY seed) AS x FROM r GROUP BY model)),
w AS (SELECT unnest(['click', 'view', 'other']) AS model), k AS (SELECT unnest(['41', '42', '43']) AS seed),
have AS (SELECT model, seed, count(*) AS n FROM r GROUP BY 1, 2),
gap AS (SELECT w.model, k.seed FROM w CROSS JOIN k LEFT JOIN have h ON h.model = w.model AND h.seed = k.seed WHERE h.n IS DISTINCT FROM 1 UNION ALL SELECT model, seed FROM have WHERE model NOT IN (SELECT model FROM w) OR seed NOT IN (SELECT seed FROM k))"""
_SQL_IMAGES = """i AS (SELECT page_id, CASE WHEN length(html) % 9 = 0 THEN '../' WHEN length(html) % 11 = 0 THEN 'C:/' ELSE 'a/' END || page_id || '.png' AS path, 'i' || (length(html) % 1000) AS image_id, sha256(html) AS sha256, length(html) % 13 AS width, length(html) % 17 AS height, length(html) AS n FROM pages WHERE html IS NOT NULL)"""
_SQL_REVIEW = f"""{_SQL_IMAGES}, v AS (SELECT page_id, path, image_id, sha256, CASE WHEN n % 8 = 0 THEN width + 1 ELSE width END AS width, height, ['approved', 'corrected', 'confirmed_empty', 'rejected', 'later'][n % 5 + 1] AS disposition FROM i WHERE n % 19 <> 0),
x AS (SELECT page_id AS id, path, width, CASE WHEN n % 10 = 0 THEN 0 ELSE height END AS height FROM i WHERE n % 23 <> 0),
a AS (SELECT user_id * 3 AS image_id, event_id FROM events)"""

_SQL_INGEST = """pg AS (SELECT page_id, 'a' || page_id % 20 || '.zip' AS archive, coalesce(length(html), 0) % 50 + 1 AS w, page_id % 40 + 1 AS h, coalesce(html, '') AS html, page_id % 19 <> 0 AS there FROM pages),
im AS (SELECT *, w + CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS rw, CASE WHEN NOT there THEN 'member_missing' WHEN page_id % 17 = 0 THEN 'not_decoded' WHEN page_id % 13 = 0 THEN 'dimensions' WHEN count(*) OVER (PARTITION BY archive, html, there) > 1 THEN 'repeated_content' END AS problem FROM pg),
ev AS (SELECT event_id, event_id * 7 % 300 AS image_id, event_id % 4 AS k, event_id % 30 AS x, event_id % 20 AS y, 1 + event_id % 9 AS w, 1 + event_id % 7 AS h FROM events),
an AS (SELECT ev.*, 'a' || image_id % 20 || '.zip' AS archive, im.problem AS image_problem, CASE WHEN im.page_id IS NULL THEN 'unknown_image' WHEN k = 3 THEN 'unknown_category' WHEN event_id % 23 = 0 THEN 'crowd' WHEN im.there AND (ev.x + ev.w > im.rw OR ev.y + ev.h > im.h) THEN 'bbox' END AS problem
 FROM ev LEFT JOIN im ON im.page_id = image_id WHERE 'a' || image_id % 20 || '.zip' IN (SELECT archive FROM im))"""

SQL = {
    "cn15_proposal_problems": """WITH e AS (SELECT page_id AS id, 'g' || (page_id % 9) AS grp, length(html) % 60 + 20 AS width, length(html) % 50 + 20 AS height FROM pages WHERE length(html) % 12 <> 0),
m0 AS (SELECT page_id AS id, length(html) AS n FROM pages WHERE length(html) % 7 <> 0), m AS (SELECT *, 'g' || ((id + CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END) % 9) AS own, n % 30 - 1 AS x, n % 20 AS y, n % 25 AS w, 10 AS h, n % 8 <> 0 AS four FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE n % 15 = 0)),
j AS (SELECT m.*, e.grp, e.width, e.height FROM m JOIN e USING (id))
SELECT unnest(['class_name', 'ground_truth', 'training_use_allowed']) AS field, 'proposal' AS key
UNION ALL SELECT 'leakage_group_id', id::VARCHAR FROM j WHERE own <> grp UNION ALL SELECT 'bbox', id::VARCHAR FROM j WHERE NOT four OR x < 0
UNION ALL SELECT 'positive_area', id::VARCHAR FROM j WHERE NOT four OR w <= 0 UNION ALL SELECT 'inside', id::VARCHAR FROM j WHERE NOT four OR x + w > width OR y + h > height
UNION ALL SELECT 'attributes', id::VARCHAR FROM j WHERE n % 5 = 0 OR n % 11 = 0 UNION ALL SELECT 'review_state', id::VARCHAR FROM j WHERE n % 6 = 0
UNION ALL SELECT 'repeated_page', id::VARCHAR FROM m GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'missing_page', id::VARCHAR FROM e WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT DISTINCT 'unexpected_page', id::VARCHAR FROM m WHERE id NOT IN (SELECT id FROM e)""",
    "cn19_thresholds": """WITH r AS (SELECT source, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY 1), t AS (SELECT CASE WHEN n % 7 > 0 THEN source ELSE '' END AS class_name, m / 4000 AS threshold FROM r WHERE n % 3 > 0 UNION ALL SELECT '__global__', min(m) / 10000 FROM r HAVING min(m) IS NOT NULL)
SELECT class_name, threshold, CASE WHEN class_name = '' THEN 'invalid_category' WHEN count(*) OVER (PARTITION BY class_name) > 1 THEN 'repeated_category' WHEN NOT threshold BETWEEN 0 AND 1 THEN 'out_of_range' END AS problem FROM t""",
    "cn20_resume_problems": """WITH p AS (SELECT page_id, length(html) AS n, sha256(html) AS h, octet_length(encode(html)) AS b, 'board/' || (length(html) % 3000) || '.jpg' AS path FROM pages WHERE html IS NOT NULL),
r AS (SELECT *, n % 4 = 0 AS old, CASE WHEN n % 9 = 0 THEN 'x' ELSE h END AS sha, CASE WHEN n % 10 = 0 THEN b + 1 ELSE b END AS bytes FROM p),
f AS (SELECT path, min(h) AS h, min(b) AS b FROM p WHERE n % 22 <> 0 GROUP BY 1 UNION ALL SELECT 'board/new' || page_id, h, b FROM p WHERE n % 23 = 0),
x AS (SELECT 'status' AS field, path AS key FROM r WHERE n % 11 = 0 UNION ALL SELECT 'class_name', path FROM r WHERE n % 13 = 0 UNION ALL SELECT 'qa_status', path FROM r WHERE n % 14 = 0 UNION ALL SELECT 'page_id', path FROM r WHERE n % 4000 = 0
UNION ALL SELECT 'sha256', path FROM r WHERE n % 9 = 0 UNION ALL SELECT 'newer_schema', path FROM r WHERE NOT old AND n % 33 = 0 UNION ALL SELECT 'metadata_hash', path FROM r WHERE NOT old AND n % 15 = 0
UNION ALL SELECT 'page_revision', path FROM r WHERE NOT old AND n % 16 = 0 UNION ALL SELECT 'image_timestamp', path FROM r WHERE NOT old AND n % 17 = 0 UNION ALL SELECT 'source_sha1', path FROM r WHERE NOT old AND n % 18 = 0
UNION ALL SELECT 'license_metadata', path FROM r WHERE NOT old AND n % 20 = 0 UNION ALL SELECT 'license_url', path FROM r WHERE NOT old AND n % 19 = 0 UNION ALL SELECT 'training_eligibility', path FROM r WHERE NOT old AND n % 21 = 0
UNION ALL SELECT 'repeated_source_page_id', (n % 4000)::VARCHAR FROM r GROUP BY n % 4000 HAVING count(*) > 1 UNION ALL SELECT 'repeated_sha256', sha FROM r GROUP BY sha HAVING count(*) > 1 UNION ALL SELECT 'repeated_relative_path', path FROM r GROUP BY path HAVING count(*) > 1
UNION ALL SELECT CASE WHEN f.h IS NULL THEN 'file_missing' WHEN r.sha <> f.h THEN 'hash_mismatch' WHEN r.bytes <> f.b THEN 'size_mismatch' END, r.path FROM r LEFT JOIN f USING (path)
UNION ALL SELECT 'unmanifested_file', path FROM f WHERE path NOT IN (SELECT path FROM r))
SELECT field, count(*) AS n, min(key) AS first_key FROM x WHERE field IS NOT NULL GROUP BY 1""",
    "rc2_differing_settings": f"WITH {_SQL_RELEASES} SELECT * FROM q WHERE n_values > 1",
    "rc2_release_blockers": f"""WITH {_SQL_RELEASES}
SELECT 'run_seed_types' AS field, run_id FROM r WHERE NOT regexp_full_match(seed, '-?[0-9]+')
UNION ALL SELECT 'complete_non_smoke_runs', run_id FROM r WHERE n % 7 = 0 OR n % 11 = 0
UNION ALL SELECT 'expected:epochs', run_id FROM r WHERE epochs <> '100' UNION ALL SELECT 'expected:batch', run_id FROM r WHERE batch <> '8'
UNION ALL SELECT 'completed_epoch_rows', run_id FROM r WHERE NOT high > 150
UNION ALL SELECT 'run_evidence:latency_exists', run_id FROM r WHERE n % 2 <> 0 UNION ALL SELECT 'run_evidence:checkpoint_exists', run_id FROM r WHERE n % 3 = 0
UNION ALL SELECT 'final_metric:ap75', run_id FROM r WHERE last % 3 = 0 UNION ALL SELECT 'final_metric:tp', run_id FROM r WHERE last % 4 = 0
UNION ALL SELECT 'protocol_comparability', NULL FROM (SELECT 1 FROM q WHERE n_values > 1 LIMIT 1)
UNION ALL SELECT 'model_set', NULL FROM (SELECT count(*) FILTER (model NOT IN (SELECT model FROM w)) AS o, count(DISTINCT model) FILTER (model IN (SELECT model FROM w)) AS m FROM r) WHERE o > 0 OR m <> 3
UNION ALL SELECT 'complete_model_seed_matrix', NULL FROM (SELECT 1 FROM gap LIMIT 1) UNION ALL SELECT 'duplicate_model_seed_pair', NULL FROM (SELECT 1 FROM have WHERE n > 1 LIMIT 1)
UNION ALL SELECT DISTINCT 'seed_set:' || model, NULL::VARCHAR FROM (SELECT model FROM gap WHERE model IN (SELECT model FROM w) AND (model, seed) NOT IN (SELECT (model, seed) FROM have WHERE n > 1 AND seed IN (SELECT seed FROM k)))""",
    "cn13_pending_problems": f"""WITH {_SQL_IMAGES}, m AS (SELECT *, n % 5 = 0 AS val, CASE WHEN n % 6 = 0 THEN substr(sha256, 2, 60) ELSE sha256 END AS s FROM i)
SELECT 'status' AS field, 'run' AS key FROM (SELECT max(n) AS n FROM m) WHERE n IS NULL OR n <= 10000000 UNION ALL SELECT 'automatic_promotion', 'run'
UNION ALL SELECT 'safe_path', path FROM m WHERE path LIKE '../%' OR path LIKE 'C:%' UNION ALL SELECT 'image_role', path FROM m WHERE val
UNION ALL SELECT 'positive_width', path FROM m WHERE width <= 0 UNION ALL SELECT 'positive_height', path FROM m WHERE height <= 0 UNION ALL SELECT 'sha256', path FROM m WHERE NOT regexp_full_match(s, '[0-9a-f]{{64}}')
UNION ALL SELECT 'repeated_path', path FROM m GROUP BY path HAVING count(*) > 1 UNION ALL SELECT 'repeated_image_id', image_id FROM m GROUP BY image_id HAVING count(*) > 1
UNION ALL SELECT 'images', 'run' WHERE NOT EXISTS (SELECT 1 FROM m)""",
    "cn12_promotion_problems": f"""WITH {_SQL_REVIEW}, c AS (SELECT x.path, count(*) AS n FROM a JOIN x ON x.id = a.image_id GROUP BY 1), b AS (SELECT i.*, v.image_id AS ri, v.sha256 AS rs, v.width AS rw, v.height AS rh FROM i JOIN v USING (path))
SELECT 'unresolved_disposition' AS field, path AS key FROM v WHERE disposition NOT IN ('approved', 'corrected', 'confirmed_empty', 'rejected')
UNION ALL SELECT 'repeated_review', path FROM v GROUP BY path HAVING count(*) > 1 UNION ALL SELECT 'repeated_export', path FROM x GROUP BY path HAVING count(*) > 1 UNION ALL SELECT 'repeated_export_id', id::VARCHAR FROM x GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'missing_review', path FROM i WHERE path NOT IN (SELECT path FROM v) UNION ALL SELECT DISTINCT 'missing_export', path FROM i WHERE path NOT IN (SELECT path FROM x)
UNION ALL SELECT DISTINCT 'unexpected_review', path FROM v WHERE path NOT IN (SELECT path FROM i) UNION ALL SELECT DISTINCT 'unexpected_export', path FROM x WHERE path NOT IN (SELECT path FROM i)
UNION ALL SELECT 'identity:image_id', path FROM b WHERE image_id <> ri UNION ALL SELECT 'identity:sha256', path FROM b WHERE sha256 <> rs UNION ALL SELECT 'identity:width', path FROM b WHERE width <> rw UNION ALL SELECT 'identity:height', path FROM b WHERE height <> rh
UNION ALL SELECT 'export:width', i.path FROM i JOIN x USING (path) WHERE i.width <> x.width UNION ALL SELECT 'export:height', i.path FROM i JOIN x USING (path) WHERE i.height <> x.height
UNION ALL SELECT 'unknown_image', image_id::VARCHAR FROM a WHERE image_id NOT IN (SELECT id FROM x)
UNION ALL SELECT 'empty_with_annotations', v.path FROM v JOIN c USING (path) WHERE disposition = 'confirmed_empty' UNION ALL SELECT 'approved_without_annotations', v.path FROM v LEFT JOIN c USING (path) WHERE disposition IN ('approved', 'corrected') AND c.n IS NULL
UNION ALL SELECT 'nothing_included', 'review' WHERE NOT EXISTS (SELECT 1 FROM v WHERE disposition <> 'rejected')""",
    "cn12_reviewed_train": f"WITH {_SQL_REVIEW} SELECT event_id, x.path, v.image_id AS own_image_id, v.sha256 FROM a JOIN x ON x.id = a.image_id JOIN v ON v.path = x.path WHERE disposition <> 'rejected'",
    "rc14_threshold_problems": """WITH e AS (SELECT source, count(*) AS n, max(n_chars) AS m, CASE WHEN count(*) % 2 = 0 THEN 'test' ELSE 'val' END AS split FROM documents GROUP BY 1),
f AS (SELECT split, 'validation_candidate' AS field FROM e WHERE split = 'val' AND m % 4 = 0 UNION ALL SELECT split, 'test_not_for_selection' FROM e WHERE split = 'test' AND m % 3 = 0
UNION ALL SELECT split, 'test_threshold_file' FROM e WHERE split = 'test' AND n % 5 = 0 UNION ALL SELECT split, 'test_best_f1' FROM e WHERE split = 'test' AND m % 7 > 3
UNION ALL SELECT split, unnest(['test_calibration', 'test_class_calibration']) FROM e WHERE split = 'test' AND m % 5 = 0 UNION ALL SELECT split, 'test_calibration_targets' FROM e WHERE split = 'test' AND n % 3 = 0)
SELECT split, field, count(*) AS n FROM f GROUP BY 1, 2""",
    "rc23_evaluation_problems": """WITH c AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'test' END || '/' || c_mktsegment || '/' || c_custkey % 7 AS split FROM customer), e AS (SELECT split, count(*) AS n, max(c_custkey) AS k,
 count(*) FILTER (c_custkey % 60 = 5 OR c_custkey % 40 = 9) AS made FROM c GROUP BY 1)
SELECT split, unnest(list_filter([CASE WHEN n % 5 = 0 THEN 'schema_version' END, CASE WHEN k % 6 = 0 THEN 'status' END, CASE WHEN n % 4 = 0 THEN 'framework' END, CASE WHEN k % 8 = 0 THEN 'protocol_binding' END,
 CASE WHEN k % 9 = 0 THEN 'category_names' END, CASE WHEN k % 5 = 0 THEN 'protocol:batch' END, CASE WHEN k % 11 = 0 THEN 'image_count' END, CASE WHEN made > 0 THEN 'generated_images' END], lambda x: x IS NOT NULL)) AS field, CAST(1 AS BIGINT) AS problems FROM e
UNION ALL SELECT split, 'artifact:image', count(*) FROM c WHERE c_custkey % 40 = 9 OR c_custkey % 50 = 3 GROUP BY 1""",
    "cn10_ingest_problems": f"WITH {_SQL_INGEST} SELECT archive, problem, count(*) AS n FROM (SELECT archive, problem FROM im UNION ALL SELECT archive, problem FROM an UNION ALL SELECT DISTINCT archive, 'label_not_allowed' FROM im) WHERE problem IS NOT NULL GROUP BY 1, 2",
    "cn10_ingested": f"WITH {_SQL_INGEST} SELECT archive, CAST(k + 1 AS INTEGER) AS category_id, count(*) AS instances, count(DISTINCT image_id) AS images, CAST(sum(w * h) AS DOUBLE) AS area FROM an WHERE problem IS NULL AND k < 2 AND image_problem IS NULL GROUP BY 1, 2",
}
