"""Bindings between data and its evidence, gates of releases, and forms of records, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions import geometry as g
from sievemark.functions import identity, text
from sievemark.operators import canonical, compare, matching, review
from sievemark.plans import evaluation
from sievemark.plans.comparison import _SQL_RUNS, METRICS, _runs
from sievemark.plans.curation import PATH, SQL_BOXES, _boxes, _docs
from sievemark.session import table


def _names(d: DataFrame, column: str) -> DataFrame:
    return d.select(F.col(column).alias("class_name")).distinct()


def pr2_source_of_path(spark, d):
    p = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.expr(PATH))
    return _docs(spark, d).select("doc_id", text.source_of_path(p).alias("source_name"))


def pr3_split_of_path(spark, d):
    p = F.concat(F.element_at(F.array(*map(F.lit, ("train", "val", "test", "extra"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("/x.jpg"))
    return _docs(spark, d).select("doc_id", text.split_of_path(p).alias("split"))


def pr10_round_trip_boxes(spark, d):
    """Boxes that went through unit centres and back, every third moved a little: whether they are within a tolerance that
    grows with the image."""
    unit = g.to_unit_centre(g.box("x", "y", "w", "h"), F.lit(64.0), F.lit(48.0))
    b = _boxes(spark, d).select("id", "x", "y", "w", "h", *[c.alias(f"u{i}") for i, c in enumerate(unit)])
    moved = F.when(F.col("id") % 3 == 2, 8e-5).otherwise(F.col("id") % 3 * 3e-5)
    back = [(F.col("u0") - F.col("u2") / 2) * 64 + moved, (F.col("u1") - F.col("u3") / 2) * 48, F.col("u2") * 64, F.col("u3") * 48]
    off = F.greatest(*[F.abs(x - F.col(c)) for x, c in zip(back, ("x", "y", "w", "h"), strict=True)])
    return b.select("id", (off <= 1e-6 * 64).alias("same"))


def pr12_iou_xyxy(spark, d):
    """Each box with one of its size, moved."""
    a = g.box("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    b = g.box(F.col("x") + 2.0, F.col("y") + 1.0, F.col("x") + F.col("w") + 2.0, F.col("y") + F.col("h") + 1.0)
    return _boxes(spark, d).select("id", g.iou_xyxy(a, b).alias("iou"))


def pr13_iou_xywh(spark, d):
    return _boxes(spark, d).select("id", g.iou_xywh(g.box("x", "y", "w", "h"), g.box(F.col("x") + 2.0, F.col("y") + 1.0, "w", "h")).alias("iou"))


def pr37_output_split(spark, d):
    return _docs(spark, d).select("doc_id", text.output_split(F.col("source"), F.when(F.col("lang") == "de", "bootstrap_train_only").otherwise("keep")).alias("split"))


def pr42_private_strings(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/home/me/"), F.col("source"))).otherwise(F.concat(F.lit("data/"), F.col("source")))
    return _docs(spark, d).select("doc_id", text.has_local_path(raw).alias("private"))


def pr47_known_stat(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", text.known_stat(raw).alias("stat"))


def hs5_record_envelopes(spark, d):
    """Canonical JSON of a record in an envelope with its kind, without an end of line."""
    r = table(spark, d, "region")
    return r.select("r_regionkey", identity.hash_of_json(F.struct(F.lit("region").alias("kind"), F.struct("r_name", "r_regionkey").alias("record")), False).alias("sha256"))


def hs6_snapshot_hash(spark, d):
    """Metadata with dates as text."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", identity.hash_of_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("priority")), False).alias("sha256"))


def ag17_latency(spark, d):
    return compare.latency_summary(table(spark, d, "events").where("event_type <> 'error'"), "user_id", "value").select("user_id", "n", "p50", "p95", "fps")


def wn5_chosen_threshold(spark, d):
    return matching.choose_threshold(matching.threshold_sweep(*evaluation._finer(spark, d)), 0.3, 0.2).select("category", "confidence")


def cn3_coco_split(spark, d):
    """Records of one split's COCO documents, and how many there are of each class."""
    b = _boxes(spark, d).where("image_id % 4 = 1")
    images = b.select(F.col("image_id").alias("id"), F.concat(F.lit("val/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name")).distinct()
    names = _names(b, "category").select(F.col("class_name").alias("id"), F.concat(F.lit("c_"), F.col("class_name")).alias("name"))
    rows = b.select("image_id", F.col("category").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"))
    return canonical.records_of_coco(images, rows, names).groupBy("class_name").agg(F.count("*").alias("n"), F.count_distinct("image_key").alias("images"))


def cn5_class_map(spark, d):
    """Class ids from lines of a map, found by name; names that the map lacks get none."""
    lines = spark.range(1).select(F.explode(F.split(F.lit("0: click\n1: view\n\n2: purchase "), "\n")).alias("line")).where("trim(line) <> ''")
    names = lines.select(F.trim(F.split("line", ":")[0]).cast("int").alias("class_id"), F.trim(F.split("line", ":")[1]).alias("event_type"))
    return table(spark, d, "events").join(F.broadcast(names), "event_type", "left").groupBy("event_type", "class_id").agg(F.count("*").alias("n"))


def _evidence(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", identity.sha256_text(F.col("html")).alias("sha256"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("bytes"))


def cn7_live_data(spark, d):
    """Pages against the evidence of an earlier reading: hashes or sizes that differ, pages gone or new."""
    live = _evidence(spark, d)
    then = live.where("page_id % 13 <> 4").withColumn("sha256", F.when(F.col("page_id") % 11 == 3, F.lit("?")).otherwise(F.col("sha256")))
    fields = compare.field_mismatches(then, live, "page_id", ["sha256", "bytes"]).select("page_id", F.col("field").alias("problem"))
    return fields.unionByName(compare.set_difference(then, live, "page_id"))


def cn9_round_trip_verdict(spark, d):
    """One row: records that came back changed, and the verdict."""
    rows = _boxes(spark, d).select(F.col("image_id").cast("string").alias("image_key"), F.col("category").alias("class_name"), *[F.col(c).cast("string").alias(c) for c in ("x", "y", "w", "h")], "id")
    back = rows.withColumn("class_name", F.when(F.col("id") % 50 == 3, "changed").otherwise(F.col("class_name")))
    found = canonical.equivalence(rows, back)
    return found.select("left_only", "right_only", F.when(F.col("equal"), "PASS").otherwise("FAIL").alias("verdict"))


def cn10_archive_core(spark, d):
    """Members of an archive (pages by their URL's host): what is refused and why, else images and bytes."""
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("name"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("bytes"), (F.col("page_id") % 7).alias("label"))
    twice = p.unionByName(p.where("page_id % 17 = 5"))
    counts = twice.groupBy("name").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.min("label").alias("label"))
    why = F.when(F.col("n") > 1, "duplicate_name").when(F.col("label") == 6, "unknown_label").when(F.col("bytes") < 500, "too_small").otherwise("accepted")
    return counts.groupBy(why.alias("outcome")).agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))


def cn12_promotion_gate(spark, d):
    """Annotations that may be promoted: decided on once, by a decision that accepts them."""
    rows = _docs(spark, d).select("doc_id", "lang")
    decisions = rows.where("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 6 == 1, "reject").otherwise("accept").alias("decision"))
    decisions = decisions.unionByName(decisions.where("doc_id % 30 = 2"))
    n = decisions.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("decision").alias("decision"))
    why = F.when(F.col("n").isNull(), "undecided").when(F.col("n") > 1, "decided_twice").when(F.col("decision") != "accept", "rejected").otherwise("promoted")
    return rows.join(n, "doc_id", "left").groupBy("lang", why.alias("outcome")).agg(F.count("*").alias("n"))


def cn13_pending_run(spark, d):
    """Rules that a pending run's rows must keep before anyone reviews them."""
    rows = evaluation._sides(spark, d)[1]
    rules = {"score_in_range": F.col("score").between(0, 0.97), "positive_size": (F.col("w") > 0) & (F.col("h") > 0), "odd_image": F.col("image_id") % 2 == 1}
    return compare.violations(rows, F.col("id"), rules).groupBy("rule").agg(F.count("*").alias("n"))


def rc14_release_gate(spark, d):
    """Thresholds may come from validation alone, and from enough rows."""
    curve = matching.threshold_sweep(*evaluation._finer(spark, d)).where("category is not null")
    chosen = matching.choose_threshold(curve, 0.3, 0.2).select("category", "confidence")
    rows = chosen.withColumn("part", F.when(F.col("category") == "click", "test").otherwise("val"))
    return compare.violations(rows, F.col("category"), {"not_from_test": F.col("part") != "test", "has_threshold": F.col("confidence").isNotNull()})


def cn16_seed_bundle(spark, d):
    """A bundle of seeds (the first documents of each language by a stable order) against one rebuilt from the data."""
    order = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    rows = _docs(spark, d).select("lang", "doc_id", order.alias("o"))
    rebuilt = matching.top_per_image(rows.select(F.col("lang").alias("image_id"), F.col("doc_id").alias("id"), (-F.conv(F.substring("o", 1, 8), 16, 10).cast("double")).alias("score")), 20)
    members = rebuilt.select(F.col("id").alias("doc_id"))
    return compare.set_difference(members, members.where("doc_id % 5 <> 0"), "doc_id").groupBy("problem").agg(F.count("*").alias("n"))


def cn17_shared_sources(spark, d):
    """Contents that more than one role uses."""
    role = F.element_at(F.array(*map(F.lit, ("teacher", "calibration", "seed"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = _docs(spark, d).select(F.md5(F.encode("text", "UTF-8")).alias("sha"), role.alias("role"))
    return compare.shared_between(rows, "sha", "role")


def cn18_teacher_binding(spark, d):
    """Each model's runs must share their figure and be of known seeds."""
    runs = _runs(spark, d)
    rows = runs.select("model", "seed", (F.col("seed").isin(42, 43)).alias("known"), (F.col("ap50_95") > F.col("ap50")).alias("ordered"))
    return compare.violations(rows, F.concat_ws(":", "model", F.col("seed").cast("string")), {"known_seed": F.col("known"), "ordered_metrics": F.col("ordered")})


def cn22_locked_test(spark, d):
    """Rows of each part against the numbers that a contract locks."""
    parts = table(spark, d, "labels").groupBy(F.when(F.col("quality") == 1, "test").otherwise("train").alias("part")).agg(F.count("*").alias("n"))
    locked = spark.createDataFrame([("test", 10), ("train", -1), ("val", 5)], "part string, locked long")
    status = F.when(F.col("n").isNull(), "missing").when((F.col("locked") >= 0) & (F.col("n") < F.col("locked")), "too_few").otherwise("kept")
    return locked.join(parts, "part", "left").select("part", status.alias("status"))


def rc5_release_policy(spark, d):
    """Rows that a frozen policy leaves out, by its first reason."""
    policy = [F.when(F.col("lang") == "fr", "language"), F.when(F.col("n_chars") < 200, "too_short"), F.when(F.col("source") == "src3", "source")]
    return review.reason_counts(review.funnel(_docs(spark, d).select("doc_id", "lang", "n_chars", "source"), policy))


def rc6_rebuilt(spark, d):
    """A published table of orders by priority against one computed anew."""
    anew = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    published = anew.withColumn("n", F.when(F.col("o_orderpriority").startswith("1"), F.col("n") + 1).otherwise(F.col("n"))).where("not o_orderpriority like '2%'")
    fields = compare.field_mismatches(anew, published, "o_orderpriority", ["n"]).select("o_orderpriority", F.col("field").alias("problem"))
    return fields.unionByName(compare.set_difference(anew, published, "o_orderpriority"))


def rc12_public_scan(spark, d):
    """Rules that each file of a public tree must keep."""
    path = F.concat(F.when(F.col("page_id") % 10 == 3, "../").otherwise(""), F.lit("site/"), F.col("page_id").cast("string"))
    content = F.when(F.col("page_id") % 8 == 1, "see /home/me/x").otherwise(F.lit("plain"))
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), content.alias("content"), F.length("html").alias("n"))
    return compare.violations(rows, F.col("page_id"), {"safe_path": text.is_safe_relative_path(F.col("path")), "no_local_path": ~text.has_local_path(F.col("content")), "not_empty": F.col("n") > 0})


def rc13_published_tree(spark, d):
    """Files of a published tree: those that its list lacks, and those on the list that are gone."""
    files = _docs(spark, d).select(F.expr(PATH).alias("path"), "doc_id")
    return compare.set_difference(files.where("doc_id % 70 <> 6").select("path"), files.where("doc_id % 80 <> 9").select("path"), "path")


def rc15_rationale(spark, d):
    """Nested protocols (a part's fields) as rows of name and text."""
    p = table(spark, d, "part")
    protocols = p.select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("epochs"), F.col("p_brand").alias("batch"), F.struct(F.col("p_type").alias("kind")).alias("data"))).alias("j"))
    rows = protocols.select("p_partkey", F.explode(F.from_json("j", "map<string,string>")).alias("name", "value"))
    return rows.select("p_partkey", "name", F.coalesce(F.get_json_object("value", "$.kind"), "value").alias("value"))


def rc23_formal_evaluation(spark, d):
    """Settings, counts and metrics of an evaluation against its record, by model."""
    runs = _runs(spark, d).groupBy("model").agg(F.count("*").alias("runs"), F.max("last_id").alias("last_id"))
    record = runs.select("model", F.when(F.col("model") == "click", F.col("runs") + 1).otherwise(F.col("runs")).alias("runs"), F.when(F.col("model") == "view", F.lit(0)).otherwise(F.col("last_id")).alias("last_id"))
    both = compare.field_mismatches(record, runs, "model", ["runs", "last_id"]).groupBy("model").agg(F.count("*").alias("n"))
    return runs.select("model").join(both, "model", "left").select("model", F.when(F.col("n").isNull(), "PASS").otherwise("FAIL").alias("status"))


def sk7_original_coco(spark, d):
    """Annotations of a COCO sink, numbered in the order of their boxes within each class."""
    rows = _boxes(spark, d).select("category", F.col("id").alias("box"), "image_id", (F.col("w") * F.col("h")).alias("area"))
    return canonical.coco_ids(rows, "category", "box")


def sk8_pending_coco(spark, d):
    """Pending images with the hash that binds them to their content."""
    rows = table(spark, d, "pages").select(F.lit("pending").alias("status"), "page_id", identity.sha256_text(F.col("html")).alias("sha256"))
    return canonical.coco_ids(rows, "status", "page_id")


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:2] in ("pr", "hs", "ag", "wn", "cn", "rc", "sk") and k[2].isdigit()}

_MOVED = "greatest(0, w - 2) * greatest(0, h - 1)"
_OK = """ok AS (SELECT category, confidence FROM r2 WHERE tp > 0 AND precision >= 0.3 AND precision_wilson_lower_95 >= 0.2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY recall DESC, precision DESC, confidence) = 1),
a AS (SELECT DISTINCT category FROM r2)"""
SQL = {
    "rc14_release_gate": f"""WITH RECURSIVE {evaluation._SQL_CURVE}, {_OK}
SELECT 'not_from_test' AS rule, category AS key FROM a WHERE category = 'click' UNION ALL SELECT 'has_threshold', category FROM a LEFT JOIN ok USING (category) WHERE category IS NOT NULL AND confidence IS NULL""",
    "cn13_pending_run": f"""WITH {SQL_BOXES}, p AS (SELECT * FROM b WHERE NOT is_gt) SELECT rule, count(*) AS n FROM (SELECT 'score_in_range' AS rule FROM p WHERE NOT score BETWEEN 0 AND 0.97 UNION ALL SELECT 'positive_size' FROM p WHERE w <= 0 OR h <= 0 UNION ALL SELECT 'odd_image' FROM p WHERE image_id % 2 <> 1) GROUP BY 1""",
    "cn12_promotion_gate": """SELECT lang, CASE WHEN doc_id % 9 = 0 THEN 'undecided' WHEN doc_id % 30 = 2 THEN 'decided_twice' WHEN doc_id % 6 = 1 THEN 'rejected' ELSE 'promoted' END AS outcome, count(*) AS n FROM documents GROUP BY 1, 2""",
    "pr2_source_of_path": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'local' ELSE source END AS source_name FROM documents",
    "pr3_split_of_path": "SELECT doc_id, ['train', 'val', 'test', 'UNASSIGNED'][doc_id % 4 + 1] AS split FROM documents",
    "pr10_round_trip_boxes": f"WITH {SQL_BOXES}, m AS (SELECT *, ((x + w / 2) / 64 - w / 64 / 2) * 64 + CASE id % 3 WHEN 2 THEN 8e-5 WHEN 1 THEN 3e-5 ELSE 0 END AS x2, ((y + h / 2) / 48 - h / 48 / 2) * 48 AS y2 FROM b) SELECT id, greatest(abs(x2 - x), abs(y2 - y)) <= 64e-6 AS same FROM m",
    "pr12_iou_xyxy": f"WITH {SQL_BOXES} SELECT id, {_MOVED} / (2 * w * h - {_MOVED}) AS iou FROM b",
    "pr13_iou_xywh": f"WITH {SQL_BOXES} SELECT id, {_MOVED} / (2 * w * h - {_MOVED}) AS iou FROM b",
    "pr37_output_split": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'train' ELSE source END AS split FROM documents",
    "pr42_private_strings": "SELECT doc_id, doc_id % 3 = 0 AS private FROM documents",
    "pr47_known_stat": "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND value >= 0 THEN value END AS stat FROM events",
    "hs5_record_envelopes": """SELECT r_regionkey, sha256('{"kind":"region","record":{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}}') AS sha256 FROM region""",
    "hs6_snapshot_hash": """SELECT o_orderkey, sha256('{"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","priority":"' || o_orderpriority || '"}') AS sha256 FROM orders""",
    "ag17_latency": "SELECT user_id, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(value) * 1000.0 / sum(value) AS fps FROM events WHERE event_type <> 'error' GROUP BY 1",
    "wn5_chosen_threshold": f"""WITH RECURSIVE {evaluation._SQL_CURVE}, {_OK}
SELECT a.category, confidence FROM a LEFT JOIN ok ON a.category IS NOT DISTINCT FROM ok.category""",
    "cn3_coco_split": f"WITH {SQL_BOXES} SELECT 'c_' || category AS class_name, count(*) AS n, count(DISTINCT image_id) AS images FROM b WHERE image_id % 4 = 1 GROUP BY 1",
    "cn5_class_map": "SELECT event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS class_id, count(*) AS n FROM events GROUP BY 1",
    "cn7_live_data": """SELECT page_id, 'sha256' AS problem FROM pages WHERE page_id % 13 <> 4 AND page_id % 11 = 3
UNION ALL SELECT page_id, 'unexpected' FROM pages WHERE page_id % 13 = 4""",
    "cn9_round_trip_verdict": f"WITH {SQL_BOXES}, c AS (SELECT count(*) AS n FROM b WHERE id % 50 = 3) SELECT n AS left_only, n AS right_only, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c",
    "cn10_archive_core": """WITH p AS (SELECT page_id, octet_length(encode(html)) AS bytes FROM pages)
SELECT CASE WHEN page_id % 17 = 5 THEN 'duplicate_name' WHEN page_id % 7 = 6 THEN 'unknown_label' WHEN bytes < 500 THEN 'too_small' ELSE 'accepted' END AS outcome, count(*) AS members, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1""",
    "cn16_seed_bundle": """WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY substr(md5('42:' || doc_id), 1, 8), doc_id) AS i FROM documents)
SELECT 'missing' AS problem, count(*) AS n FROM r WHERE i <= 20 AND doc_id % 5 = 0 HAVING count(*) > 0""",
    "cn17_shared_sources": "SELECT md5(text) AS sha, count(DISTINCT doc_id % 3) AS n_groups FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1",
    "cn18_teacher_binding": f"""WITH {_SQL_RUNS} SELECT 'known_seed' AS rule, model || ':' || seed AS key FROM runs WHERE seed NOT IN (42, 43)
UNION ALL SELECT 'ordered_metrics', model || ':' || seed FROM runs WHERE ap50_95 <= ap50""",
    "cn22_locked_test": """WITH n AS (SELECT count(*) FILTER (quality = 1) AS t, count(*) FILTER (quality IS NULL OR quality <> 1) AS r FROM labels)
SELECT unnest(['test', 'train', 'val']) AS part, unnest([CASE WHEN t = 0 THEN 'missing' WHEN t < 10 THEN 'too_few' ELSE 'kept' END, CASE WHEN r = 0 THEN 'missing' ELSE 'kept' END, 'missing']) AS status FROM n""",
    "rc5_release_policy": "SELECT CASE WHEN lang = 'fr' THEN 'language' WHEN n_chars < 200 THEN 'too_short' WHEN source = 'src3' THEN 'source' END AS reason, count(*) AS n FROM documents GROUP BY 1 HAVING reason IS NOT NULL",
    "rc6_rebuilt": """SELECT DISTINCT o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 'n' ELSE 'missing' END AS problem FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'""",
    "rc12_public_scan": """SELECT 'safe_path' AS rule, CAST(page_id AS VARCHAR) AS key FROM pages WHERE page_id % 10 = 3
UNION ALL SELECT 'no_local_path', CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 8 = 1 UNION ALL SELECT 'not_empty', CAST(page_id AS VARCHAR) FROM pages WHERE html IS NULL OR length(html) = 0""",
    "rc13_published_tree": """SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 70 = 6 THEN 'unexpected' ELSE 'missing' END AS problem FROM documents WHERE (doc_id % 70 = 6) <> (doc_id % 80 = 9)""",
    "rc15_rationale": "SELECT p_partkey, unnest(['epochs', 'batch', 'data']) AS name, unnest([CAST(p_size AS VARCHAR), p_brand, p_type]) AS value FROM part",
    "rc23_formal_evaluation": "SELECT DISTINCT event_type AS model, CASE WHEN event_type IN ('click', 'view') THEN 'FAIL' ELSE 'PASS' END AS status FROM events",
    "sk7_original_coco": f"WITH {SQL_BOXES} SELECT category, id AS box, image_id, w * h AS area, row_number() OVER (PARTITION BY category ORDER BY b.id) AS id FROM b",
    "sk8_pending_coco": "SELECT 'pending' AS status, page_id, sha256(html) AS sha256, row_number() OVER (ORDER BY page_id) AS id FROM pages",
}
