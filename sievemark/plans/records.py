"""Identities, bindings, inventories and gates over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark.functions import documents, identity, images, text
from sievemark.functions import geometry as g
from sievemark.operators import canonical, compare, duplicates, graph, matching, splits
from sievemark.plans import curation, evaluation
from sievemark.plans.comparison import _SQL_RUNS, METRICS, _runs
from sievemark.plans.curation import _DEC, SQL_BOXES, _boxes, _docs
from sievemark.session import small_batches, table
from sievemark.sources import scans
from sievemark.streaming import monitors


def pr9_canonical_coco(spark, d):
    q = g.box(*[F.col(c) + 0.0005 for c in ("x", "y", "w", "h")])
    rows = _boxes(spark, d).select("id", g.canonical_from_coco(q).alias("b"))
    return rows.select("id", *[F.get("b", i).alias(n) for i, n in enumerate(("x", "y", "w", "h"))])


def pr27_digests(spark, d):
    digest = identity.sha256_text(F.col("source"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.upper(digest)).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(digest, 1, 63), F.lit("g"))).otherwise(F.substring(digest, 1, 60))
    return _docs(spark, d).select("doc_id", text.sha256_or_null(raw).alias("sha256"))


def pr34_mime(spark, d):
    raw = F.when(F.col("page_id") % 4 == 0, F.unhex(F.lit("FFD8FFE000"))).when(F.col("page_id") % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(F.col("page_id") % 4 == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.encode("html", "UTF-8"))
    return table(spark, d, "pages").select("page_id", text.sniffed_mime(raw).alias("mime"))


def pr38_attributes(spark, d):
    """Properties of events as typed attributes."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.coalesce(F.try_variant_get(v, "$.occluded", "boolean"), F.lit(False)).alias("occluded"))


def pr39_conditional_fields(spark, d):
    """Documents of one language must have a label; others need none."""
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return compare.violations(rows, F.col("doc_id"), {"label_for_de": (F.col("lang") != "de") | F.col("quality").isNotNull(), "long_enough": F.col("n_chars") >= 20})


def pr41_scrubbed_json(spark, d):
    """Homes, other paths and named strings replaced at any depth, and a key left out."""
    inner = F.struct(F.lit("see /var/log/x and C:\\data\\y").alias("p"), F.concat(F.lit("by Alice of "), F.col("source")).alias("q"))
    raw = F.to_json(F.struct(F.concat(F.lit("/home/"), F.col("source"), F.lit("/x")).alias("b"), F.array("lang", F.lit("C:\\Users\\me\\y")).alias("a"), F.array(inner).alias("c"), F.lit("z").alias("secret")))
    return _docs(spark, d).select("doc_id", documents.scrubbed_json(raw, {"alice": "<NAME>"}, frozenset(["secret"])).alias("scrubbed"))


def pr44_ansi(spark, d):
    raw = F.concat(F.lit("\x1b[1;31m"), F.col("lang"), F.lit("\x1b[0m "), F.col("source"))
    return _docs(spark, d).select("doc_id", text.without_ansi(raw).alias("plain"))


def sc7_strict_json(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit('{"a": 1, "a": 2}')).when(F.col("event_id") % 4 == 1, F.lit('{"a": NaN}')).when(F.col("event_id") % 4 == 2, F.lit('{"a": 1e999}')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", documents.strict_json_problem(raw).isNotNull().alias("refused"))


def hs9_numeric_digest(spark, d):
    """Documents of two numbers and a text; only the numbers count, by their places."""
    raw = F.to_json(F.struct(F.array(F.col("user_id"), F.col("event_id") % 7).alias("b"), F.struct(F.col("event_id").alias("n"), F.col("event_type").alias("t"), F.lit(True).alias("u")).alias("a")))
    return table(spark, d, "events").select("event_id", documents.numeric_digest(raw).alias("digest"))


def hs2_pixel_hashes(spark, d):
    """Pages' whole bytes, three to a pixel, as images of one row."""
    raw = F.encode("html", "UTF-8")
    size = F.ceil(F.octet_length(raw) / 3).cast("int")
    rows = table(spark, d, "pages").select("page_id", size.alias("width"), F.concat(raw, F.encode(F.repeat(F.lit("#"), size * 3 - F.octet_length(raw)), "UTF-8")).alias("rgb"))
    small_batches(spark, scans.IMAGES_HELD)
    return rows.select("page_id", images.pixel_hash("width", F.lit(1), "rgb").alias("sha256_pixels"))


def hs4_json_hash(spark, d):
    n = table(spark, d, "nation")
    record = F.struct("n_name", "n_nationkey", "n_regionkey")
    return n.select("n_nationkey", identity.hash_of_json(record).alias("with_newline"), identity.hash_of_json(record, False).alias("without"))


def jn9_identity_binding(spark, d):
    """Reviewed orders against pending ones: fields that differ, and those that only one side has."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    pending, reviewed = o.where("o_orderkey % 97 <> 0"), o.where("o_orderkey % 89 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 0, "?").otherwise(F.col("o_orderstatus")))
    fields = compare.field_mismatches(pending, reviewed, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", F.col("field").alias("problem"))
    return fields.unionByName(compare.set_difference(pending, reviewed, "o_orderkey"))


def jn11_evidence_by_name(spark, d):
    """A manifest's paths against evidence by their last part, and the hashes of both."""
    rows = _docs(spark, d).select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "doc_id", identity.sha256_text(F.col("text")).alias("sha256"))
    left = rows.where("doc_id % 50 <> 1").select(canonical.image_key(F.col("path")).alias("name"), F.col("sha256").alias("listed"))
    right = rows.where("doc_id % 60 <> 1").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.when(F.col("doc_id") % 70 == 1, "?").otherwise(F.col("sha256")).alias("found"))
    why = F.when(F.col("listed").isNull(), "unexpected").when(F.col("found").isNull(), "missing").when(F.col("listed") != F.col("found"), "hash")
    return left.join(right, "name", "full").select("name", why.alias("problem")).where("problem is not null")


def jn13_pairs_with_splits(spark, d):
    hashed = curation._hashed(spark, d)
    split = hashed.select("id", F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"))
    of = lambda side: split.select(F.col("id").alias(f"{side}_id"), F.col("split").alias(f"{side}_split"))
    pairs = duplicates.hamming_pairs(hashed, curation.MOST, curation.BITS)
    return pairs.join(of("left"), "left_id").join(of("right"), "right_id").where("left_split <> right_split")


def ag19_dispositions(spark, d):
    return _docs(spark, d).groupBy("source", F.when(F.col("n_chars") < 500, "reject").otherwise("include").alias("disposition")).agg(F.count("*").alias("n"))


def ag23_side_summary(spark, d):
    return _boxes(spark, d).groupBy("category").agg(F.count("*").alias("records"), F.count_distinct("image_id").alias("images"), identity.hash_of_members(F.col("id").cast("string")).alias("ids_sha256"))


def wn10_bounded_examples(spark, d):
    rows = _docs(spark, d)
    found = compare.multiset_difference(rows.where("doc_id % 2 = 0").select("lang", "source"), rows.where("doc_id % 2 = 1").select("lang", "source"))
    return found.orderBy("lang", "source").limit(10)


def wn11_lowest_annotated(spark, d):
    targets = evaluation._sides(spark, d)[0].where("image_id > 3")
    return spark.range(50).withColumnRenamed("id", "image_id").join(targets, "image_id", "left_semi").agg(F.min("image_id").alias("image_id"))


def st2_round_trip(spark, d):
    """Records with an attribute, of which every hundredth comes back changed."""
    rows = _boxes(spark, d).select("image_id", "category", (F.col("id") % 2 == 0).cast("string").alias("occluded"), F.col("id").cast("string").alias("box"))
    back = _boxes(spark, d).select("image_id", "category", F.when(F.col("id") % 100 == 7, F.col("id") % 2 != 0).otherwise(F.col("id") % 2 == 0).cast("string").alias("occluded"), F.col("id").cast("string").alias("box"))
    return compare.multiset_difference(rows, back).groupBy("side").agg(F.sum("n").alias("n"))


def st4_exact_inventory(spark, d):
    return compare.set_difference(spark.range(60).withColumnRenamed("id", "nation"), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation")).unionByName(spark.range(50, 70).withColumnRenamed("id", "nation")), "nation")


def gr5_split_build(spark, d):
    """Groups, their components, splits of whole components, and images of each part."""
    members = graph.components(curation._edges(spark, d)).select(F.col("node").alias("group_id"), F.col("root").alias("component_id"))
    groups = curation._groups(spark, d).join(members, "group_id")
    assigned = splits.component_split(groups, ratios={"train": 0.5, "val": 0.25, "test": 0.25})
    images_of = _docs(spark, d).groupBy(F.concat_ws("_", "lang", "source").alias("group_id")).agg(F.count("*").alias("images"))
    return groups.join(assigned, ["model", "component_id"]).join(images_of, "group_id").groupBy("model", "split").agg(F.count("*").alias("groups"), F.sum("images").alias("images"))


def ev6_class_thresholds(spark, d):
    """Thresholds per class on one part; none may be chosen on the test part."""
    curve = matching.threshold_sweep(*evaluation._finer(spark, d)).where("category is not null")
    chosen = matching.choose_threshold(curve, 0.3, 0.2).select("category", "status", "confidence").withColumn("part", F.lit("val"))
    test = curve.select("category").distinct().select("category", F.lit("DIAGNOSTIC_ONLY").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit("test").alias("part"))
    return chosen.unionByName(test)


def ev8_evaluation(spark, d):
    """Counts and rates at the operating point with the sizes of targets, per class."""
    targets, predictions = evaluation._finer(spark, d)
    sizes = targets.withColumn("size", g.size_class(F.col("w") * F.col("h"))).groupBy("category").pivot("size", ["small", "medium", "large"]).count().fillna(0)
    return matching.rates(matching.match_counts(targets, predictions.where("score >= 0.25"))).join(sizes, "category")


def cn2_yolo_records(spark, d):
    line = g.yolo_line((F.col("id") % 6).cast("int"), g.box("x", "y", "w", "h"), F.lit(64), F.lit(64))
    labels = canonical.label_files(_boxes(spark, d).withColumn("line", line), "image_id", "line", "id").select(F.col("image_id").cast("string").alias("image_key"), "text")
    sizes = labels.select("image_key", F.lit(64).alias("width"), F.lit(64).alias("height"))
    names = spark.range(6).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("class_"), F.col("id").cast("string")).alias("class_name"))
    return canonical.records_of_yolo(sizes, labels, names)


def cn14_group_cover(spark, d):
    """Eligible items that no group or several groups have."""
    eligible = _docs(spark, d).where("n_chars > 500").select("doc_id")
    groups = _docs(spark, d).where("doc_id % 9 <> 0").select("doc_id").unionByName(_docs(spark, d).where("doc_id % 40 = 1").select("doc_id"))
    counts = groups.groupBy("doc_id").agg(F.count("*").alias("n"))
    return eligible.join(counts, "doc_id", "left").fillna(0).where("n <> 1")


def cn15_proposal_rules(spark, d):
    rows = evaluation._sides(spark, d)[1]
    return compare.violations(rows, F.col("id"), {"score_below_one": F.col("score") < 1, "inside": (F.col("x") + F.col("w") <= 42), "known_class": F.col("category").isin("click", "view", "purchase")}).groupBy("rule").agg(F.count("*").alias("n"))


def cn19_calibration(spark, d):
    """A threshold table from the JSON of each source's share of quality, with entries out of range marked."""
    shares = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg((F.sum("quality") * 2 / F.count("*")).alias("t"))
    raw = shares.select(F.to_json(F.create_map("source", "t")).alias("j"))
    return raw.select(F.explode(F.from_json("j", "map<string,double>")).alias("class_name", "threshold")).withColumn("valid", F.col("threshold").between(0, 1))


def cn20_resume_rules(spark, d):
    """Repeated hashes, paths and ids among collected documents."""
    rows = _docs(spark, d).select(F.md5(F.encode("text", "UTF-8")).alias("sha"), F.concat_ws("/", "source", (F.col("doc_id") / 2).cast("long").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("id"))
    return compare.all_violations([compare.repeated_values(rows, c).select(F.lit(f"repeated_{c}").alias("rule"), F.col(c).alias("key")) for c in ("sha", "path", "id")])


def rc1_run_table(spark, d):
    """Runs with their model's means and the distance from them."""
    runs = _runs(spark, d)
    return runs.join(compare.aggregate_runs(runs, METRICS), "model").select("model", "seed", *METRICS, *[(F.col(m) - F.col(f"{m}_mean")).alias(f"{m}_offset") for m in METRICS])


def rc4_provenance(spark, d):
    """Paths (part types) whose content (brand) isn't the same at all commits (sizes)."""
    p = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.min("p_brand").alias("blob"))
    return p.groupBy("p_type").agg(F.count_distinct("blob").alias("blobs"), F.count("*").alias("commits")).where("blobs > 1")


def rc7_run_summary(spark, d):
    """Each conversation's last and best turn, and whether all turns are there."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    ends = compare.last_and_best(rows, "conv_id", "turn", "chars")
    done = rows.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return ends.join(done, "conv_id").select("conv_id", "last_place", "best_place", F.when(F.col("turns") == F.col("last_place") + 1, "complete").otherwise("interrupted").alias("status"))


def rc9_inventory(spark, d):
    return table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("bytes"), identity.sha256_text(F.col("html")).alias("sha256"))


def rc11_redacted_hashes(spark, d):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("/home/me/")).otherwise(""), F.col("source"))
    return _docs(spark, d).select("doc_id", identity.sha256_text(raw).alias("before"), identity.sha256_text(text.redacted(raw)).alias("after"))


def rc16_split_binding(spark, d):
    """Protocol values against measured ones to 1e-12."""
    runs = compare.unpivoted(_runs(spark, d), ["model", "seed"], ["ap50_95", "ap50"])
    other = runs.withColumn("value", F.col("value") + F.when(F.col("seed") == 43, 1e-9).otherwise(0.0))
    return compare.within_tolerance(other, runs, ["model", "seed", "metric"], 1e-12, 0.0).groupBy("seed", "status").agg(F.count("*").alias("n"))


def rc18_exactly_once(spark, d):
    rows = _docs(spark, d).groupBy(F.md5(F.encode("text", "UTF-8")).alias("run_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return rows.select("doc_id", (F.col("n") == 1).alias("once"))


def sm2_device_samples(spark, d):
    return monitors.device_summary(table(spark, d, "events").withColumn("device", F.lit(0)), "device", "ts", "value", "1 hour").groupBy("device").agg(F.sum("n").alias("samples"), F.max("max_value").alias("max_value"), F.count("*").alias("windows"))


def sc14_run_records(spark, d):
    """One record of each customer, with a figure from the first source that has it."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_total"))
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"))
    rows = c.join(o, c["c_custkey"] == o["o_custkey"], "left").join(e, c["c_custkey"] == e["user_id"], "left")
    return rows.select("c_custkey", F.coalesce("last_total", "last_value", F.lit(0.0)).alias("figure"), F.when(F.col("last_total").isNotNull(), "order").when(F.col("last_value").isNotNull(), "event").otherwise("none").alias("figure_source"))


def sc15_coco_rules(spark, d):
    """Ids that repeat or aren't consecutive, and paths that lead outside."""
    rows = _docs(spark, d).where("doc_id % 100 <> 5").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 90 == 1, "../x").otherwise(F.col("source")).alias("file_name"))
    outside = compare.violations(rows, F.col("id"), {"safe_path": text.is_safe_relative_path(F.col("file_name"))})
    ids = rows.agg(F.count("*").alias("n"), F.max("id").alias("m")).where("n <> m + 1").select(F.lit("consecutive_ids").alias("rule"), F.col("n").cast("string").alias("key"))
    return outside.unionByName(ids)


def sc20_sample_manifest(spark, d):
    """Four indexes on one name, with parts of the name as columns."""
    p = table(spark, d, "part").select(F.col("p_name").alias("image"), "p_size", "p_retailprice", "p_brand", "p_type", "p_partkey")
    a, b, c, e = p.select("p_partkey", "image", "p_size"), p.select("p_partkey", "p_retailprice"), p.select("p_partkey", "p_brand"), p.select("p_partkey", "p_type")
    rows = a.join(b, "p_partkey").join(c, "p_partkey").join(e, "p_partkey").where("p_brand <> 'Brand#1'")
    return rows.select("p_partkey", F.substring("image", 1, 4).alias("condition_group_id"), F.substring("image", 1, 1).alias("model_code"), "p_size", "p_retailprice", "p_type")


def sk6_coco_rows(spark, d):
    """Rows of a COCO sink per part: images and annotations numbered in the order of their samples."""
    rows = _docs(spark, d).select("lang", "doc_id", "n_chars")
    numbered = canonical.coco_ids(rows, "lang", "doc_id")
    return numbered.select("lang", "id", "doc_id", F.array_join(F.array(F.lit(0), F.lit(0), F.col("n_chars"), F.lit(1)), ",").alias("bbox"), F.col("n_chars").alias("area"))


def sk2_sorted_json(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("a"), F.col("n_nationkey").alias("b"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("c")), {"ignoreNullFields": "false"}).alias("json"))


_GATED = ("ag", "hs", "pr", "jn", "wn", "gr", "rc", "sc", "sk", "sm", "st", "ev", "cn")
QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:2] in _GATED and k[2].isdigit()}

_CURVE = evaluation._SQL_CURVE
SQL = {
    "hs2_pixel_hashes": """WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages) SELECT page_id, sha256(CAST(ceil(n / 3) AS BIGINT) || 'x1:RGB' || html || repeat('#', CAST(ceil(n / 3) * 3 - n AS BIGINT))) AS sha256_pixels FROM p""",
    "pr9_canonical_coco": f"WITH {SQL_BOXES} SELECT id, {', '.join(f'{_DEC(f"({c} + 0.0005::DOUBLE)", 0)} AS {c}' for c in ('x', 'y', 'w', 'h'))} FROM b",
    "pr27_digests": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(source) END AS sha256 FROM documents",
    "pr34_mime": "SELECT page_id, ['image/jpeg', 'image/png', 'image/webp', ''][page_id % 4 + 1] AS mime FROM pages",
    "pr38_attributes": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, FALSE AS occluded FROM events",
    "pr39_conditional_fields": """SELECT 'label_for_de' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'de' AND quality IS NULL
UNION ALL SELECT 'long_enough', CAST(doc_id AS VARCHAR) FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < 20""",
    "pr41_scrubbed_json": """SELECT doc_id, '{"a":["' || lang || '","<USER_HOME>\\\\y"],"b":"<USER_HOME>/x","c":[{"p":"see <ABSOLUTE_PATH> and <ABSOLUTE_PATH>","q":"by <NAME> of ' || source || '"}]}' AS scrubbed FROM documents""",
    "hs9_numeric_digest": """SELECT event_id, sha256('[["a.n",' || event_id || '],["b[0]",' || user_id || '],["b[1]",' || (event_id % 7) || ']]') AS digest FROM events""",
    "pr44_ansi": "SELECT doc_id, lang || ' ' || source AS plain FROM documents",
    "sc7_strict_json": "SELECT event_id, event_id % 4 < 3 AS refused FROM events",
    "hs4_json_hash": """WITH j AS (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS j FROM nation)
SELECT n_nationkey, sha256(j || chr(10)) AS with_newline, sha256(j) AS without FROM j""",
    "jn9_identity_binding": """SELECT o_orderkey, 'o_orderstatus' AS problem FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND o_orderkey % 101 = 0
UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 UNION ALL SELECT o_orderkey, 'unexpected' FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 89 <> 0""",
    "jn11_evidence_by_name": """SELECT doc_id || '.txt' AS name, CASE WHEN doc_id % 50 = 1 THEN 'unexpected' WHEN doc_id % 60 = 1 THEN 'missing' ELSE 'hash' END AS problem FROM documents
WHERE NOT (doc_id % 50 = 1 AND doc_id % 60 = 1) AND (doc_id % 50 = 1 OR doc_id % 60 = 1 OR doc_id % 70 = 1)""",
    "jn13_pairs_with_splits": f"""WITH {curation._SQL_PAIRS}, s AS (SELECT id, CASE WHEN id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM h)
SELECT pairs.*, a.split AS left_split, b.split AS right_split FROM pairs JOIN s a ON a.id = left_id JOIN s b ON b.id = right_id WHERE a.split <> b.split""",
    "ag19_dispositions": "SELECT source, CASE WHEN n_chars < 500 THEN 'reject' ELSE 'include' END AS disposition, count(*) AS n FROM documents GROUP BY 1, 2",
    "ag23_side_summary": f"WITH {SQL_BOXES} SELECT category, count(*) AS records, count(DISTINCT image_id) AS images, sha256(array_to_string(list_sort(list(CAST(id AS VARCHAR))), chr(10))) AS ids_sha256 FROM b GROUP BY 1",
    "wn10_bounded_examples": f"{curation.SQL['st1_multiset_diff']} ORDER BY lang, source LIMIT 10",
    "wn11_lowest_annotated": f"WITH {SQL_BOXES} SELECT min(image_id) AS image_id FROM b WHERE is_gt AND image_id > 3",
    "st2_round_trip": "SELECT unnest(['left', 'right']) AS side, count(*) AS n FROM events WHERE event_id % 100 = 7 GROUP BY 1",
    "st4_exact_inventory": """SELECT i AS nation, 'missing' AS problem FROM range(60) x(i) WHERE i NOT IN (SELECT n_nationkey FROM nation) AND i NOT BETWEEN 50 AND 69
UNION ALL SELECT i, 'unexpected' FROM range(60, 70) x(i)""",
    "ev6_class_thresholds": f"""WITH RECURSIVE {_CURVE}, ok AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recall DESC, precision DESC, confidence) AS i FROM r2 WHERE category IS NOT NULL AND tp > 0 AND precision >= 0.3 AND precision_wilson_lower_95 >= 0.2),
a AS (SELECT DISTINCT category FROM r2 WHERE category IS NOT NULL)
SELECT a.category, CASE WHEN ok.i = 1 THEN 'VALIDATION_DERIVED_PENDING_HUMAN_REVIEW' ELSE 'NOT_AVAILABLE' END AS status, ok.confidence, 'val' AS part FROM a LEFT JOIN ok ON a.category = ok.category AND ok.i = 1
UNION ALL SELECT category, 'DIAGNOSTIC_ONLY', NULL, 'test' FROM a""",
    "ev8_evaluation": f"""WITH RECURSIVE {evaluation._SQL_COUNTS.replace("FROM f WHERE NOT is_gt)", "FROM f WHERE NOT is_gt AND score >= 0.25)", 1)}, {evaluation._SQL_FULL_RATES}, z AS (SELECT category, count(*) FILTER (w * h < 1024) AS small, count(*) FILTER (w * h >= 1024 AND w * h < 9216) AS medium, count(*) FILTER (w * h >= 9216) AS large FROM g GROUP BY 1)
SELECT r2.*, small, medium, large FROM r2 JOIN z USING (category)""",
    "cn2_yolo_records": f"""WITH {SQL_BOXES} SELECT CAST(image_id AS VARCHAR) AS image_key, 'class_' || (id % 6) AS class_name, {', '.join(f"{_DEC(c, 0)} AS {c}" for c in ("x", "y", "w", "h"))} FROM b""",
    "cn14_group_cover": "SELECT doc_id, CAST((doc_id % 9 <> 0)::INT + (doc_id % 40 = 1)::INT AS BIGINT) AS n FROM documents WHERE n_chars > 500 AND (doc_id % 9 <> 0)::INT + (doc_id % 40 = 1)::INT <> 1",
    "cn15_proposal_rules": f"""WITH {SQL_BOXES}, p AS (SELECT * FROM b WHERE NOT is_gt) SELECT rule, count(*) AS n FROM (SELECT 'score_below_one' AS rule FROM p WHERE score >= 1 UNION ALL SELECT 'inside' FROM p WHERE x + w > 42 UNION ALL SELECT 'known_class' FROM p WHERE category NOT IN ('click', 'view', 'purchase')) GROUP BY 1""",
    "cn19_calibration": "SELECT source AS class_name, sum(quality) * 2 / count(*) AS threshold, sum(quality) * 2 / count(*) BETWEEN 0 AND 1 AS valid FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "cn20_resume_rules": """SELECT 'repeated_sha' AS rule, md5(text) AS key FROM documents GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated_path', source || '/' || (doc_id // 2) FROM documents GROUP BY 2 HAVING count(*) > 1""",
    "rc1_run_table": f"WITH {_SQL_RUNS} SELECT model, seed, {', '.join(METRICS)}, {', '.join(f'{m} - avg({m}) OVER (PARTITION BY model) AS {m}_offset' for m in METRICS)} FROM runs",
    "rc4_provenance": "WITH p AS (SELECT p_type, p_size, min(p_brand) AS blob FROM part GROUP BY 1, 2) SELECT p_type, count(DISTINCT blob) AS blobs, count(*) AS commits FROM p GROUP BY 1 HAVING count(DISTINCT blob) > 1",
    "rc7_run_summary": "SELECT conv_id, max(turn) AS last_place, first(turn ORDER BY length(text) DESC, turn) AS best_place, CASE WHEN count(*) = max(turn) + 1 THEN 'complete' ELSE 'interrupted' END AS status FROM conversations GROUP BY 1",
    "rc9_inventory": "SELECT page_id || '.html' AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages",
    "rc11_redacted_hashes": "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '/home/me/' ELSE '' END || source) AS before, sha256(CASE WHEN doc_id % 2 = 0 THEN '<USER_HOME>/' ELSE '' END || source) AS after FROM documents",
    "rc16_split_binding": f"WITH {_SQL_RUNS} SELECT seed, CASE WHEN seed = 43 THEN 'FAIL' ELSE 'PASS' END AS status, 2 * count(*) AS n FROM runs GROUP BY 1, 2",
    "rc18_exactly_once": "SELECT min(doc_id) AS doc_id, count(*) = 1 AS once FROM documents GROUP BY text",
    "sm2_device_samples": "WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, max(value) AS m FROM events GROUP BY 1) SELECT CAST(0 AS INTEGER) AS device, CAST(sum(n) AS BIGINT) AS samples, max(m) AS max_value, count(*) AS windows FROM w",
    "sc14_run_records": """WITH o AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS t FROM orders GROUP BY 1), e AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT c_custkey, coalesce(t, v, 0) AS figure, CASE WHEN t IS NOT NULL THEN 'order' WHEN v IS NOT NULL THEN 'event' ELSE 'none' END AS figure_source FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""",
    "sc15_coco_rules": """SELECT 'safe_path' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 100 <> 5 AND doc_id % 90 = 1
UNION ALL SELECT 'consecutive_ids', CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id % 100 <> 5 HAVING count(*) <> max(doc_id) + 1""",
    "sc20_sample_manifest": "SELECT p_partkey, substr(p_name, 1, 4) AS condition_group_id, substr(p_name, 1, 1) AS model_code, p_size, p_retailprice, p_type FROM part WHERE p_brand <> 'Brand#1'",
    "sk6_coco_rows": "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS id, doc_id, '0,0,' || n_chars || ',1' AS bbox, n_chars AS area FROM documents",
    "sk2_sorted_json": """SELECT n_nationkey, '{"a":"' || n_name || '","b":' || n_nationkey || ',"c":' || CASE WHEN n_regionkey > 1 THEN CAST(n_regionkey AS VARCHAR) ELSE 'null' END || '}' AS json FROM nation""",
}
