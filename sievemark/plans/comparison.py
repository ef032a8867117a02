"""Runs against each other, rules, monitors and manifests over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sievemark.functions import documents, identity, text
from sievemark.operators import compare, exact, runs
from sievemark.session import table
from sievemark.sources import event_files, scans
from sievemark.streaming import monitors

METRICS = ["ap50_95", "ap50", "latency_p50_ms"]


def _runs(spark, d):
    """Runs: event types as models, weekdays as seeds, and figures of their events as metrics."""
    e = table(spark, d, "events").select("event_type", "event_id", "value", "user_id")
    own = e.groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 4 + 42).alias("seed"))
    return own.agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.percentile("value", F.lit(0.5)).alias("latency_p50_ms")).select(
        "model", "seed", "last_id", (F.col("hits") / F.col("n")).alias("ap50_95"), (F.col("hits") / (F.col("n") + 1)).alias("ap50"), "latency_p50_ms"
    )


_SQL_RUNS = """runs AS (SELECT event_type AS model, event_id % 4 + 42 AS seed, max(event_id) AS last_id, count(*) FILTER (value > 50) / count(*) AS ap50_95,
 count(*) FILTER (value > 50) / (count(*) + 1) AS ap50, quantile_cont(value, 0.5) AS latency_p50_ms FROM events GROUP BY 1, 2)"""
_SQL_LONG = f"{_SQL_RUNS}, long AS (SELECT model, seed, unnest(['ap50_95', 'ap50', 'latency_p50_ms']) AS metric, unnest([ap50_95, ap50, latency_p50_ms]) AS value FROM runs)"


def ag13_run_aggregate(spark, d):
    return compare.aggregate_runs(_runs(spark, d), METRICS)


def ag14_paired_delta(spark, d):
    return compare.paired_deltas(_runs(spark, d), "click", "view", METRICS)


def jn16_pairs_by_seed(spark, d):
    long = compare.unpivoted(_runs(spark, d), ["model", "seed"], METRICS)
    a, b = (long.where(F.col("model") == m).select("seed", "metric", F.col("value").alias(n)) for m, n in (("click", "first"), ("view", "second")))
    return a.join(b, ["seed", "metric"])


def ag15_percentiles(spark, d):
    return compare.latency_summary(table(spark, d, "events"), "event_type", "value")


def ag15_exact_percentiles(spark, d):
    """Prices by status, without a group's values in one task."""
    rows = exact.exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def ag13_exact_moments(spark, d):
    """Sums, means and deviations of prices, discounts and taxes by status, the same in any dealing."""
    rows = exact.exact_moments(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_discount", "l_tax"])
    return rows.select("l_returnflag", "l_linestatus", "metric", "n", *[F.round(c, 5).alias(c) for c in ("sum", "mean", "std")])


def ag16_device_summary(spark, d):
    return monitors.device_summary(table(spark, d, "events").withColumn("camera", F.col("user_id") % 5), "camera", "ts", "value", "1 day")


def _frames(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 5).alias("camera"), F.col("event_id").alias("frame"), F.col("value").alias("latency_ms"))


def sm1_measured_frames(spark, d):
    """Batch form: frames after the first five of each camera."""
    return compare.latency_summary(monitors.frames_behind_warmup(_frames(spark, d), 5), "camera", "latency_ms")


def sm1_collection_gate(spark, d):
    """Which users have frames enough behind their warm-up."""
    frames = _frames(spark, d).drop("camera").join(table(spark, d, "events").select(F.col("event_id").alias("frame"), F.col("user_id").alias("camera")), "frame")
    return monitors.collection_gate(frames, 3, 30)


def sm3_new_items(spark, d):
    lines = table(spark, d, "documents").select(F.md5(F.encode("text", "UTF-8")).alias("item"), "doc_id")
    return monitors.not_yet_collected(lines.where("doc_id >= 500"), lines.where("doc_id < 500"), "item")


def sm5_epoch_means(spark, d):
    return monitors.epoch_means(table(spark, d, "events").withColumn("epoch", F.floor(F.col("event_id") / 1000)), "event_type", "epoch", "value")


def ag18_array_stats(spark, d):
    return compare.array_stats(table(spark, d, "embeddings"), "vec_id", "embedding")


def wn9_array_browser(spark, d):
    names = compare.array_stats(table(spark, d, "embeddings").where(F.col("vec_id").cast("string").contains("7")), "vec_id", "embedding")
    return names.orderBy(F.desc("l2"), "vec_id").limit(20).select("vec_id", "l2")


def jn18_array_errors(spark, d):
    e = table(spark, d, "embeddings")
    return compare.array_errors(e.select("vec_id", F.col("embedding").alias("values")), e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 1.001).alias("values")), "vec_id")


def jn17_tolerance_gate(spark, d):
    long = compare.unpivoted(_runs(spark, d), ["model", "seed"], METRICS).drop("model_seed")
    exported = long.withColumn("value", F.when(F.col("seed") == 43, F.col("value") * 1.01).when(F.col("seed") == 44, F.lit(None)).otherwise(F.col("value") + 1e-7))
    return compare.within_tolerance(exported, long, ["model", "seed", "metric"], 1e-4, 1e-4).select("model", "seed", "metric", "status", "reason")


def rc3_matrix_gaps(spark, d):
    runs = _runs(spark, d).where("last_id % 3 <> 0")
    runs = runs.unionByName(runs.where("seed = 42"))
    return compare.matrix_gaps(runs, _runs(spark, d).select("model"), _runs(spark, d).select("seed"))


def ag22_uneven_fields(spark, d):
    rows = table(spark, d, "documents").select("lang", F.lit("v1").alias("protocol"), F.when(F.col("doc_id") < 0, "x").alias("dataset"), "source")
    return compare.uneven_fields(rows, ["lang", "protocol", "dataset", "source"])


def rc2_rule_violations(spark, d):
    runs = _runs(spark, d)
    rules = {"ap_in_range": F.col("ap50_95").between(0, 0.35), "ordered_ap": F.col("ap50") <= F.col("ap50_95"), "known_seed": F.col("seed").isin(42, 43, 44)}
    return compare.violations(runs, F.concat_ws("/", "model", "seed"), rules)


def rc20_exact_mirror(spark, d):
    """Orders' totals recomputed from a copy in which every thousandth differs."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"))
    copy = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 1000 == 0, F.lit("0.00")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("total"))
    return compare.multiset_difference(rows, copy)


def rc21_gates(spark, d):
    """Required gates (labels' documents of a kind) that are missing or didn't pass."""
    required = table(spark, d, "documents").where("doc_id % 10 = 0").select("doc_id")
    found = table(spark, d, "labels").select("doc_id", "quality")
    missing = required.join(found, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("problem"))
    return missing.unionByName(required.join(found.where("quality <> 1"), "doc_id").select("doc_id", F.lit("failed").alias("problem")))


def rc22_bundles(spark, d):
    """Folders (sources) that don't hold one file of each of two kinds with one stem."""
    rows = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 7 == 0, "metadata").otherwise("model").alias("kind"), (F.col("doc_id") / 7).cast("long").alias("stem"))
    return rows.groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "metadata").alias("metadata"), F.count_distinct("stem").alias("stems")).where("files <> 2 or metadata <> 1 or stems <> 1")


def rc19_artifact_chain(spark, d):
    """One digest of each conversation's records in order."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    line = F.transform("r", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"]))
    return rows.select("conv_id", F.sha2(F.array_join(line, "\n"), 256).alias("chain"))


def rc10_inventory(spark, d):
    """Pages against an inventory in which some are missing, unexpected or of another hash."""
    pages = table(spark, d, "pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"))
    listed = pages.where("page_id % 20 <> 0").withColumn("sha256", F.when(F.col("page_id") % 33 == 0, F.lit("?")).otherwise(F.col("sha256")))
    gaps = compare.set_difference(listed, pages.where("page_id % 21 <> 0"), "page_id")
    other = compare.field_mismatches(listed, pages.where("page_id % 21 <> 0"), "page_id", ["sha256"]).select("page_id", F.lit("hash").alias("problem"))
    return gaps.unionByName(other)


def jn12_field_mismatches(spark, d):
    c = table(spark, d, "customer")
    other = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 50 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))).withColumn("c_nationkey", F.when(F.col("c_custkey") % 70 == 0, F.lit(99)).otherwise(F.col("c_nationkey")))
    return compare.field_mismatches(c, other, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


def wn4_last_and_best(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return compare.last_and_best(rows, "conv_id", "turn", "chars")


def wn13_sequence_check(spark, d):
    rows = table(spark, d, "conversations").where("not (conv_id % 5 = 0 and turn = 1)")
    return compare.broken_sequences(rows, "conv_id", "turn", 0)


def jn2_manifest(spark, d):
    """Four tables on a key: orders, their customers, nations and regions, with what is missing named."""
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def jn15_alias_mapping(spark, d):
    """Part types' first words through an alias table; those that it lacks."""
    kinds = table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("alias"))
    names = kinds.select("alias").distinct().where("alias < 'P'").withColumn("class_name", F.lower("alias"))
    return kinds.join(names, "alias", "left").groupBy(F.coalesce("class_name", F.lit("UNKNOWN")).alias("class_name")).agg(F.count("*").alias("n"))


def sc12_scalar_epochs(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return scans.scalar_epochs(e, {"click": "train_loss", "view": "lr"}, 500)


@F.pandas_udf(BinaryType())
def _encoded_events(step: pd.Series, tag: pd.Series, value: pd.Series) -> pd.Series:
    """Event files of one scalar a record."""
    files = [[event_files.encoded(int(s), 0.5 * s, {t: v}) for s, t, v in zip(*own, strict=True)] for own in zip(step, tag, value, strict=True)]
    return pd.Series(event_files.framed_files(files), dtype=object)


def _event_file(step: str, tag: str, value: str):
    """An event file of a group's scalars, by step."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col(tag).alias("tag"), F.col(value).alias("value"))))
    return _encoded_events(rows["step"], rows["tag"], rows["value"])


def sc12_event_files(spark, d):
    """Epochs' means of scalars that users' event files hold; every ninth user's file is cut short and says so."""
    e = table(spark, d, "events").where("value IS NOT NULL")
    packed = e.groupBy("user_id").agg(_event_file("event_id", "event_type", "value").alias("whole"))
    content = F.when(F.col("user_id") % 9 == 4, F.substring("whole", F.lit(1), F.octet_length("whole") - 1)).otherwise(F.col("whole"))
    found = event_files.event_scalars(packed.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("path"), content.alias("content")))
    cut = found.where("error IS NOT NULL").select(F.lit(None).cast("long").alias("epoch"), "error", F.lit(1).alias("one")).groupBy("epoch", "error").agg(F.count("*").alias("n"))
    whole = found.where("error IS NULL").groupBy((F.floor(F.col("step") / 500) + 1).alias("epoch"), F.lit(None).cast("string").alias("error")).agg(F.count("*").alias("n"))
    return whole.unionByName(cut)


def sc12_event_file_epochs(spark, d):
    """The same scalars' means by epoch, a column for each tag."""
    e = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", "event_type", F.round("value", 0).alias("value"))
    packed = e.groupBy("user_id").agg(_event_file("event_id", "event_type", "value").alias("content"))
    found = event_files.event_scalars(packed.select(F.col("user_id").cast("string").alias("path"), "content"))
    rows = scans.scalar_epochs(found, {"click": "train_loss", "view": "lr"}, 500)
    return rows.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "lr")])


def rc1_comparison(spark, d):
    """Customers' orders as runs of segments: documents, epochs and extra lines to the 29 columns."""
    return runs.run_rows(*_run_documents(spark, d))


def rc1_aggregates(spark, d):
    """Means and deviations of the runs' fifteen metrics by model."""
    rows = runs.aggregates(runs.run_rows(*_run_documents(spark, d)))
    return rows.select("model", "runs", *[F.round(c, 6).alias(c) for c in rows.columns if c not in ("model", "runs")])


def _run_documents(spark, d):
    """A run a customer: some documents are missing, some figures null or left to the last epoch."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key = F.col("c_custkey")
    manifest = F.to_json(F.struct(F.concat(F.lit("run-"), key.cast("string")).alias("run_id"), F.col("c_mktsegment").alias("model"), F.when(key % 5 > 0, "complete").alias("status"), F.struct((key * 100).alias("parameters")).alias("model_details"), F.struct((key % 40 + 42).alias("seed")).alias("protocol"), F.struct(F.sha2(F.col("c_mktsegment"), 256).alias("val_annotation_sha256")).alias("dataset")))
    figures = F.struct((key % 7 / 8).alias("ap50"), F.when(key % 4 > 0, key % 9 / 16).alias("f1"), (key % 100).alias("tp"))
    named = lambda kind: F.to_json(F.struct(figures.alias(kind)))
    metrics = F.when(key % 3 == 0, named("metrics")).when(key % 3 == 1, named("metrics_common"))
    latency = F.when(key % 6 > 0, F.to_json(F.struct((key % 50 / 4).alias("e2e_p50_ms"), (key % 60 / 2).alias("sustained_fps"))))
    documents = c.select(key.cast("string").alias("run"), F.when(key % 10 > 0, manifest).alias("manifest"), metrics.alias("metrics"), latency.alias("latency"), F.lit(None).cast("string").alias("gpu"))
    o = o.withColumn("run", F.col("o_custkey").cast("string"))
    n = F.col("o_orderkey")
    epochs = o.select("run", n.alias("epoch"), (n / 4).alias("elapsed_s"), (n % 11 / 16).alias("map50"), (n % 13 / 16).alias("map50_95"), (n % 5 / 8).alias("precision"), (n % 3 / 4).alias("recall"), (n % 17).alias("gpu_peak_allocated_mib"), F.when(n % 2 == 0, n % 19).alias("train_peak_allocated_mib"))
    extra = o.where("o_orderkey % 3 = 0").select("run", n.alias("line"), (n % 23).alias("epoch_peak_allocated_mib"), F.when(n % 4 == 0, n % 29).alias("train_peak_allocated_mib"))
    return documents, epochs, extra


def sc13_epochs_from_one(spark, d):
    e = table(spark, d, "events").where("event_id < 500").select((F.col("event_id")).cast("string").alias("epoch"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("train/box_loss"))
    return scans.from_epoch_one(e, {"train/box_loss": "train_box_loss"})


def ag20_progress(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("planned"), F.count_if(F.col("o_orderstatus") == "F").alias("complete"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


def ag7_prepared_summary(spark, d):
    """Documents by part, and those of the second part whose text the first has."""
    rows = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train"))
    seen = rows.where("split = 'train'").select("text").distinct()
    val = rows.where("split = 'val'").join(seen, "text", "left_semi").groupBy("lang").agg(F.count("*").alias("seen_in_train"))
    return rows.groupBy("lang").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val")).join(val, "lang", "left").fillna(0)


def pr45_gflops(spark, d):
    p = table(spark, d, "part")
    summary = F.concat(F.lit("layers, "), F.col("p_size").cast("string"), F.lit(".5 GFLOPs"))
    return p.select("p_partkey", text.gflops(F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")), summary).alias("gflops"), text.known_stat(F.col("p_size") - 25).cast("long").alias("stat"))


def hs8_member_hash(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(identity.hash_of_members(F.concat_ws("_", "lang", F.col("doc_id").cast("string"))).alias("digest"))


def pr43_json_leaves(spark, d):
    """Numbers and texts at any depth of documents, by their places."""
    inner = F.struct(F.array("user_id", F.col("event_id") % 3).alias("n"), F.col("event_type").alias("t"), F.lit(None).cast("string").alias("none"))
    raw = F.to_json(F.struct(F.array(inner, inner).alias("a"), F.col("event_id").alias("id"), F.lit(True).alias("flag")))
    e = table(spark, d, "events").select(raw.alias("j"))
    numbers = e.select(F.explode(documents.numeric_leaves(F.col("j"))).alias("x")).groupBy("x.path").agg(F.count("*").alias("n"), F.sum("x.value").alias("total"))
    texts = e.select(F.explode(documents.string_leaves(F.col("j"))).alias("x")).groupBy("x.path").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return numbers.unionByName(texts)


_NONE = lambda names, kind="DOUBLE": ", ".join(f"CAST(NULL AS {kind}) AS {n}" for n in names.split())
_SQL_RUN_ROWS = f"""l AS (SELECT o_custkey AS k, max(o_orderkey) AS n FROM orders GROUP BY 1), x AS (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
j AS (SELECT c_custkey AS k, c_mktsegment AS s, c_custkey % 10 > 0 AS told, c_custkey % 3 < 2 AS has, n, m FROM customer LEFT JOIN l ON l.k = c_custkey LEFT JOIN x ON x.k = c_custkey),
r AS (SELECT CASE WHEN told THEN 'run-' || k ELSE CAST(k AS VARCHAR) END AS run_id, CASE WHEN told THEN s ELSE CAST(k AS VARCHAR) END AS model, CASE WHEN told AND k % 5 > 0 THEN 'complete' ELSE 'unknown' END AS status,
 n % 13 / 16 AS ap50_95, CASE WHEN has THEN k % 7 / 8 ELSE n % 11 / 16 END AS ap50, {_NONE("ap75 ap_small ap_medium ap_large ar100")}, n % 5 / 8 AS precision, n % 3 / 4 AS recall, CASE WHEN has AND k % 4 > 0 THEN k % 9 / 16 END AS f1,
 CASE WHEN has THEN k % 100 END AS tp, {_NONE("fp fn", "BIGINT")}, {_NONE("best_f1 best_f1_confidence")}, CASE WHEN told THEN k * 100 END AS params, {_NONE("checkpoint_mib")},
 CASE WHEN k % 6 > 0 THEN k % 50 / 4 END AS latency_p50_ms, {_NONE("latency_p95_ms")}, CASE WHEN k % 6 > 0 THEN k % 60 / 2 END AS fps,
 coalesce(CASE WHEN n % 2 = 0 THEN nullif(n % 19, 0) END, CASE WHEN m % 4 = 0 THEN nullif(m % 29, 0) END, nullif(n % 17, 0), nullif(m % 23, 0))::DOUBLE AS peak_gpu_memory_mib, {_NONE("system_peak_gpu_memory_mib")}, n / 4 AS train_elapsed_s,
 CASE WHEN told THEN k % 40 + 42 END AS seed, CASE WHEN told THEN sha256(s) END AS dataset_sha256, {_NONE("protocol_sha256", "VARCHAR")} FROM j)"""

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:2] in ("ag", "hs", "pr", "jn", "wn", "rc", "sc", "sm") and k[2].isdigit()}

SQL = {
    "rc2_rule_violations": f"""WITH {_SQL_RUNS} SELECT 'ap_in_range' AS rule, model || '/' || seed AS key FROM runs WHERE NOT ap50_95 BETWEEN 0 AND 0.35 UNION ALL SELECT 'ordered_ap', model || '/' || seed FROM runs WHERE ap50 > ap50_95
UNION ALL SELECT 'known_seed', model || '/' || seed FROM runs WHERE seed NOT IN (42, 43, 44)""",
    "pr43_json_leaves": """WITH x AS (SELECT unnest(['a[0].n[0]', 'a[0].n[1]', 'a[1].n[0]', 'a[1].n[1]', 'id']) AS path, unnest([user_id, event_id % 3, user_id, event_id % 3, event_id]) AS v FROM events)
SELECT path, count(*) AS n, sum(v)::DOUBLE AS total FROM x GROUP BY 1 UNION ALL SELECT unnest(['a[0].t', 'a[1].t']), n, NULL FROM (SELECT count(*) AS n FROM events) WHERE n > 0""",
    "ag13_run_aggregate": f"WITH {_SQL_RUNS} SELECT model, count(*) AS runs, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std' for m in METRICS)} FROM runs GROUP BY 1",
    "ag14_paired_delta": f"""WITH {_SQL_LONG} SELECT a.metric, count(*) AS paired_n, avg(a.value - b.value) AS mean_delta, stddev_samp(a.value - b.value) AS sample_sd_delta, count(*) - 1 AS degrees_of_freedom
FROM long a JOIN long b USING (seed, metric) WHERE a.model = 'click' AND b.model = 'view' GROUP BY 1""",
    "jn16_pairs_by_seed": f"WITH {_SQL_LONG} SELECT a.seed, a.metric, a.value AS first, b.value AS second FROM long a JOIN long b USING (seed, metric) WHERE a.model = 'click' AND b.model = 'view'",
    "ag15_percentiles": "SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(value) * 1000.0::DOUBLE / sum(value) AS fps FROM events GROUP BY 1",
    "ag16_device_summary": "SELECT user_id % 5 AS camera, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, max(value) AS max_value, avg(value) AS mean_value FROM events GROUP BY 1, 2",
    "sm1_measured_frames": """WITH r AS (SELECT user_id % 5 AS camera, value, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS frame FROM events)
SELECT camera, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(value) * 1000.0::DOUBLE / sum(value) AS fps FROM r WHERE frame > 5 GROUP BY 1""",
    "sm1_collection_gate": """WITH r AS (SELECT user_id AS camera, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM events)
SELECT camera, count(*) AS frames, count(value) FILTER (frame > 3) AS measured, CASE WHEN count(value) FILTER (frame > 3) >= 30 THEN 'PASS' ELSE 'FAIL' END AS status FROM r GROUP BY 1""",
    "sm3_new_items": "SELECT md5(text) AS item, doc_id FROM documents WHERE doc_id >= 500 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 500)",
    "sm5_epoch_means": "SELECT event_type, event_id // 1000 AS epoch, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2",
    "ag18_array_stats": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, count(*) AS numel, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, sqrt(sum(v * v)) AS l2 FROM e GROUP BY 1""",
    "wn9_array_browser": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE contains(vec_id::VARCHAR, '7')) SELECT vec_id, sqrt(sum(v * v)) AS l2 FROM e GROUP BY 1 ORDER BY l2 DESC, vec_id LIMIT 20",
    "jn18_array_errors": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), x AS (SELECT vec_id, abs(v - v * 1.001::DOUBLE) AS e FROM e) SELECT vec_id, count(*) AS n, max(e) AS max_error, avg(e) AS mean_error, quantile_cont(e, 0.99) AS p99_error FROM x GROUP BY 1",
    "jn17_tolerance_gate": f"""WITH {_SQL_LONG}, x AS (SELECT *, CASE WHEN seed = 43 THEN value * 1.01 WHEN seed = 44 THEN NULL ELSE value + 1e-7::DOUBLE END AS e FROM long),
y AS (SELECT model, seed, metric, CASE WHEN e IS NULL THEN 'missing_or_non_numeric' WHEN abs(e - value) <= 1e-4::DOUBLE + 1e-4::DOUBLE * abs(value) THEN 'within_tolerance' ELSE 'tolerance_exceeded' END AS reason FROM x)
SELECT model, seed, metric, CASE WHEN reason = 'within_tolerance' THEN 'PASS' ELSE 'FAIL' END AS status, reason FROM y""",
    "rc3_matrix_gaps": f"""WITH {_SQL_RUNS}, s AS (SELECT model, seed FROM runs WHERE last_id % 3 <> 0), t AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE seed = 42), m AS (SELECT DISTINCT model FROM runs), k AS (SELECT DISTINCT seed FROM runs)
SELECT m.model, k.seed, count(t.model) AS n, CASE WHEN count(t.model) = 0 THEN 'missing' ELSE 'duplicate' END AS problem FROM m CROSS JOIN k LEFT JOIN t ON t.model = m.model AND t.seed = k.seed GROUP BY 1, 2 HAVING count(t.model) <> 1""",
    "ag22_uneven_fields": "SELECT 'lang' AS field, count(DISTINCT lang) AS n_values FROM documents HAVING count(DISTINCT lang) > 1 UNION ALL SELECT 'source', count(DISTINCT source) FROM documents HAVING count(DISTINCT source) > 1",
    "rc20_exact_mirror": """WITH a AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN '0.00' ELSE total END AS total FROM a)
SELECT side, o_orderkey, total, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1, 2, 3""",
    "rc21_gates": "SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' ELSE 'failed' END AS problem FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 10 = 0 AND quality IS DISTINCT FROM 1",
    "rc22_bundles": """SELECT source, count(*) AS files, count(*) FILTER (doc_id % 7 = 0) AS metadata, count(DISTINCT doc_id // 7) AS stems FROM documents GROUP BY 1 HAVING files <> 2 OR metadata <> 1 OR stems <> 1""",
    "rc19_artifact_chain": "SELECT conv_id, sha256(string_agg(turn || ':' || role, chr(10) ORDER BY turn, role)) AS chain FROM conversations GROUP BY 1",
    "rc10_inventory": """SELECT page_id, 'missing' AS problem FROM pages WHERE page_id % 20 <> 0 AND page_id % 21 = 0 UNION ALL SELECT page_id, 'unexpected' FROM pages WHERE page_id % 20 = 0 AND page_id % 21 <> 0
UNION ALL SELECT page_id, 'hash' FROM pages WHERE page_id % 20 <> 0 AND page_id % 21 <> 0 AND page_id % 33 = 0""",
    "jn12_field_mismatches": """SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS expected, NULL::VARCHAR AS actual FROM customer WHERE c_custkey % 50 = 0 AND c_mktsegment IS NOT NULL
UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, '99' FROM customer WHERE c_custkey % 70 = 0 AND c_nationkey <> 99""",
    "wn4_last_and_best": "SELECT conv_id, max(turn) AS last_place, arg_max(length(text), turn) AS last_value, first(turn ORDER BY length(text) DESC, turn) AS best_place, max(length(text)) AS best_value FROM conversations GROUP BY 1",
    "wn13_sequence_check": """WITH r AS (SELECT * FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1)) SELECT conv_id, count(*) AS n, min(turn) AS lowest, max(turn) AS highest FROM r GROUP BY 1 HAVING count(*) <> count(DISTINCT turn) OR min(turn) <> 0 OR max(turn) <> count(*) - 1""",
    "jn2_manifest": """SELECT r_name, n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "jn15_alias_mapping": "SELECT CASE WHEN split_part(p_type, ' ', 1) < 'P' THEN lower(split_part(p_type, ' ', 1)) ELSE 'UNKNOWN' END AS class_name, count(*) AS n FROM part GROUP BY 1",
    "sc12_scalar_epochs": "SELECT event_id // 500 + 1 AS epoch, avg(value) FILTER (event_type = 'click') AS train_loss, avg(value) FILTER (event_type = 'view') AS lr FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "ag15_exact_percentiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice::DOUBLE, 0.99), 6) AS p99 FROM lineitem GROUP BY 1",
    "ag13_exact_moments": "SELECT l_returnflag, l_linestatus, m AS metric, count(v) AS n, round(fsum(v), 5) AS sum, round(fsum(v) / count(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM (SELECT l_returnflag, l_linestatus, unnest(['l_extendedprice', 'l_discount', 'l_tax']) AS m, unnest([l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS v FROM lineitem) GROUP BY 1, 2, 3",
    "sc12_event_files": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE value IS NOT NULL)
SELECT event_id // 500 + 1 AS epoch, CAST(NULL AS VARCHAR) AS error, count(*) AS n FROM e WHERE user_id % 9 <> 4 OR back > 1 GROUP BY 1
UNION ALL SELECT NULL, 'truncated record', count(DISTINCT user_id) FROM e WHERE user_id % 9 = 4 HAVING count(*) > 0""",
    "sc12_event_file_epochs": "SELECT event_id // 500 + 1 AS epoch, round(avg(round(value, 0)) FILTER (event_type = 'click'), 6) AS train_loss, round(avg(round(value, 0)) FILTER (event_type = 'view'), 6) AS lr FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY 1",
    "rc1_comparison": f"WITH {_SQL_RUN_ROWS} SELECT * FROM r",
    "rc1_aggregates": f"WITH {_SQL_RUN_ROWS} SELECT model, count(*) AS runs, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std' for m in runs.AGGREGATED)} FROM r GROUP BY 1",
    "sc13_epochs_from_one": "SELECT CAST(event_id + CASE WHEN (SELECT min(event_id) FROM events) = 0 THEN 1 ELSE 0 END AS INTEGER) AS epoch, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS train_box_loss FROM events WHERE event_id < 500",
    "ag20_progress": "SELECT o_orderpriority, count(*) AS planned, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1",
    "ag7_prepared_summary": """WITH s AS (SELECT DISTINCT text FROM documents WHERE doc_id % 4 <> 0) SELECT lang, count(*) FILTER (doc_id % 4 <> 0) AS train, count(*) FILTER (doc_id % 4 = 0) AS val,
 count(*) FILTER (doc_id % 4 = 0 AND text IN (SELECT text FROM s)) AS seen_in_train FROM documents GROUP BY 1""",
    "pr45_gflops": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_size + 0.5::DOUBLE END AS gflops, CAST(CASE WHEN p_size >= 25 THEN p_size - 25 END AS BIGINT) AS stat FROM part",
    "hs8_member_hash": "SELECT source, sha256(array_to_string(list_sort(list(lang || '_' || doc_id)), chr(10))) AS digest FROM documents GROUP BY 1",
}
