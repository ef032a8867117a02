"""Detection evaluation over boxes projected from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark.functions import geometry as g
from sievemark.functions import text
from sievemark.operators import evaluation as evaluated
from sievemark.operators import matching, review
from sievemark.plans.curation import SQL_BOXES
from sievemark.session import table


def _sides(spark, d):
    """Targets and predictions."""
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("id"), F.floor(F.col("event_id") / 100).alias("image_id"), F.col("event_type").alias("category"), (F.col("event_id") % 16).cast("double").alias("x"), (F.col("event_id") * 7 % 16).cast("double").alias("y"),
        (24 + F.col("event_id") % 5).cast("double").alias("w"), (24 + F.col("event_id") % 7).cast("double").alias("h"), (F.least("value", F.lit(200.0)) / 200).alias("score"), (F.col("event_id") % 3 == 0).alias("is_gt"),
    )
    return rows.where("is_gt").drop("is_gt", "score"), rows.where("not is_gt").drop("is_gt")


def _finer(spark, d):
    """The same in twice the images: about ten boxes of a category each."""
    more = lambda rows: rows.withColumn("image_id", F.col("image_id") * 2 + F.col("id") % 2)
    a, b = _sides(spark, d)
    return more(a), more(b)


def jn5_iou_join(spark, d):
    return matching.iou_pairs(*_sides(spark, d), ["image_id", "category"], 0.5)


def jn6_iou_in_image(spark, d):
    return matching.iou_pairs(*_finer(spark, d), ["image_id"], 0.7)


def jn7_group_sizes(spark, d):
    a, b = _finer(spark, d)
    n = lambda rows, c: rows.groupBy("image_id", "category").agg(F.count("*").alias(c))
    return n(a, "targets").join(n(b, "predictions"), ["image_id", "category"], "full").fillna(0)


def wn1_topk(spark, d):
    return matching.top_per_image(_sides(spark, d)[1], 20).select("image_id", "id", F.col("rank").cast("long").alias("rank"))


def ev1_greedy_match(spark, d):
    return matching.outcomes(*_finer(spark, d)).select("image_id", "category", "id", F.col("tp").cast("long").alias("tp"), "target_id")


def ag9_match_counts(spark, d):
    return matching.match_counts(*_finer(spark, d))


def ag10_rates(spark, d):
    return matching.rates(matching.match_counts(*_finer(spark, d)))


def ev4_sweep(spark, d):
    return matching.threshold_sweep(*_finer(spark, d))


def ev5_threshold_select(spark, d):
    return matching.choose_threshold(matching.threshold_sweep(*_finer(spark, d)), 0.3, 0.2)


def wn6_best_f1(spark, d):
    return matching.best_f1(matching.threshold_sweep(*_finer(spark, d)))


def ev7_confusion(spark, d):
    return matching.confusion(*_finer(spark, d)).select(F.col("true").alias("true_class"), F.col("predicted").alias("predicted_class"), "n", "share")


def ev2_merge_nms(spark, d):
    return matching.suppress(_finer(spark, d)[1], 0.5, False, ["image_id"])


def ev3_deployment_nms(spark, d):
    return matching.suppress(_finer(spark, d)[1], 0.5, True, ["image_id"], 5)


def ag11_average_precision(spark, d):
    return matching.average_precision(*_sides(spark, d))


def ag11_ap_at_half(spark, d):
    """Average precision of each category's curve at one overlap."""
    targets, predictions = _finer(spark, d)
    return matching.curve_average(matching.outcomes(targets, predictions), targets.groupBy("category").agg(F.count("*").alias("n")), ["category"])


def ag11_coco_stats(spark, d):
    """The twelve summary figures and the categories' means."""
    return evaluated.average_figures(*_sides(spark, d)).select("section", "category", "name", "value")


def ev8_full_evaluation(spark, d):
    """Figures at the operating point, curves, calibration and confusion of the validation part in one table."""
    return evaluated.operating_figures(*_finer(spark, d), "validation", target_precision=0.3, least_bound=0.2)


def ev8_test_evaluation(spark, d):
    """The same of the test part, on which no threshold is chosen."""
    rows = evaluated.operating_figures(*_finer(spark, d), "test")
    return rows.where("section IN ('metrics', 'calibration')").drop("against", "confidence")


def pr22_safe_ratio(spark, d):
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count_if(F.col("doc_id") % 7 == 0).alias("a"), F.count_if(F.col("doc_id") % 11 == 0).alias("b"))
    return rows.select("source", "lang", g.safe_ratio(F.col("a"), F.col("b")).alias("ratio"))


def pr23_wilson(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return rows.select("source", "good", "n", g.wilson_lower(F.col("good"), F.col("n")).alias("bound"))


def pr17_coco_predictions(spark, d):
    rows = _sides(spark, d)[1]
    corners = g.xywh_to_xyxy(g.box("x", "y", "w", "h"))
    clipped = tuple(F.least(c, F.lit(32.0)) for c in corners)
    q = g.xyxy_to_xywh(clipped)
    names = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3)], "category string, category_id int")
    out = rows.select("id", "image_id", "category", "score", *[c.alias(n) for n, c in zip(("x", "y", "w", "h"), q, strict=True)])
    return out.where("w > 0 and h > 0").join(F.broadcast(names), "category").drop("category")


def _proposals(spark, d):
    rows = _finer(spark, d)[1]
    threshold = [F.lit(None).cast("double"), F.when(F.col("category") == "click", 0.6), F.when(F.col("category") == "view", 0.3), F.lit(0.5)]
    return rows.select("id", (F.col("image_id") % 400).alias("image"), F.col("score").alias("confidence"), text.review_status(F.col("score"), *threshold).alias("review_status"))


def pr20_review_status(spark, d):
    return _proposals(spark, d).select("id", "review_status")


def ag12_review_summary(spark, d):
    rows = _proposals(spark, d).where("image % 5 <> 0").withColumn("high", F.col("review_status") == "high_confidence_candidate")
    return review.review_queue(spark.range(400).withColumnRenamed("id", "image"), rows).withColumn("priority", F.col("priority").cast("long"))


def wn7_review_queue(spark, d):
    return review.in_review_order(ag12_review_summary(spark, d)).select("image", "priority", "image_status")


def cn11_promotion(spark, d):
    rows = _proposals(spark, d)
    choice = F.element_at(F.array(F.lit("include"), F.lit("reject"), F.lit("empty")), (F.col("id") % 3 + 1).cast("int"))
    decisions = spark.range(400).select(F.col("id").alias("image"), choice.alias("disposition"))
    kept = review.promoted(rows, decisions).groupBy("image").agg(F.count("*").alias("n")).select("image", F.lit("promoted").alias("outcome"), "n")
    return kept.unionByName(review.disposition_problems(rows, decisions).select("image", F.col("problem").alias("outcome"), F.lit(0).cast("long").alias("n")))


def ev9_decode(spark, d):
    """Class scores of model outputs: the best class, from 0, and its score, above a floor."""
    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 5, 10).alias("s"))
    best = rows.select("vec_id", F.array_max("s").cast("double").alias("score"), (F.array_position("s", F.array_max("s")) - 1).alias("class_id"))
    return best.where("score >= 0.05")


def ev10_tile_merge(spark, d):
    """Boxes of tiles moved to the image, clipped, small ones dropped, and merged by suppression."""
    rows = _finer(spark, d)[1]
    left, top = (F.col("id") % 3) * 8.0, (F.col("id") % 2) * 8.0
    moved = rows.withColumn("x", F.col("x") + left).withColumn("y", F.col("y") + top)
    clipped = moved.withColumn("w", F.least(F.col("x") + F.col("w"), F.lit(48.0)) - F.col("x")).withColumn("h", F.least(F.col("y") + F.col("h"), F.lit(48.0)) - F.col("y"))
    return matching.suppress(clipped.where("w >= 26 and h >= 26 and category <> 'error'"), 0.55, False, ["image_id"])


_IOU = "(greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y))) / (p.w * p.h + g.w * g.h - greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)))"
_SIDE = lambda q, o, c: f"greatest(0, least({q}.{o} + {q}.{c}, g.{o} + g.{c}) - greatest({q}.{o}, g.{o}))"
_AREA = lambda q: f"(greatest(0, {q}.w) * greatest(0, {q}.h))"
_COMMON = f"({_SIDE('p', 'x', 'w')} * {_SIDE('p', 'y', 'h')})"
_IOU_CORNERS = f"({_COMMON} / nullif({_AREA('p')} + {_AREA('g')} - {_COMMON}, 0))"
_FINE = f"{SQL_BOXES}, f AS (SELECT * REPLACE (image_id * 2 + id % 2 AS image_id) FROM b)"


def _sql_match(keys: str) -> str:
    same = " AND ".join(f"g.{k} = p.{k}" for k in keys.split(", "))
    to_p = " AND ".join(f"m.{k} = p.{k}" for k in keys.split(", "))
    mk = ", ".join(f"m.{k}" for k in keys.split(", "))
    return f"""{_FINE}, p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS rk FROM f WHERE NOT is_gt), g AS (SELECT * FROM f WHERE is_gt),
m({keys}, rk, id, kind, tp, target_id, used) AS (
 SELECT {keys}, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0, NULL::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT {keys} FROM p)
 UNION ALL
 SELECT {mk}, p.rk, p.id, p.category, CASE WHEN z.s.i >= 0.5 THEN 1 ELSE 0 END, CASE WHEN z.s.i >= 0.5 THEN z.s.gid END, CASE WHEN z.s.i >= 0.5 THEN list_append(m.used, z.s.gid) ELSE m.used END
 FROM m JOIN p ON {to_p} AND p.rk = m.rk + 1
 LEFT JOIN LATERAL (SELECT max(struct_pack(i := {_IOU}, gid := g.id)) AS s FROM g WHERE {same} AND NOT list_contains(m.used, g.id)) z ON true)"""


_SQL_OUTCOMES = f"{_sql_match('image_id, category')}, o AS (SELECT m.image_id, m.category, m.id, m.tp, m.target_id, p.score FROM m JOIN p ON p.id = m.id)"
_SQL_RATES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall"""
_Z = g.Z95
_WILSON = lambda a, n: f"CASE WHEN {n} > 0 THEN greatest(0, (({a})::DOUBLE / nullif({n}, 0) + {_Z}::DOUBLE * {_Z}::DOUBLE / (2 * nullif({n}, 0)) - {_Z}::DOUBLE * sqrt((({a})::DOUBLE / nullif({n}, 0)) * (1 - ({a})::DOUBLE / nullif({n}, 0)) / nullif({n}, 0) + {_Z}::DOUBLE * {_Z}::DOUBLE / (4 * nullif({n}, 0) * nullif({n}, 0)))) / (1 + {_Z}::DOUBLE * {_Z}::DOUBLE / nullif({n}, 0))) ELSE 0 END"
_SQL_COUNTS = f"{_SQL_OUTCOMES}, c AS (SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(1 - tp) AS BIGINT) AS fp FROM o GROUP BY 1), n AS (SELECT category, count(*) AS n FROM g GROUP BY 1), k AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn FROM c FULL JOIN n USING (category))"
_SQL_FULL_RATES = f"r AS (SELECT *, {_SQL_RATES} FROM k), r2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, {_WILSON('tp', '(tp + fp)')} AS precision_wilson_lower_95 FROM r)"
_SQL_CURVE = f"""{_SQL_OUTCOMES}, n AS (SELECT category, count(*) AS n FROM g GROUP BY 1), t AS (SELECT i * 0.01::DOUBLE AS confidence FROM range(101) x(i)),
per AS (SELECT n.category, t.confidence, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(1 - tp), 0) AS BIGINT) AS fp, any_value(n) AS n FROM n CROSS JOIN t LEFT JOIN o ON o.category = n.category AND o.score >= t.confidence GROUP BY 1, 2),
k AS (SELECT category, confidence, tp, fp, n - tp AS fn FROM per UNION ALL SELECT NULL, confidence, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(n) - sum(tp) AS BIGINT) FROM per GROUP BY confidence), {_SQL_FULL_RATES}"""


def _sql_nms(rows: str, overlap: str, kind: str = "DOUBLE") -> str:
    return f"""{_FINE}, q0 AS ({rows}), q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS rk FROM q0),
m(image_id, rk, id, stays, kept) AS (
 SELECT image_id, 0::BIGINT, NULL::BIGINT, FALSE, []::BIGINT[] FROM (SELECT DISTINCT image_id FROM q)
 UNION ALL
 SELECT m.image_id, p.rk, p.id, z.n = 0, CASE WHEN z.n = 0 THEN list_append(m.kept, p.id) ELSE m.kept END
 FROM m JOIN q p ON m.image_id = p.image_id AND p.rk = m.rk + 1
 LEFT JOIN LATERAL (SELECT count(*) AS n FROM q g WHERE g.image_id = p.image_id AND g.category = p.category AND list_contains(m.kept, g.id) AND coalesce({_IOU_CORNERS}::{kind}, 0) {overlap}::{kind}) z ON true)"""


_REVIEW = "r AS (SELECT id, image_id % 400 AS image, score AS confidence, CASE WHEN score >= CASE category WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.3 ELSE 0.5 END THEN 'high_confidence_candidate' ELSE 'review_required' END AS review_status FROM f WHERE NOT is_gt)"
_QUEUE = f"""{_FINE}, {_REVIEW}, c AS (SELECT image, count(*) AS p, count(*) FILTER (review_status = 'high_confidence_candidate') AS h, min(confidence) AS lo, max(confidence) AS hi FROM r WHERE image % 5 <> 0 GROUP BY 1),
q AS (SELECT i AS image, coalesce(p, 0) AS proposals, coalesce(h, 0) AS high_confidence, lo AS min_confidence, hi AS max_confidence, coalesce(p, 0) - coalesce(h, 0) AS review_required,
 CAST(CASE WHEN p IS NULL THEN 0 WHEN h < p THEN 1 ELSE 2 END AS BIGINT) AS priority FROM range(400) x(i) LEFT JOIN c ON image = i),
s AS (SELECT *, ['{"', '".join(review.STATES)}'][priority + 1] AS image_status FROM q)"""

_LIST = lambda names: ", ".join(f"{{'name': '{n}', 'value': CAST({n} AS DOUBLE)}}" for n in names.split())
_FIGURES = lambda section, names, source, category="category", confidence="NULL", status="NULL", against="NULL": f"SELECT {section} AS section, {category} AS category, {against} AS against, CAST({confidence} AS DOUBLE) AS confidence, f.name AS name, f.value AS value, CAST({status} AS VARCHAR) AS status FROM (SELECT *, unnest([{_LIST(names)}]) AS f FROM {source})"
_COUNTED = "tp fp fn precision recall f1"
_SQL_OPERATING = f"""{_FIGURES("CASE WHEN category IS NULL THEN 'metrics' ELSE 'per_class' END", _COUNTED, "(SELECT * FROM r2 WHERE confidence = 25 * 0.01::DOUBLE)")}
UNION ALL {_FIGURES("'areas'", "small medium large", "(SELECT count(*) FILTER (w * h < 1024) AS small, count(*) FILTER (w * h >= 1024 AND w * h < 9216) AS medium, count(*) FILTER (w * h >= 9216) AS large FROM g)", "NULL")}"""
_SQL_CALIBRATED = """ok AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recall DESC, precision DESC, confidence) AS i FROM r2 WHERE tp > 0 AND precision >= 0.3 AND precision_wilson_lower_95 >= 0.2),
cal AS (SELECT a.category, CASE WHEN ok.i = 1 THEN 'VALIDATION_DERIVED_PENDING_HUMAN_REVIEW' ELSE 'NOT_AVAILABLE' END AS state, ok.* EXCLUDE (category, i) FROM (SELECT DISTINCT category FROM r2) a LEFT JOIN ok ON a.category IS NOT DISTINCT FROM ok.category AND ok.i = 1)"""

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:2] in ("ag", "pr", "jn", "wn", "ev", "cn") and k[2].isdigit()}

SQL = {
    "jn5_iou_join": f"WITH {SQL_BOXES}, p AS (SELECT * FROM b WHERE NOT is_gt), g AS (SELECT * FROM b WHERE is_gt) SELECT p.image_id, p.category, g.id AS target_id, p.id AS prediction_id, {_IOU} AS iou FROM p JOIN g ON p.image_id = g.image_id AND p.category = g.category WHERE {_IOU} >= 0.5",
    "jn6_iou_in_image": f"WITH {_FINE}, p AS (SELECT * FROM f WHERE NOT is_gt), g AS (SELECT * FROM f WHERE is_gt) SELECT p.image_id, g.id AS target_id, p.id AS prediction_id, {_IOU} AS iou FROM p JOIN g ON p.image_id = g.image_id WHERE {_IOU} >= 0.7",
    "jn7_group_sizes": f"WITH {_FINE} SELECT image_id, category, count(*) FILTER (is_gt) AS targets, count(*) FILTER (NOT is_gt) AS predictions FROM f GROUP BY 1, 2",
    "wn1_topk": f"WITH {SQL_BOXES} SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS rank FROM b WHERE NOT is_gt QUALIFY rank <= 20",
    "ev1_greedy_match": f"WITH RECURSIVE {_SQL_OUTCOMES} SELECT image_id, category, id, CAST(tp AS BIGINT) AS tp, target_id FROM o",
    "ag9_match_counts": f"WITH RECURSIVE {_SQL_COUNTS} SELECT * FROM k",
    "ag10_rates": f"WITH RECURSIVE {_SQL_COUNTS}, {_SQL_FULL_RATES} SELECT * FROM r2",
    "ev4_sweep": f"WITH RECURSIVE {_SQL_CURVE} SELECT * FROM r2",
    "ev5_threshold_select": f"""WITH RECURSIVE {_SQL_CURVE}, ok AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recall DESC, precision DESC, confidence) AS i FROM r2 WHERE tp > 0 AND precision >= 0.3 AND precision_wilson_lower_95 >= 0.2)
SELECT a.category, CASE WHEN ok.i = 1 THEN 'VALIDATION_DERIVED_PENDING_HUMAN_REVIEW' ELSE 'NOT_AVAILABLE' END AS status, ok.confidence, ok.precision, ok.precision_wilson_lower_95, ok.recall, ok.f1, ok.tp, ok.fp, ok.fn
FROM (SELECT DISTINCT category FROM r2) a LEFT JOIN ok ON a.category IS NOT DISTINCT FROM ok.category AND ok.i = 1""",
    "wn6_best_f1": f"WITH RECURSIVE {_SQL_CURVE} SELECT category, confidence, f1 FROM r2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY f1 DESC, confidence) = 1",
    "ev7_confusion": f"""WITH RECURSIVE {_sql_match("image_id")}, a AS (SELECT coalesce(g.category, 'background') AS t, m.kind AS p FROM m LEFT JOIN g ON g.id = m.target_id WHERE m.id IS NOT NULL
 UNION ALL SELECT category, 'background' FROM g WHERE id NOT IN (SELECT target_id FROM m WHERE target_id IS NOT NULL)), n AS (SELECT t, p, count(*) AS n FROM a GROUP BY 1, 2)
SELECT t AS true_class, p AS predicted_class, n, n / sum(n) OVER (PARTITION BY t) AS share FROM n""",
    "ev2_merge_nms": f"WITH RECURSIVE {_sql_nms('SELECT * FROM f WHERE NOT is_gt', '>= 0.5')} SELECT image_id, id FROM m WHERE stays",
    "ev3_deployment_nms": f"WITH RECURSIVE {_sql_nms('SELECT * FROM f WHERE NOT is_gt', '> 0.5', 'FLOAT')} SELECT image_id, id FROM m WHERE stays QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rk) <= 5",
    "ev10_tile_merge": f"""WITH RECURSIVE {_sql_nms("SELECT id, image_id, category, score, x, y, least(x + w, 48) - x AS w, least(y + h, 48) - y AS h FROM (SELECT * REPLACE (x + (id % 3) * 8 AS x, y + (id % 2) * 8 AS y) FROM f WHERE NOT is_gt) WHERE least(x + w, 48) - x >= 26 AND least(y + h, 48) - y >= 26 AND category <> 'error'", ">= 0.55")} SELECT image_id, id FROM m WHERE stays""",
    "ag11_ap_at_half": f"""WITH RECURSIVE {_SQL_OUTCOMES}, n AS (SELECT category, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT category, n, tp, sum(tp) OVER w AS tps, row_number() OVER w AS seen FROM o JOIN n USING (category) WINDOW w AS (PARTITION BY category ORDER BY score DESC, image_id, id ROWS UNBOUNDED PRECEDING)),
best AS (SELECT *, max(tps / seen) OVER (PARTITION BY category ORDER BY seen DESC ROWS UNBOUNDED PRECEDING) AS best FROM c),
k AS (SELECT category, best, len(list_filter(range(101), lambda i: i * 0.01::DOUBLE <= tps / n AND (seen = 1 OR i * 0.01::DOUBLE > (tps - tp) / n))) AS points FROM best)
SELECT category, sum(best * points) / 101 AS ap FROM k GROUP BY 1""",
    "ev8_full_evaluation": f"""SELECT * FROM (WITH RECURSIVE {_SQL_CURVE}, {_SQL_CALIBRATED} {_SQL_OPERATING}
UNION ALL {_FIGURES("CASE WHEN category IS NULL THEN 'curve' ELSE 'class_curve' END", f"{_COUNTED} precision_wilson_lower_95", "r2", confidence="confidence")}
UNION ALL {_FIGURES("'metrics'", "best_f1 best_f1_confidence", "(SELECT f1 AS best_f1, confidence AS best_f1_confidence FROM r2 WHERE category IS NULL ORDER BY f1 DESC, confidence LIMIT 1)", "NULL")}
UNION ALL {_FIGURES("'calibration'", f"confidence {_COUNTED} precision_wilson_lower_95", "cal", status="state")})
UNION ALL SELECT * FROM (WITH RECURSIVE {_sql_match("image_id").replace("FROM f WHERE NOT is_gt)", "FROM f WHERE NOT is_gt AND score >= 0.25)", 1)}, a AS (SELECT coalesce(g.category, 'background') AS t, m.kind AS p FROM m LEFT JOIN g ON g.id = m.target_id WHERE m.id IS NOT NULL
 UNION ALL SELECT category, 'background' FROM g WHERE id NOT IN (SELECT target_id FROM m WHERE target_id IS NOT NULL)), n AS (SELECT t, p, count(*) AS n FROM a GROUP BY 1, 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY t) AS share FROM n)
{_FIGURES("'confusion'", "n share", "q", "t", against="p")})""",
    "ev8_test_evaluation": f"""WITH RECURSIVE {_SQL_CURVE}
SELECT section, category, name, value, status FROM ({_SQL_OPERATING}) WHERE section = 'metrics'
UNION ALL SELECT DISTINCT 'calibration', category, 'confidence', CAST(NULL AS DOUBLE), 'NOT_FOR_THRESHOLD_SELECTION' FROM r2""",
    "pr22_safe_ratio": "SELECT source, lang, coalesce(count(*) FILTER (doc_id % 7 = 0) / nullif(count(*) FILTER (doc_id % 11 = 0), 0), 0) AS ratio FROM documents GROUP BY 1, 2",
    "pr23_wilson": f"WITH a AS (SELECT source, CAST(sum(quality) AS BIGINT) AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT *, {_WILSON('good', 'n')} AS bound FROM a",
    "pr17_coco_predictions": f"""WITH {SQL_BOXES}, k AS (SELECT *, least(x, 32) AS x1, least(y, 32) AS y1, least(x + w, 32) AS x2, least(y + h, 32) AS y2 FROM b WHERE NOT is_gt)
SELECT id, image_id, score, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, CAST(CASE category WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS INTEGER) AS category_id FROM k WHERE x2 > x1 AND y2 > y1 AND category IN ('click', 'view', 'purchase')""",
    "pr20_review_status": f"WITH {_FINE}, {_REVIEW} SELECT id, review_status FROM r",
    "ag12_review_summary": f"WITH {_QUEUE} SELECT * FROM s",
    "wn7_review_queue": f"WITH {_QUEUE} SELECT image, priority, image_status FROM s ORDER BY priority, coalesce(min_confidence, -1), image",
    "cn11_promotion": f"""WITH {_FINE}, {_REVIEW}, n AS (SELECT i AS image, ['include', 'reject', 'empty'][i % 3 + 1] AS d, count(r.id) AS n FROM range(400) x(i) LEFT JOIN r ON r.image = i GROUP BY 1, 2)
SELECT image, 'promoted' AS outcome, n FROM n WHERE d = 'include' AND n > 0 UNION ALL SELECT image, CASE WHEN d = 'include' THEN 'included_without_annotation' ELSE 'empty_with_annotation' END, 0 FROM n WHERE (d = 'include' AND n = 0) OR (d = 'empty' AND n > 0)""",
    "ev9_decode": "WITH s AS (SELECT vec_id, embedding[5:14] AS s FROM embeddings) SELECT vec_id, CAST(list_max(s) AS DOUBLE) AS score, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS class_id FROM s WHERE list_max(s) >= 0.05",
}
