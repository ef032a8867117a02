"""Audit, splits and canonical forms over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import geometry as g
from sievemark.functions import identity, text
from sievemark.operators import canonical, compare, duplicates, graph, inventory, review, splits
from sievemark.session import table

# Projections of the test tables onto files, hashes and groups; the same in SQL below.
PATH = "concat(source, '/', lang, '/', cast(doc_id as string), '.txt')"
# A 64-bit hash that up to 16 documents share but for six bits or fewer.
SQL_HASH = "xor(xor(xor(CAST('0x' || substr(md5(CAST(doc_id // 16 AS VARCHAR)), 1, 16) AS HUGEINT), 1::HUGEINT << CAST(doc_id % 16 AS INTEGER)), 1::HUGEINT << CAST(16 + doc_id % 7 AS INTEGER)), 1::HUGEINT << CAST(40 + doc_id % 24 AS INTEGER))"
BITS, MOST = 64, 4


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """id, hash (BITS bits), pixels."""
    digest = identity.sha256_text(F.col("text"))
    shared = identity.hash64(F.substring(F.md5(F.floor(F.col("doc_id") / 16).cast("string")), 1, 16))
    flipped = [F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int")) for x in (F.col("doc_id") % 16, 16 + F.col("doc_id") % 7, 40 + F.col("doc_id") % 24)]
    own = shared.bitwiseXOR(flipped[0]).bitwiseXOR(flipped[1]).bitwiseXOR(flipped[2])
    return _docs(spark, d).select(F.col("doc_id").alias("id"), own.alias("hash"), digest.alias("pixels"))


_SQL_HASHED = f"h AS (SELECT doc_id AS id, {SQL_HASH} AS hash, sha256(text) AS pixels FROM documents)"
_SQL_PAIRS = f"""{_SQL_HASHED},
pairs AS (SELECT l.id AS left_id, r.id AS right_id, CAST(bit_count(xor(l.hash, r.hash)) AS INTEGER) AS distance FROM h l JOIN h r
  ON l.id < r.id AND bit_count(xor(l.hash, r.hash)) <= {MOST} AND l.pixels <> r.pixels)"""


def ag1_duplicate_groups(spark, d):
    return duplicates.duplicate_groups(_docs(spark, d), identity.sha256_text(F.col("text")), F.col("lang"), F.col("doc_id"))


def hs1_content_hash(spark, d):
    return _docs(spark, d).select("doc_id", identity.sha256_text(F.col("text")).alias("sha256"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("bytes"))


def hs10_newline_variants(spark, d):
    return _docs(spark, d).select("doc_id", *[c.alias(k) for k, c in identity.newline_variants(F.col("text")).items()])


def hs7_assignment_hash(spark, d):
    rows = splits.group_split(_groups(spark, d))
    return rows.groupBy("model").agg(identity.hash_of_members(F.concat_ws(":", "group_id", "split")).alias("assignment_sha256"))


def pr1_path_labels(spark, d):
    rows = _docs(spark, d).select("doc_id", F.expr(PATH).alias("path"))
    p = F.col("path")
    return rows.select("doc_id", text.class_of_path(p, ["de", "en", "src3"]).alias("class_name"), text.source_of_path(p).alias("source_name"), text.split_of_path(p).alias("split"))


def pr4_quality_flags(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.col("n_chars") % 2000).alias("w"), (F.col("doc_id") * 37 % 1500).alias("h"), F.when(F.col("lang") == "de", text.UNASSIGNED).otherwise(F.col("lang")).alias("c"))
    return rows.select("doc_id", text.quality_flags(F.col("w"), F.col("h"), F.col("c")).alias("quality_flags"))


def jn1_hamming_pairs(spark, d):
    return duplicates.hamming_pairs(_hashed(spark, d), MOST, BITS)


def wn8_capped_pairs(spark, d):
    return duplicates.capped_pairs(duplicates.hamming_pairs(_hashed(spark, d), MOST, BITS), 25)


def ag3_pairs_by_split(spark, d):
    split = F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "val").otherwise("test")
    return duplicates.pairs_by_split(duplicates.hamming_pairs(_hashed(spark, d), MOST, BITS), _hashed(spark, d).select("id", split.alias("split")))


def ag2_audit_summary(spark, d):
    rows = _docs(spark, d).withColumn("h", identity.sha256_text(F.col("text")))
    return rows.groupBy("source").agg(
        F.count("*").alias("files"), F.count_distinct("h").alias("distinct_files"), F.count_if(F.col("n_chars") < 200).alias("short_files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang").isNull()).alias("unassigned")
    )


def _groups(spark, d):
    return _docs(spark, d).select(F.col("lang").alias("model"), F.concat_ws("_", "lang", "source").alias("group_id")).distinct()


def wn2_hash_order(spark, d):
    return splits.hash_ranks(_groups(spark, d))


def gr2_allocation(spark, d):
    rows = _docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n")).where("n >= 3")
    return rows.select("source", "lang", "n", *[c.alias(k) for k, c in splits.allocation(F.col("n"), {"train": 0.7, "val": 0.2, "test": 0.1}).items()])


def gr3_group_split(spark, d):
    return splits.group_split(_groups(spark, d))


def gr4_component_split(spark, d):
    """Groups of a source in components of two sources."""
    rows = _groups(spark, d).withColumn("component_id", F.concat_ws("_", "model", (F.regexp_extract("group_id", r"(\d+)$", 1).cast("int") / 2).cast("int")))
    return splits.component_split(rows, ratios={"train": 0.6, "val": 0.2, "test": 0.2})


def gr4_split_audit(spark, d):
    """Customers of a segment as its groups, in components by account: sums of parts, and whether components stayed whole."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("group_id"))
    rows = c.withColumn("component_id", F.when(F.col("group_id") % 50 == 7, F.concat(F.lit("shared_"), F.floor(F.col("group_id") / 200).cast("string"))).otherwise(F.concat_ws("_", "model", F.floor(F.col("group_id") / 8).cast("string"))))
    return splits.split_audit(rows, splits.component_split(rows))


def ag6_mixed_groups(spark, d):
    return splits.mixed_groups(_docs(spark, d).select(F.col("source").alias("group_id"), F.col("lang").alias("model")))


def st3_split_overlap(spark, d):
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    return splits.split_overlap(_docs(spark, d).select(F.col("text").alias("group_id"), split.alias("split")))


def ag4_split_summary(spark, d):
    rows = _docs(spark, d).withColumn("group_id", F.concat_ws("_", "lang", "source")).join(splits.group_split(_groups(spark, d)).drop("rank"), "group_id")
    return rows.groupBy("model", "split").agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"), F.sum("n_chars").alias("chars"))


def ag4_split_overlaps(spark, d):
    """For each model and pair of parts: the groups, and the texts, that both have."""
    rows = _docs(spark, d).withColumn("group_id", F.concat_ws("_", "lang", "source")).join(splits.group_split(_groups(spark, d)).drop("rank"), "group_id")
    return splits.pair_overlaps(rows.select("model", "split", "group_id", F.md5(F.encode("text", "UTF-8")).alias("text")), "model", ["group_id", "text"])


def _edges(spark, d):
    rows = _docs(spark, d).select(F.concat_ws("_", "lang", "source").alias("g"), "text")
    first = rows.groupBy("text").agg(F.min("g").alias("b"))
    return rows.join(first, "text").select(F.col("g").alias("a"), "b").distinct()


def gr1_components(spark, d):
    members = graph.components(_edges(spark, d))
    return members.join(graph.component_ids(members), "root").select("node", "component_id")


def ag5_component_audit(spark, d):
    members = graph.components(_edges(spark, d)).select("root", F.col("node").alias("group_id"))
    sizes = _docs(spark, d).groupBy(F.concat_ws("_", "lang", "source").alias("group_id"), F.col("lang").alias("model")).agg(F.count("*").alias("n"))
    return members.join(sizes, "group_id").groupBy("root").agg(F.count("*").alias("groups"), F.sum("n").alias("images"), F.count_distinct("model").alias("models"))


def sc17_category_walk(spark, d):
    """Parts below a brand, by size, as a hierarchy with a cycle."""
    p = table(spark, d, "part")
    edges = p.select(F.col("p_brand").alias("parent"), F.concat(F.lit("s"), F.col("p_size")).alias("child")).union(p.select(F.concat(F.lit("s"), F.col("p_size")), "p_type")).union(p.select("p_type", "p_brand")).distinct()
    return graph.walk_down(edges, p.select(F.min("p_brand").alias("node")), 3)


def sc17_capped_walk(spark, d):
    """The first 700 parts that a queue meets below a brand: sizes and types, which lead back, name parts as they go."""
    p = table(spark, d, "part")
    size, n = F.concat(F.lit("s"), F.col("p_size").cast("string")), F.col("p_partkey") * 5
    edge = lambda parent, k, child, is_file: p.select(parent.alias("parent"), (n + k).alias("position"), child.alias("child"), F.lit(is_file).alias("is_file"))
    brand, kind, name = F.col("p_brand"), F.col("p_type"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))
    members = edge(brand, 0, size, False).union(edge(size, 1, kind, False)).union(edge(kind, 2, brand, False)).union(edge(size, 3, name, True)).union(edge(kind, 4, name, True))
    return graph.walk_files(members, "Brand#1", 2, 700)


def rc13_tree_differences(spark, d):
    """Documents as files of a tree, and the same tree with some missing, some changed and some more."""
    rows = _docs(spark, d).select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    other = rows.where("doc_id % 70 <> 6").withColumn("sha256", F.when(F.col("doc_id") % 90 == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return inventory.file_differences(inventory.tree(rows.where("doc_id % 80 <> 9")), inventory.tree(other))


def rc10_tree(spark, d):
    """Folders of documents with their numbers of files and bytes."""
    rows = _docs(spark, d).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    return inventory.tree(rows).where("NOT is_file").select("path", "depth", "files", "bytes")


def jn8_missing_unexpected(spark, d):
    return compare.set_difference(_docs(spark, d).where("doc_id % 3 <> 0"), table(spark, d, "labels"), "doc_id")


def jn10_protected_overlap(spark, d):
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    protected = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.join(protected, "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("protected_lines"))


def st1_multiset_diff(spark, d):
    rows = _docs(spark, d)
    return compare.multiset_difference(rows.where("doc_id % 2 = 0").select("lang", "source"), rows.where("doc_id % 2 = 1").select("lang", "source"))


def st6_cross_split_sha(spark, d):
    rows = _docs(spark, d).select(identity.sha256_text(F.col("text")).alias("sha256"), (F.col("doc_id") % 3).alias("split"))
    return compare.shared_between(rows, "sha256", "split")


def st7_repeated_texts(spark, d):
    return compare.repeated_values(_docs(spark, d).select(F.md5(F.encode("text", "UTF-8")).alias("md5")), "md5")


def st5_evidence_union(spark, d):
    a = _docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    return a.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


def _boxes(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.floor(F.col("event_id") / 100).alias("image_id"), F.col("event_type").alias("category"), (F.col("event_id") % 16).cast("double").alias("x"), (F.col("event_id") * 7 % 16).cast("double").alias("y"),
        (24 + F.col("event_id") % 5).cast("double").alias("w"), (24 + F.col("event_id") % 7).cast("double").alias("h"),
    )


SQL_BOXES = """b AS (SELECT event_id AS id, event_id // 100 AS image_id, event_type AS category, CAST(event_id % 16 AS DOUBLE) AS x,
 CAST((event_id * 7) % 16 AS DOUBLE) AS y, CAST(24 + event_id % 5 AS DOUBLE) AS w, CAST(24 + event_id % 7 AS DOUBLE) AS h,
 least(value, 200) / 200 AS score, event_id % 3 = 0 AS is_gt FROM events)"""


def pr5_yolo_lines(spark, d):
    q = g.box("x", "y", "w", "h")
    return _boxes(spark, d).select("id", g.yolo_line(F.col("id") % 6, q, F.lit(42), F.lit(64)).alias("line"))


def pr7_valid_boxes(spark, d):
    q = g.box(F.col("x") - 1, F.col("y") - 0.0000005, F.col("w"), F.col("h"))
    rows = _boxes(spark, d)
    return rows.select("id", g.valid_xywh(q, F.lit(40), F.lit(41)).alias("valid"), *[c.alias(n) for n, c in zip(("x", "y", "w", "h"), g.clamped_xywh(q), strict=True)])


def pr8_canonical_yolo(spark, d):
    q = g.to_unit_centre(g.box("x", "y", "w", "h"), F.lit(64.0), F.lit(64.0))
    rows = _boxes(spark, d).select("id", g.canonical_from_yolo(q, F.lit(640), F.lit(480)).alias("b"))
    return rows.select("id", *[F.get("b", i).alias(n) for i, n in enumerate(("x", "y", "w", "h"))])


def pr11_half_even(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") * F.col("l_discount") / 8).cast("decimal(20,8)").alias("v")).distinct().select("v", g.quantized(F.col("v")).alias("q"))


def pr15_box_forms(spark, d):
    q = g.centre_to_xyxy(g.box("x", "y", "w", "h"))
    back = g.xyxy_to_xywh(q)
    iou = g.iou_xyxy(q, g.xywh_to_xyxy(g.box("x", "y", "w", "h")))
    restored = g.restored_xyxy(q, F.lit(0.5), F.lit(2.0), F.lit(3.0), F.lit(50), F.lit(60))
    names = ("x1", "y1", "x2", "y2")
    return _boxes(spark, d).select("id", *[c.alias(n) for n, c in zip(names, q, strict=True)], back[2].alias("w"), back[3].alias("h"), iou.alias("iou"), *[c.alias("r_" + n) for n, c in zip(names, restored, strict=True)])


def pr18_tiles(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 300).cast("int").alias("width"), (F.col("p_partkey") % 900 + 300).cast("int").alias("height"))
    return rows.select("p_partkey", F.explode(g.tile_grid(F.col("width"), F.col("height"), 640, 0.2)).alias("t")).select("p_partkey", "t.*")


def pr21_size_classes(spark, d):
    area = F.col("p_size") * F.col("p_size") * 4.0
    return table(spark, d, "part").groupBy(g.size_class(area).alias("size_class")).agg(F.count("*").alias("n"))


def ev11_letterbox(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 300).alias("width"), (F.col("p_partkey") % 900 + 300).alias("height"))
    a, b = (g.letterbox(F.col("width"), F.col("height"), 640, x) for x in (True, False))
    return rows.select("p_partkey", *[c.cast("double").alias(k) for k, c in a.items()], b["resized_width"].cast("double").alias("plain_width"), b["resized_height"].cast("double").alias("plain_height"))


def pr24_stripped_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


def pr24_clean_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("plain"))


def pr25_stems(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


def pr26_safe_paths(spark, d):
    p = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("../"), F.col("source"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("/"), F.col("source"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("C:\\"), F.col("source"))).otherwise(F.concat_ws("/", "source", "lang"))
    return _docs(spark, d).select("doc_id", text.is_safe_relative_path(p).alias("safe"), text.sha256_or_null(F.upper(identity.sha256_text(p))).alias("sha256"))


def pr28_licenses(spark, d):
    name = F.concat(F.lit("CC "), F.element_at(F.array(F.lit("BY 4.0"), F.lit("BY-SA 4.0"), F.lit("BY-NC 4.0"), F.lit("BY_ND"), F.lit("0")), (F.col("page_id") % 5 + 1).cast("int")))
    rows = table(spark, d, "pages").select("page_id", name.alias("license"), "url", F.when(F.col("page_id") % 7 > 0, "free").alias("terms"), F.when(F.col("page_id") % 3 > 0, "someone").alias("artist"))
    prefixes = ["cc by", "cc0", "public domain"]
    why = text.license_problem(F.col("license"), F.col("url"), F.col("terms"), F.col("artist"), F.lit(None).cast("string"), prefixes)
    return rows.select("page_id", text.license_allowed(F.col("license"), prefixes).alias("allowed"), why.alias("reason"))


def pr30_keywords(spark, d):
    return table(spark, d, "pages").select("page_id", text.keywords_allow(F.col("url"), ["EXAMPLE.com", "example.net"], ["page=2"]).alias("allowed"))


def pr31_url_rules(spark, d):
    """Addresses with other schemes, users, ports, hosts, fragments and paths than may be fetched."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    port = F.element_at(F.array(*map(F.lit, ("", ":443", ":8443", ":abc", ":", ":99999"))), (F.length("html") % 6 + 1).cast("int"))
    before = F.when(F.length("html") % 7 == 0, "me@").otherwise("")
    end = F.when(F.length("html") % 5 == 0, "/x#y").when(F.length("html") % 5 == 1, "").otherwise("/x")
    url = F.concat(F.when(F.length("html") % 11 == 0, "http").otherwise("https"), F.lit("://"), before, host, port, end)
    url = F.when(F.length("html") % 13 == 0, "").otherwise(url)
    return table(spark, d, "pages").select("page_id", text.url_problem(url, ["thther.example.org", "m.ththth.example.net", "ththre.example.com"]).alias("problem"))


def pr31_urls(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^http:", "https:")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.url_problem(url, ["thther.example.org", "m.ththth.example.net", "ththre.example.com"]).alias("problem"))


def pr33_timestamps(spark, d):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(raw, F.lit("x"))).when(F.col("o_orderkey") % 3 == 1, F.regexp_replace(raw, "-(\\d\\d)T", "-45T")).otherwise(raw)
    return table(spark, d, "orders").groupBy(text.utc_or_null(raw).isNotNull().alias("valid"), (F.col("o_orderkey") % 3).alias("kind")).agg(F.count("*").alias("n"))


def pr35_model_keys(spark, d):
    return table(spark, d, "part").select(text.model_key(F.concat_ws("-", "p_brand", "p_type")).alias("model_key")).groupBy("model_key").agg(F.count("*").alias("n"))


def pr36_source_splits(spark, d):
    path = F.concat_ws("/", F.element_at(F.array(F.lit("Train"), F.lit("valid"), F.lit("x"), F.lit("testing")), (F.col("doc_id") % 4 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, "VAL"), "lang")
    split = text.source_split(path)
    return _docs(spark, d).select("doc_id", split.alias("split"), text.output_split(split, F.when(F.col("doc_id") % 2 == 0, "bootstrap_train_only")).alias("output_split"))


def pr40_redaction(spark, d):
    raw = F.concat(F.lit("see C:\\Users\\"), F.col("source"), F.lit("\\a.txt and /home/"), F.col("lang"), F.lit("/b c:\\data\\x /opt/y and/or z"))
    found = _docs(spark, d).select("doc_id", text.redacted(raw).alias("redacted"), text.has_local_path(raw).alias("private"))
    return found.withColumn("still_private", text.has_local_path(F.col("redacted")))


def pr46_canonical_text(spark, d):
    raw = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\x1b[0m"))
    return _docs(spark, d).select("doc_id", identity.sha256_text(text.without_ansi(text.canonical_text(raw))).alias("sha256"))


def wn12_first_seen(spark, d):
    return compare.first_seen(_docs(spark, d).select(F.md5(F.encode("text", "UTF-8")).alias("md5"), "doc_id", "source"), "md5", "doc_id")


def wn3_ids(spark, d):
    return canonical.coco_ids(_docs(spark, d).select("lang", "doc_id"), "lang", "doc_id")


def sk5_label_files(spark, d):
    line = g.yolo_line(F.col("id") % 6, g.box("x", "y", "w", "h"), F.lit(64), F.lit(64))
    return canonical.label_files(_boxes(spark, d).withColumn("line", line), "image_id", "line", "id")


def cn1_coco_records(spark, d):
    images, annotations, categories = _coco(spark, d)
    return canonical.records_of_coco(images, annotations, categories)


def jn3_unknown_references(spark, d):
    return canonical.unknown_references(*_coco(spark, d))


def _coco(spark, d):
    b = _boxes(spark, d)
    images = b.select(F.col("image_id").alias("id")).where("id % 9 <> 0").distinct().withColumn("file_name", F.concat(F.lit("a/b/"), F.col("id").cast("string"), F.lit(".png")))
    annotations = b.select("id", "image_id", (F.col("id") % 7).alias("category_id"), F.array(*[F.col(c) + 0.00049 for c in ("x", "y", "w", "h")]).alias("bbox"))
    categories = spark.range(6).select("id", F.concat(F.lit("class_"), F.col("id").cast("string")).alias("name"))
    return images, annotations, categories


def cn6_equivalence(spark, d):
    """The same boxes by way of both formats, but for every hundredth."""
    images, annotations, categories = _coco(spark, d)
    from_coco = canonical.records_of_coco(images, annotations.withColumn("bbox", F.transform("bbox", lambda x: x - 0.00049)), categories)
    line = g.yolo_line(F.col("category_id"), g.box(*[F.get("bbox", i) - 0.00049 for i in range(4)]), F.lit(64), F.lit(64))
    own = annotations.where("category_id < 6 and id % 100 <> 1").join(images.select(F.col("id").alias("image_id")), "image_id").withColumn("line", line)
    labels = canonical.label_files(own, "image_id", "line", "id").select(F.concat("image_id", F.lit(".png")).alias("image_key"), "text")
    sizes = images.select(canonical.image_key(F.col("file_name")).alias("image_key"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    from_yolo = canonical.records_of_yolo(sizes, labels, categories.select(F.col("id").cast("int").alias("class_id"), F.col("name").alias("class_name")))
    return canonical.equivalence(from_coco, from_yolo)


def cn6_payload_hash(spark, d):
    return canonical.payload_hash(canonical.records_of_coco(*_coco(spark, d)))


def jn14_member_resolution(spark, d):
    docs = _docs(spark, d)
    members = docs.select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 50).cast("string")).alias("member")).distinct()
    references = docs.select(F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, F.col("lang")), (F.col("doc_id") % 60).cast("string")).alias("reference"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("base")).distinct()
    return review.resolved_members(references, members)


def cn21_funnel(spark, d):
    p = table(spark, d, "pages")
    reasons = [F.when(F.length("html") < 2000, "too_short"), F.when(~F.col("url").contains("example.com"), "host"), F.when(F.col("page_id") % 10 == 3, "listed")]
    return review.funnel(p.select("page_id", "url", "html"), reasons).select("page_id", "reason")


def ag21_reject_reasons(spark, d):
    return review.reason_counts(cn21_funnel(spark, d))


def ag8_ingest_counts(spark, d):
    return _boxes(spark, d).groupBy("category").agg(F.count("*").alias("instances"), F.count_distinct("image_id").alias("images"))


_S = "'_'"
_SQL_GROUPS = "grp AS (SELECT DISTINCT lang AS model, lang || '_' || source AS group_id FROM documents)"
_SQL_RANKS = f"""{_SQL_GROUPS},
ranked AS (SELECT model, group_id, row_number() OVER (PARTITION BY model ORDER BY sha256('{splits.GROUP_POLICY}' || chr(0) || '42' || chr(0) || model || chr(0) || group_id), group_id) AS rank FROM grp)"""


def _sql_allocation(n: str, ratios: dict[str, float]) -> str:
    """CTEs al1 to al4 over al0 (k, n): floors, remainders, and repairs of empty splits."""
    r = [ratios[s] for s in ("train", "val", "test")]
    floors = ", ".join(f"CAST(floor(n * CAST({x} AS DOUBLE)) AS BIGINT) AS f{i}, n * CAST({x} AS DOUBLE) - floor(n * CAST({x} AS DOUBLE)) AS e{i}" for i, x in enumerate(r))
    more = []
    for i in range(3):
        before = " + ".join(f"CAST(e{j} > e{i} OR (e{j} = e{i} AND {j} < {i}) AS INTEGER)" for j in range(3) if j != i)
        more.append(f"f{i} + CAST(({before}) < n - f0 - f1 - f2 AS INTEGER) AS c{i}")
    out = f"al1 AS (SELECT k, n, {floors} FROM al0), al2 AS (SELECT k, n, {', '.join(more)} FROM al1)"
    for step, empty in enumerate(range(3)):
        donor = "CASE WHEN c0 >= greatest(c1, c2) THEN 0 WHEN c1 >= greatest(c0, c2) THEN 1 ELSE 2 END"
        cols = ", ".join(f"c{i} + CASE WHEN c{empty} = 0 AND {i} = {empty} THEN 1 WHEN c{empty} = 0 AND {donor} = {i} THEN -1 ELSE 0 END AS c{i}" for i in range(3))
        out += f", al{step + 3} AS (SELECT k, n, {cols} FROM al{step + 2})"
    return out


_SQL_SPLIT = f"""{_SQL_RANKS}, al0 AS (SELECT model AS k, count(*) AS n FROM grp GROUP BY 1), {_sql_allocation("n", splits.RATIOS)},
assigned AS (SELECT model, group_id, rank, CASE WHEN rank <= c0 THEN 'train' WHEN rank <= c0 + c1 THEN 'val' ELSE 'test' END AS split FROM ranked JOIN al5 ON k = model)"""
_SQL_EDGES = f"""r AS (SELECT lang || {_S} || source AS g, text FROM documents), f AS (SELECT text, min(g) AS b FROM r GROUP BY 1),
e AS (SELECT DISTINCT g AS a, b FROM r JOIN f USING (text)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
_SQL_REACH = f"WITH RECURSIVE {_SQL_EDGES}, reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b), roots AS (SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a)"
_IOU_XYXY = "greatest(0, least(x + w / 2, x + w) - greatest(x - w / 2, x)) * greatest(0, least(y + h / 2, y + h) - greatest(y - h / 2, y))"
_DEC = lambda c, total: f"CAST(round_even(CAST({c} AS DECIMAL(28,12)), 3) AS DECIMAL(20,3))::VARCHAR"
_SQL_COCO = f"""{SQL_BOXES}, im AS (SELECT DISTINCT image_id AS id FROM b WHERE image_id % 9 <> 0),
rec AS (SELECT image_id || '.png' AS image_key, 'class_' || (b.id % 7) AS class_name, {", ".join(f"{_DEC(f'({c} + 0.00049::DOUBLE)', 0)} AS {c}" for c in ("x", "y", "w", "h"))} FROM b JOIN im ON im.id = b.image_id WHERE b.id % 7 < 6)"""

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[:2] in ("ag", "hs", "pr", "jn", "wn", "gr", "sc", "st", "ev", "sk", "cn", "rc") and k[2].isdigit()}

SQL = {
    "pr31_url_rules": """WITH u AS (SELECT page_id, length(html) AS n, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages)
SELECT page_id, 'url:' || CASE WHEN n % 13 = 0 THEN 'missing_url' WHEN n % 11 = 0 THEN 'https_required' WHEN n % 7 = 0 THEN 'credentials_forbidden' WHEN n % 6 IN (3, 5) THEN 'invalid_port' WHEN n % 6 = 2 THEN 'port_not_allowed:8443'
 WHEN lower(host) NOT IN ('thther.example.org', 'm.ththth.example.net', 'ththre.example.com') THEN 'host_not_allowed:' || coalesce(nullif(lower(host), ''), 'missing') WHEN n % 5 = 0 THEN 'fragment_forbidden' WHEN n % 5 = 1 THEN 'invalid_path' END AS problem FROM u""",
    "ev11_letterbox": """WITH p AS (SELECT p_partkey, p_size * 40 + 300 AS w, p_partkey % 900 + 300 AS h FROM part), s AS (SELECT *, least(640 / h::DOUBLE, 640 / w::DOUBLE) AS scale FROM p),
r AS (SELECT *, greatest(1, least(640, CAST(round_even(w * scale, 0) AS INTEGER))) AS rw, greatest(1, least(640, CAST(round_even(h * scale, 0) AS INTEGER))) AS rh FROM s)
SELECT p_partkey, scale, rw::DOUBLE AS resized_width, rh::DOUBLE AS resized_height, round_even((640 - rw) / 2 - 0.1::DOUBLE, 0) AS pad_left, round_even((640 - rh) / 2 - 0.1::DOUBLE, 0) AS pad_top,
 greatest(1, least(640, floor(w * scale)))::DOUBLE AS plain_width, greatest(1, least(640, floor(h * scale)))::DOUBLE AS plain_height FROM r""",
    "ag1_duplicate_groups": """SELECT sha256(text) AS value, count(*) AS n, count(DISTINCT lang) > 1 AS cross_class_conflict,
 array_to_string(list_sort(list_distinct(list(lang))), '|') AS classes, array_to_string(list_sort(list(CAST(doc_id AS VARCHAR))), '|') AS paths
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "hs1_content_hash": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "hs10_newline_variants": r"SELECT doc_id, sha256(text) AS raw, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS lf, sha256(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10), chr(13) || chr(10))) AS crlf FROM documents",
    "hs7_assignment_hash": f"WITH {_SQL_SPLIT} SELECT model, sha256(array_to_string(list_sort(list(group_id || ':' || split)), chr(10))) AS assignment_sha256 FROM assigned GROUP BY model",
    "pr1_path_labels": """SELECT doc_id, CASE WHEN lang IN ('de', 'en') THEN lang WHEN source = 'src3' THEN source ELSE 'UNASSIGNED' END AS class_name, source AS source_name, 'UNASSIGNED' AS split FROM documents""",
    "pr4_quality_flags": """WITH r AS (SELECT doc_id, n_chars % 2000 AS w, doc_id * 37 % 1500 AS h, CASE WHEN lang = 'de' THEN 'UNASSIGNED' ELSE lang END AS c FROM documents)
SELECT doc_id, concat_ws('|', CASE WHEN w < 640 THEN 'LOW_WIDTH' END, CASE WHEN h < 480 THEN 'LOW_HEIGHT' END,
 CASE WHEN w > 0 AND h > 0 AND greatest(w / h, h / w) > 4 THEN 'EXTREME_ASPECT_RATIO' WHEN (w = 0) <> (h = 0) AND FALSE THEN '' END, CASE WHEN c = 'UNASSIGNED' THEN 'UNASSIGNED_CLASS' END) AS quality_flags FROM r""",
    "jn1_hamming_pairs": f"WITH {_SQL_PAIRS} SELECT * FROM pairs",
    "wn8_capped_pairs": f"WITH {_SQL_PAIRS}, f AS (SELECT * FROM pairs ORDER BY left_id, right_id LIMIT 25) SELECT *, (SELECT count(*) FROM f) >= 25 AS truncated FROM f",
    "ag3_pairs_by_split": f"""WITH {_SQL_PAIRS}, s AS (SELECT id, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM h)
SELECT least(a.split, b.split) || '__' || greatest(a.split, b.split) AS splits, count(*) AS n FROM pairs JOIN s a ON a.id = left_id JOIN s b ON b.id = right_id GROUP BY 1""",
    "ag2_audit_summary": """SELECT source, count(*) AS files, count(DISTINCT sha256(text)) AS distinct_files, count(*) FILTER (n_chars < 200) AS short_files,
 CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (lang IS NULL) AS unassigned FROM documents GROUP BY 1""",
    "wn2_hash_order": f"WITH {_SQL_RANKS} SELECT * FROM ranked",
    "gr2_allocation": f"""WITH al0 AS (SELECT source || ',' || lang AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3), {_sql_allocation("n", {"train": 0.7, "val": 0.2, "test": 0.1})}
SELECT split_part(k, ',', 1) AS source, split_part(k, ',', 2) AS lang, n, c0 AS train, c1 AS val, c2 AS test FROM al5""",
    "gr3_group_split": f"WITH {_SQL_SPLIT} SELECT * FROM assigned",
    "sc17_capped_walk": """WITH e AS (SELECT p_brand AS parent, p_partkey * 5 AS pos, 's' || p_size AS child, FALSE AS f FROM part UNION ALL SELECT 's' || p_size, p_partkey * 5 + 1, p_type, FALSE FROM part UNION ALL SELECT p_type, p_partkey * 5 + 2, p_brand, FALSE FROM part
 UNION ALL SELECT 's' || p_size, p_partkey * 5 + 3, p_partkey || '.png', TRUE FROM part UNION ALL SELECT p_type, p_partkey * 5 + 4, p_partkey || '.png', TRUE FROM part),
c0 AS (SELECT 'Brand#1' AS node, 1 AS ord), c1 AS (SELECT child AS node, 1 + row_number() OVER (ORDER BY min(pos)) AS ord FROM e WHERE parent = 'Brand#1' AND NOT f AND child <> 'Brand#1' GROUP BY 1),
b2 AS (SELECT child AS node, min(row(ord, pos)) AS spot FROM e JOIN c1 ON parent = node WHERE NOT f AND child <> 'Brand#1' AND child NOT IN (SELECT node FROM c1) GROUP BY 1),
c2 AS (SELECT node, (SELECT count(*) + 1 FROM c1) + row_number() OVER (ORDER BY spot) AS ord FROM b2), c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2),
m AS (SELECT child AS file, min(row(ord, pos)) AS spot FROM e JOIN c ON parent = node WHERE f GROUP BY 1)
SELECT file, place FROM (SELECT file, row_number() OVER (ORDER BY spot) AS place FROM m) WHERE place <= 700""",
    "rc13_tree_differences": """SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 70 = 6 THEN 'missing' WHEN doc_id % 80 = 9 THEN 'unexpected' ELSE 'changed' END AS problem FROM documents
WHERE doc_id % 70 = 6 AND doc_id % 80 <> 9 OR doc_id % 80 = 9 AND doc_id % 70 <> 6 OR doc_id % 90 = 1 AND doc_id % 70 <> 6 AND doc_id % 80 <> 9""",
    "rc10_tree": "SELECT '' AS path, 0 AS depth, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents UNION ALL SELECT source, 1, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY 1 UNION ALL SELECT source || '/' || lang, 2, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY 1",
    "gr4_split_audit": f"""WITH al0 AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1), {_sql_allocation("n", splits.RATIOS)}
SELECT k AS model, CAST(c0 AS BIGINT) AS train, CAST(c1 AS BIGINT) AS val, CAST(c2 AS BIGINT) AS test, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS spread FROM al5""",
    "ag6_mixed_groups": "SELECT source AS group_id, count(DISTINCT lang) AS n_models FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1",
    "st3_split_overlap": """WITH s AS (SELECT DISTINCT text, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT a.split AS left_split, b.split AS right_split, count(*) AS n FROM s a JOIN s b ON a.text = b.text AND a.split < b.split GROUP BY 1, 2""",
    "ag4_split_overlaps": f"""WITH {_SQL_SPLIT}, r AS (SELECT DISTINCT model, split, group_id, md5(text) AS t FROM documents JOIN assigned ON group_id = lang || '_' || source), s AS (SELECT DISTINCT model, split FROM r),
g AS (SELECT a.model, a.split AS l, b.split AS r, count(*) AS n FROM (SELECT DISTINCT model, split, group_id FROM r) a JOIN (SELECT DISTINCT model, split, group_id FROM r) b ON a.model = b.model AND a.group_id = b.group_id AND a.split < b.split GROUP BY 1, 2, 3),
t AS (SELECT a.model, a.split AS l, b.split AS r, count(*) AS n FROM (SELECT DISTINCT model, split, t FROM r) a JOIN (SELECT DISTINCT model, split, t FROM r) b ON a.model = b.model AND a.t = b.t AND a.split < b.split GROUP BY 1, 2, 3)
SELECT a.model, a.split AS "left", b.split AS "right", coalesce(g.n, 0) AS shared_group_id, coalesce(t.n, 0) AS shared_text FROM s a JOIN s b ON a.model = b.model AND a.split < b.split
LEFT JOIN g ON g.model = a.model AND g.l = a.split AND g.r = b.split LEFT JOIN t ON t.model = a.model AND t.l = a.split AND t.r = b.split""",
    "ag4_split_summary": f"""WITH {_SQL_SPLIT} SELECT model, split, count(*) AS images, count(DISTINCT group_id) AS groups, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents JOIN assigned ON group_id = lang || '_' || source GROUP BY 1, 2""",
    "gr1_components": f"""{_SQL_REACH}, ids AS (SELECT root, 'phashcc_' || substr(sha256(array_to_string(list_sort(list(node)), chr(10))), 1, 16) AS component_id FROM roots GROUP BY 1)
SELECT node, component_id FROM roots JOIN ids USING (root)""",
    "ag5_component_audit": f"""{_SQL_REACH}, s AS (SELECT lang || '_' || source AS node, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT root, count(*) AS groups, CAST(sum(n) AS BIGINT) AS images, count(DISTINCT lang) AS models FROM roots JOIN s USING (node) GROUP BY 1""",
    "sc17_category_walk": """WITH RECURSIVE e AS (SELECT p_brand AS parent, 's' || p_size AS child FROM part UNION SELECT 's' || p_size, p_type FROM part UNION SELECT p_type, p_brand FROM part),
w(node, depth) AS (SELECT min(p_brand), 0 FROM part UNION SELECT child, depth + 1 FROM w JOIN e ON parent = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""",
    "jn8_missing_unexpected": """WITH x AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, 'missing' AS problem FROM x WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM x)""",
    "jn10_protected_overlap": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT doc_id, count(*) AS protected_lines FROM l WHERE line IN (SELECT line FROM p) GROUP BY 1""",
    "st1_multiset_diff": """WITH n AS (SELECT lang, source, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS net FROM documents GROUP BY 1, 2)
SELECT CASE WHEN net > 0 THEN 'left' ELSE 'right' END AS side, lang, source, CAST(abs(net) AS BIGINT) AS n FROM n WHERE net <> 0""",
    "st6_cross_split_sha": "SELECT sha256(text) AS sha256, count(DISTINCT doc_id % 3) AS n_groups FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1",
    "st7_repeated_texts": "SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "st5_evidence_union": "SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages",
    "pr5_yolo_lines": f"""WITH {SQL_BOXES} SELECT id, CASE WHEN (x + w / 2) / 42 <= 1 AND (y + h / 2) / 64 <= 1 THEN
 format('{{}} {{:.8f}} {{:.8f}} {{:.8f}} {{:.8f}}', id % 6, (x + w / 2) / 42, (y + h / 2) / 64, w / 42, h / 64) END AS line FROM b""",
    "pr7_valid_boxes": f"""WITH {SQL_BOXES} SELECT id, x - 1 >= -1e-6::DOUBLE AND y - 0.0000005::DOUBLE >= -1e-6::DOUBLE AND x - 1 + w <= 40 + 1e-6::DOUBLE AND y - 0.0000005::DOUBLE + h <= 41 + 1e-6::DOUBLE AS valid,
 greatest(0.0::DOUBLE, x - 1) AS x, greatest(0.0::DOUBLE, y - 0.0000005::DOUBLE) AS y, w, h FROM b""",
    "pr8_canonical_yolo": f"""WITH {SQL_BOXES}, q AS (SELECT id, CAST((x + w / 2) / 64 AS DECIMAL(14,10)) AS cx, CAST((y + h / 2) / 64 AS DECIMAL(14,10)) AS cy, CAST(w / 64 AS DECIMAL(14,10)) AS cw, CAST(h / 64 AS DECIMAL(14,10)) AS ch FROM b)
SELECT id, {_DEC("(cx - cw / 2) * 640", 640)} AS x, {_DEC("(cy - ch / 2) * 480", 480)} AS y, {_DEC("cw * 640", 640)} AS w, {_DEC("ch * 480", 480)} AS h FROM q""",
    "pr11_half_even": """SELECT v, CAST(CAST(round_even(v, 3) AS DECIMAL(20,3)) AS VARCHAR) AS q FROM (SELECT DISTINCT CAST(l_quantity * l_discount / 8 AS DECIMAL(20,8)) AS v FROM lineitem)""",
    "pr15_box_forms": f"""WITH {SQL_BOXES}, i AS (SELECT *, {_IOU_XYXY} AS common FROM b)
SELECT id, x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2, (x + w / 2) - (x - w / 2) AS w, (y + h / 2) - (y - h / 2) AS h, common / (2 * w * h - common) AS iou,
 least(greatest((x - w / 2 - 2) / 0.5, 0), 50) AS r_x1, least(greatest((y - h / 2 - 3) / 0.5, 0), 60) AS r_y1, least(greatest((x + w / 2 - 2) / 0.5, 0), 50) AS r_x2, least(greatest((y + h / 2 - 3) / 0.5, 0), 60) AS r_y2 FROM i""",
    "pr18_tiles": """WITH s AS (SELECT p_partkey, CAST(p_size * 40 + 300 AS INTEGER) AS width, CAST(p_partkey % 900 + 300 AS INTEGER) AS height FROM part),
t AS (SELECT *, CASE WHEN width <= 640 THEN [0] ELSE list_distinct(list_concat(range(0, width - 639, 512), [width - 640])) END AS xs, CASE WHEN height <= 640 THEN [0] ELSE list_distinct(list_concat(range(0, height - 639, 512), [height - 640])) END AS ys FROM s)
SELECT p_partkey, CAST(l AS INTEGER) AS "left", CAST(t AS INTEGER) AS top, CAST(least(l + 640, width) AS INTEGER) AS "right", CAST(least(t + 640, height) AS INTEGER) AS bottom FROM (SELECT p_partkey, width, height, l, unnest(ys) AS t FROM (SELECT *, unnest(xs) AS l FROM t))""",
    "pr21_size_classes": "SELECT CASE WHEN p_size * p_size * 4 < 1024 THEN 'small' WHEN p_size * p_size * 4 < 9216 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY 1",
    "pr24_stripped_html": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages",
    "pr25_stems": "SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 96) AS stem FROM pages",
    "pr26_safe_paths": r"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '../' || source WHEN 1 THEN '/' || source WHEN 2 THEN 'C:\' || source ELSE source || '/' || lang END AS p FROM documents)
SELECT doc_id, doc_id % 5 > 2 AS safe, sha256(p) AS sha256 FROM p""",
    "pr28_licenses": """WITH r AS (SELECT page_id, page_id % 5 AS k, url, page_id % 7 > 0 AS terms, page_id % 3 > 0 AS artist FROM pages)
SELECT page_id, k < 2 AS allowed, CASE WHEN NOT terms THEN 'missing_license_metadata:usage_terms' WHEN NOT artist THEN 'missing_license_metadata:artist_or_credit' WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'invalid_license_url'
 WHEN k >= 2 THEN 'license_not_allowed:CC ' || ['', '', 'BY-NC 4.0', 'BY_ND', '0'][k + 1] END AS reason FROM r""",
    "pr30_keywords": "SELECT page_id, (contains(lower(url), 'example.com') OR contains(lower(url), 'example.net')) AND NOT contains(lower(url), 'page=2') AS allowed FROM pages",
    "pr33_timestamps": "SELECT o_orderkey % 3 = 2 AS valid, o_orderkey % 3 AS kind, count(*) AS n FROM orders GROUP BY 1, 2",
    "pr35_model_keys": "SELECT regexp_replace(lower(p_brand || '-' || p_type), '[^a-z0-9]', '', 'g') AS model_key, count(*) AS n FROM part GROUP BY 1",
    "pr36_source_splits": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE ['train', 'val', 'train', 'test'][doc_id % 4 + 1] END AS split FROM documents)
SELECT doc_id, split, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE split END AS output_split FROM r""",
    "pr40_redaction": r"SELECT doc_id, 'see <USER_HOME>\a.txt and <USER_HOME>/b <ABSOLUTE_PATH> <ABSOLUTE_PATH> and/or z' AS redacted, TRUE AS private, FALSE AS still_private FROM documents",
    "pr46_canonical_text": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "wn12_first_seen": "SELECT md5(text) AS md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "wn3_ids": "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS id FROM documents",
    "sk5_label_files": f"""WITH {SQL_BOXES}, l AS (SELECT image_id, id, format('{{}} {{:.8f}} {{:.8f}} {{:.8f}} {{:.8f}}', id % 6, (x + w / 2) / 64, (y + h / 2) / 64, w / 64, h / 64) AS line FROM b)
SELECT image_id, string_agg(line, chr(10) ORDER BY id) || chr(10) AS text FROM l GROUP BY 1""",
    "cn1_coco_records": f"WITH {_SQL_COCO} SELECT * FROM rec",
    "jn3_unknown_references": f"""WITH {SQL_BOXES} SELECT id, 'unknown_image' AS problem FROM b WHERE image_id % 9 = 0 UNION ALL SELECT id, 'unknown_category' FROM b WHERE id % 7 = 6""",
    "cn6_equivalence": f"""WITH {SQL_BOXES} SELECT CAST(count(*) FILTER (id % 100 = 1) AS BIGINT) AS left_only, CAST(0 AS BIGINT) AS right_only, count(*) FILTER (id % 100 = 1) = 0 AS equal FROM b WHERE image_id % 9 <> 0 AND id % 7 < 6""",
    "jn14_member_resolution": """WITH m AS (SELECT DISTINCT source || '/' || lang || '/' || (doc_id % 50) AS member FROM documents),
r AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN lang || '/' ELSE '' END || (doc_id % 60) AS reference, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS base FROM documents),
n AS (SELECT split_part(member, '/', 3) AS name, count(*) AS n, min(member) AS m FROM m GROUP BY 1)
SELECT reference, coalesce(a.member, p.member, CASE WHEN n = 1 THEN n.m END) AS member,
 CASE WHEN coalesce(a.member, p.member, CASE WHEN n = 1 THEN n.m END) IS NOT NULL THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM r LEFT JOIN m a ON a.member = CASE WHEN base <> '' THEN base || '/' ELSE '' END || reference LEFT JOIN m p ON p.member = reference LEFT JOIN n ON name = regexp_extract(reference, '[^/]*$')""",
    "cn21_funnel": "SELECT page_id, CASE WHEN length(html) < 2000 THEN 'too_short' WHEN NOT contains(url, 'example.com') THEN 'host' WHEN page_id % 10 = 3 THEN 'listed' END AS reason FROM pages",
    "ag21_reject_reasons": "SELECT CASE WHEN length(html) < 2000 THEN 'too_short' WHEN NOT contains(url, 'example.com') THEN 'host' WHEN page_id % 10 = 3 THEN 'listed' END AS reason, count(*) AS n FROM pages GROUP BY 1 HAVING reason IS NOT NULL",
    "ag8_ingest_counts": f"WITH {SQL_BOXES} SELECT category, count(*) AS instances, count(DISTINCT image_id) AS images FROM b GROUP BY 1",
}
