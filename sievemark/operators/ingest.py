"""Archives of images with annotation documents: every broken rule a row, and canonical tables of what breaks none."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.operators.running import RANGE, in_ranges, running
from sievemark.session import written

#: How far a box may reach out of its image.
TOLERANCE = 1e-6


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant"))


def _whole(name: str) -> Column:
    """The field, if it is written as a whole number: texts, truths and decimals aren't."""
    return F.when(_kind(name) == "BIGINT", _field(name, "bigint"))


def _text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", _field(name, "string"))


def parsed(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of documents (archive, member, text), with their places in them. A field of another
    kind than asked for is null; documents that aren't such objects have no rows (see document_problems)."""
    read = F.from_json("text", "struct<images:array<variant>,annotations:array<variant>,categories:array<variant>>")
    docs = written(documents.select("archive", F.col("member").alias("document"), read.alias("d")), "documents")
    each = lambda kind: docs.select("archive", "document", F.posexplode(f"d.{kind}").alias("at", "v"))
    own = ["archive", "document", "at"]
    images = each("images").select(*own, _whole("id").alias("id"), _text("file_name").alias("file_name"), _field("width", "bigint").alias("width"), _field("height", "bigint").alias("height"))
    box = F.try_variant_get("v", "$.bbox", "array<double>")
    crowd = F.coalesce(_field("iscrowd", "string"), F.lit("0"))
    annotations = each("annotations").select(*own, _whole("image_id").alias("image_id"), _whole("category_id").alias("category_id"), box.alias("bbox"), (~crowd.isin("0", "false")).alias("crowd"), F.coalesce(_field("id", "string"), (F.col("at") + 1).cast("string")).alias("source_id"))
    categories = each("categories").select(*own, _whole("id").alias("id"), _text("name").alias("name"))
    return images, annotations, categories


def document_problems(documents: DataFrame) -> DataFrame:
    """archive, document, at (null), problem: members that aren't objects with the three lists."""
    v = F.try_parse_json("text")
    there = [F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant")).startswith("ARRAY") for k in ("images", "annotations", "categories")]
    bad = ~F.coalesce(there[0] & there[1] & there[2], F.lit(False))
    return documents.where(bad).select("archive", F.col("member").alias("document"), F.lit(None).cast("int").alias("at"), F.lit("not_a_document").alias("problem"))


def _checked_box(width: Column, height: Column) -> Column:
    """The box with negative starts within the tolerance set to 0; null where it isn't in the image or has no size."""
    b = lambda i: F.get("bbox", F.lit(i))
    finite = F.forall("bbox", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size("bbox") == 4) & finite & (b(2) > 0) & (b(3) > 0) & (b(0) >= -TOLERANCE) & (b(1) >= -TOLERANCE) & (b(0) + b(2) <= width + TOLERANCE) & (b(1) + b(3) <= height + TOLERANCE)
    return F.when(good, F.array(F.greatest(b(0), F.lit(0.0)), F.greatest(b(1), F.lit(0.0)), b(2), b(3)))


def _members_of(images: DataFrame, members: DataFrame) -> DataFrame:
    """images with member and found (resolved, ambiguous or missing): beside the document, as written, or by a name that only
    one member of the archive has."""
    base = F.regexp_extract("document", "^(.*)/[^/]*$", 1)
    near = F.when(base != "", F.concat_ws("/", base, F.col("file_name"))).otherwise(F.col("file_name"))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    listed = members.select("archive", "member").distinct()
    beside, plain = (listed.select("archive", F.col("member").alias(c), F.col("member").alias(f"{c}_key")) for c in ("beside", "plain"))
    unique = listed.groupBy("archive", name("member").alias("name")).agg(F.count("*").alias("n"), F.min("member").alias("by_name"))
    rows = images.withColumn("beside_key", near).withColumn("plain_key", F.col("file_name")).withColumn("name", name("file_name"))
    rows = rows.join(beside, ["archive", "beside_key"], "left").join(plain, ["archive", "plain_key"], "left").join(unique, ["archive", "name"], "left")
    member = F.coalesce("beside", "plain", F.when(F.col("n") == 1, F.col("by_name")))
    status = F.when(member.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return rows.select(*images.columns, member.alias("member"), status.alias("found"))


def ingested(documents: DataFrame, probes: DataFrame, labels: Mapping[str, tuple[int, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Problems, images and annotations of archives' documents (archive, member, text).

    probes: archive, member, sha256, width, height, decode_ok of the members that may be images. labels: of each source label
    that is allowed, the class and its name. Problems are archive, document, at (the place in its list; null for a document),
    problem. Images and annotations are those that break no rule themselves and refer to none that does: numbered from 1 by
    archive, document and place, images named by their content, annotations of the class plus 1."""
    images, annotations, categories = parsed(documents)
    where = ["archive", "document", "at"]
    allowed = F.array(*map(F.lit, labels))
    repeated = lambda c: F.count(c).over(Window.partitionBy("archive", "document", c)) > 1

    cats = categories.withColumn("twice", repeated("id"))
    cat_bad = F.when(F.col("name").isNull() | (F.col("name") == ""), "category_name").when(~F.array_contains(allowed, F.col("name")), "label_not_allowed").when(F.col("id").isNull(), "category_id").when(F.col("twice"), "repeated_category_id")
    cats = written(cats.withColumn("problem", cat_bad), "categories")

    found = _members_of(images.withColumn("twice", repeated("id")), probes)
    found = found.join(probes.select("archive", "member", "sha256", F.col("width").alias("real_width"), F.col("height").alias("real_height"), "decode_ok"), ["archive", "member"], "left")
    copies = found.where("sha256 IS NOT NULL AND id IS NOT NULL AND NOT twice").groupBy("archive", "sha256").agg(F.count("*").alias("copies"))
    found = found.join(copies, ["archive", "sha256"], "left")
    image_bad = (
        F.when(F.col("id").isNull(), "image_id")
        .when(F.col("twice"), "repeated_image_id")
        .when(F.col("file_name").isNull(), "file_name")
        .when(F.col("found") != "resolved", F.concat(F.lit("member_"), F.col("found")))
        .when(~F.coalesce("decode_ok", F.lit(False)), "not_decoded")
        .when(~(F.col("width").eqNullSafe(F.col("real_width")) & F.col("height").eqNullSafe(F.col("real_height"))), "dimensions")
        .when(F.col("copies") > 1, "repeated_content")
    )
    found = written(found.withColumn("problem", image_bad), "images")

    known_images = found.where("id IS NOT NULL").groupBy("archive", "document", F.col("id").alias("image_id")).agg(F.max("real_width").alias("w"), F.max("real_height").alias("h"), F.max(F.col("problem").isNotNull()).alias("bad_image"))
    known_cats = cats.where("id IS NOT NULL").groupBy("archive", "document", F.col("id").alias("category_id")).agg(F.min("name").alias("name"), F.max(F.col("problem").isNotNull()).alias("bad_category"))
    notes = annotations.join(known_images, ["archive", "document", "image_id"], "left").join(known_cats, ["archive", "document", "category_id"], "left")
    notes = notes.withColumn("box", _checked_box(F.col("w"), F.col("h")))
    note_bad = F.when(F.col("bad_image").isNull(), "unknown_image").when(F.col("bad_category").isNull(), "unknown_category").when(F.col("crowd"), "crowd").when(F.col("w").isNotNull() & F.col("box").isNull(), "bbox")
    notes = written(notes.withColumn("problem", note_bad), "annotations")

    told = lambda rows: rows.where("problem IS NOT NULL").select(*where, "problem")
    problems = document_problems(documents).unionByName(told(cats)).unionByName(told(found)).unionByName(told(notes))

    suffix = F.lower(F.regexp_extract("member", r"(\.[^./]+)$", 1))
    good = found.where("problem IS NULL").select("archive", "document", "at", F.col("id").alias("source_image_id"), "member", "sha256", F.concat(F.substring("sha256", 1, 20), suffix).alias("file_name"), "width", "height")
    good = written(_numbered(good, where), "numbered")
    kept = notes.where("problem IS NULL AND NOT bad_image AND NOT bad_category").join(good.select("archive", "document", F.col("source_image_id").alias("image_id"), F.col("id").alias("own_image")), ["archive", "document", "image_id"])
    classes = F.create_map(*[x for k, (number, _) in labels.items() for x in (F.lit(k), F.lit(number))])
    kept = kept.select(*where, F.col("own_image").alias("image_id"), (classes[F.col("name")] + 1).alias("category_id"), F.col("box").alias("bbox"), (F.get("box", F.lit(2)) * F.get("box", F.lit(3))).alias("area"), "source_id")
    return problems, good, _numbered(kept, where)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with id, their place (from 1) in the order, by ranges (see running)."""
    by = [(c, True) for c in order]
    return running(in_ranges(rows, [], by), [], by, {"id": F.lit(1).cast("long")}).drop(RANGE)


def class_counts(annotations: DataFrame) -> DataFrame:
    """category_id, instances, images."""
    return annotations.groupBy("category_id").agg(F.count("*").alias("instances"), F.count_distinct("image_id").alias("images"))
