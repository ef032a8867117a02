"""Annotations in one form, whatever format they come from, and whether two datasets are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.geometry import box, canonical_from_coco, canonical_from_yolo
from sievemark.operators.compare import multiset_difference
from sievemark.session import written
from sievemark.sources import scans

RECORD = ["image_key", "class_name", "x", "y", "w", "h"]


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("image_key", "class_name", *[F.get("bbox", i).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])


def image_key(path):  # noqa: ANN001, ANN201
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def records_of_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """image_key, class_name, x, y, w, h (text, three decimals). images: id, file_name; annotations: image_id, category_id,
    bbox (array); categories: id, name. An annotation of an unknown image or category is left out; unknown_references
    lists it."""
    named = annotations.join(images.select(F.col("id").alias("image_id"), image_key(F.col("file_name")).alias("image_key")), "image_id")
    named = named.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("class_name")), "category_id")
    values = [F.get("bbox", i) for i in range(4)]
    return _records(named.select("image_key", "class_name", canonical_from_coco(box(*values)).alias("bbox")))


def unknown_references(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """id, problem of annotations whose image or category doesn't exist."""
    no_image = annotations.join(images, annotations["image_id"] == images["id"], "left_anti").select("id", F.lit("unknown_image").alias("problem"))
    no_category = annotations.join(categories, annotations["category_id"] == categories["id"], "left_anti").select("id", F.lit("unknown_category").alias("problem"))
    return no_image.unionByName(no_category)


def records_of_yolo(images: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """The same from images: image_key, width, height; labels: image_key, text (lines of class cx cy w h); names: class_id,
    class_name."""
    lines = labels.select("image_key", F.explode(F.split("text", r"\r?\n")).alias("line")).where("trim(line) <> ''")
    parts = F.split(F.trim("line"), r"\s+")
    typed = lines.select("image_key", F.get(parts, 0).try_cast("int").alias("class_id"), *[F.get(parts, i + 1).try_cast("decimal(14,10)").alias(f"v{i}") for i in range(4)])
    rows = typed.join(images.select("image_key", "width", "height"), "image_key").join(names, "class_id")
    return _records(rows.select("image_key", "class_name", canonical_from_yolo(box(*[f"v{i}" for i in range(4)]), F.col("width"), F.col("height")).alias("bbox")))


def records_of_yolo_archives(archives: DataFrame, images: DataFrame, names: DataFrame) -> DataFrame:
    """The same from ZIP archives (path, content) of label files; an image's key is its label's name without the suffix.
    Archives with problems (scans.archive_problems) give nothing."""
    labels = scans.texts_of(archives, ".txt").select(F.regexp_replace(image_key(F.col("member")), r"\.txt$", "").alias("image_key"), "text")
    return records_of_yolo(images, labels, names)


def payload_hash(records: DataFrame) -> DataFrame:
    """One row: records, sha256 over the sorted hashes of all records; equal for equal multisets in any order.

    Hashes are combined in two levels, by their first digits, so that no task holds more than its share."""
    line = F.sha2(F.to_json(F.struct(*RECORD)), 256).alias("h")
    parts = records.select(line).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), "\n"), 256).alias("sha256"))


def equivalence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: left_only, right_only (records one side has more of), equal."""
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    counts = multiset_difference(left.select(RECORD), right.select(RECORD)).agg(n("left").alias("left_only"), n("right").alias("right_only"))
    return counts.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def coco_ids(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with id: 1, 2, ... in each group by an order that must be unique. Rows are sorted in ranges; a row's number is its
    place in its range behind the counts of the group's ranges before, so that a large group is many tasks."""
    dealt = rows.repartitionByRange(group, order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__range", group).orderBy(order))), "ranges")
    sizes = dealt.groupBy(F.col("__range").alias("__r"), F.col(group).alias("__g")).agg(F.max("__place").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__r", "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = dealt.join(sizes, (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.select(*rows.columns, (F.col("__place") + F.col("__before")).cast("long").alias("id"))


def label_files(rows: DataFrame, image: str, line: str, order: str) -> DataFrame:
    """image, text: the lines of each image's label file, by an order, with an end of line after each."""
    sorted_lines = F.array_sort(F.collect_list(F.struct(order, line)))
    return rows.groupBy(image).agg(F.concat(F.array_join(F.transform(sorted_lines, lambda x: x[line]), "\n"), F.lit("\n")).alias("text"))
