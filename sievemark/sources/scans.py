"""Files as rows. Problems are rows or columns, not exceptions in the middle of a scan."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemark.functions.images import image_probe
from sievemark.functions.text import class_of_path, is_image, quality_flags, sniffed_mime, source_of_path, split_of_path
from sievemark.session import small_batches

# What an archive may hold.
MOST_MEMBERS = 20_000
MOST_MEMBER_BYTES = 512 << 20
MOST_TOTAL_BYTES = 32 << 30
MOST_RATIO = 250.0
#: Images that a Python worker is handed at a time; fewer where they are large.
IMAGES_HELD = 200


def image_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path, length, sha256, mime (and content) of all image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_image(F.col("path")))
    rows = files.withColumn("sha256", F.sha2("content", 256)).withColumn("mime", sniffed_mime(F.col("content")))
    return rows.select("path", "length", "sha256", "mime", *["content"] * content)


def probed_files(files: DataFrame, classes: list[str], default_class: str | None = None, least_width: int = 640, least_height: int = 480) -> DataFrame:
    """relative_path, class_name, source, split, bytes, sha256_file, sha256_pixels, phash64, format, mode, width, height,
    decode_ok, quality_flags, error of image files (relative_path, length, content).

    A file that can't be decoded whole is a row with its error. Pixels are decoded, and hashed upright, where the format is
    one of images.DECODED; of others headers are read, and the hashes stay null. A Python worker holds IMAGES_HELD files."""
    small_batches(files.sparkSession, IMAGES_HELD)
    rows = files.withColumns({"head": image_probe(F.col("content")), "class_name": class_of_path(F.col("relative_path"), classes, default_class)})
    good = F.col("head.error").isNull() & (F.col("head.width") > 0) & (F.col("head.height") > 0)
    flags = F.when(good, quality_flags(F.col("head.width"), F.col("head.height"), F.col("class_name"), least_width, least_height)).otherwise("DECODE_FAILED")
    return rows.select(
        "relative_path", "class_name", source_of_path(F.col("relative_path")).alias("source"), split_of_path(F.col("relative_path")).alias("split"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256_file"),
        "head.sha256_pixels", "head.phash64", "head.format", "head.mode", "head.width", "head.height", good.alias("decode_ok"), flags.alias("quality_flags"), F.when(~good, F.coalesce("head.error", F.lit("no pixels"))).alias("error"),
    )


def inspected_images(spark: SparkSession, folder: str, classes: list[str], default_class: str | None = None, least_width: int = 640, least_height: int = 480) -> DataFrame:
    """probed_files of all image files below a folder (Spark's scan leaves out files without a byte)."""
    root = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", F.lit("^[a-z]+:/+"), F.lit("/"))
    base = "/" + folder.split("://")[-1].strip("/") + "/"
    files = root.where(is_image(F.col("path"))).select(F.substring(path, F.lit(len(base) + 1), F.length("path")).alias("relative_path"), "length", "content")
    return probed_files(files, classes, default_class, least_width, least_height)


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, typed by a schema; a byte-order mark is no part of the first name, empty values are null."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields of every object, one to a line; blank lines and values that aren't objects are left out."""
    return spark.read.text(path).where(F.substring(F.trim("value"), 1, 1) == "{").select(F.from_json("value", schema).alias("r")).select("r.*")


def json_line_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), problem: lines that repeat a key of the object, aren't JSON (or repeat a key inside), or are no
    object."""
    rows = numbered_lines(spark, path).where("trim(value) <> ''")
    parsed = F.try_parse_json("value")
    keys = F.json_object_keys("value")
    why = (
        F.when(F.size(F.array_distinct(keys)) != F.size(keys), "repeated_key")  # the parser refuses it, too
        .when(parsed.isNull(), "not_json")
        .when(F.substring(F.trim("value"), 1, 1) != "{", "not_an_object")
    )
    return rows.select("file", "line", why.alias("problem")).where("problem is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line of text files, blank ones too; a file may be in any number of splits.

    A line is in the split in which it begins, and a split's lines follow one another in a task. So its number is its
    place in its split, and how many lines the file's splits before have: a count for each split is all that is shuffled."""
    base = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("at"))
    counts = base.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", (F.col("first") - before).alias("start"))
    return base.join(starts, ["file", "split"]).select("file", (F.col("at") - F.col("start") + 1).alias("line"), "value")


def archives(spark: SparkSession, path: str, most_held: int = 1 << 30) -> DataFrame:
    """path, content of archives; the content of one of over most_held bytes is null, and tasks open it by its path."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > most_held).select("path", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= most_held).select("path", "content").unionByName(large)


def _opened(path: str, content: bytes | None) -> zipfile.ZipFile:
    if content is not None:
        return zipfile.ZipFile(io.BytesIO(content))
    store, name = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(store.open_input_file(name))


def members_of(found: DataFrame) -> DataFrame:
    """archive, member, size, packed, encrypted, link of the files in ZIP archives (path, content), one task per archive;
    error (and no member) where one can't be read."""

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for x in _opened(name, content).infolist():
                        if not x.is_dir():
                            out.append((name, x.filename.replace("\\", "/"), x.file_size, x.compress_size, bool(x.flag_bits & 1), (x.external_attr >> 16) & 0o170000 == 0o120000, None))
                except zipfile.BadZipFile as e:
                    out.append((name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["archive", "member", "size", "packed", "encrypted", "link", "error"]).astype({"size": "Int64", "packed": "Int64", "encrypted": "boolean", "link": "boolean"})

    return found.select("path", "content").mapInPandas(listing, "archive string, member string, size long, packed long, encrypted boolean, link boolean, error string")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    return members_of(archives(spark, path))


def texts_of(found: DataFrame, suffix: str) -> DataFrame:
    """archive, member, text of members with that suffix (UTF-8), of the archives (path, content) without problems."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with _opened(name, content) as own:
                    for x in own.infolist():
                        if not x.is_dir() and x.filename.lower().endswith(suffix):
                            yield pd.DataFrame({"archive": [name], "member": [x.filename.replace("\\", "/")], "text": [own.read(x).decode()]})

    bad = archive_problems(members_of(found)).select(F.col("archive").alias("path")).distinct()
    return found.join(bad, "path", "left_anti").select("path", "content").mapInPandas(read, "archive string, member string, text string")


def member_contents(found: DataFrame, wanted: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """archive, member, content, error of the wanted members (archive, member, size: see members_of) of archives (path,
    content).

    Members are dealt to tasks of about task_bytes each, so that a large archive is many tasks' work, and none opens more of
    it than its own members. A member is inflated in steps, and given up where it has more bytes than a member may have, or
    than its packed ones allow, whatever its header says."""
    order = Window.partitionBy("archive").orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    dealt = wanted.select("archive", "member", "size").withColumn("task", F.floor(F.coalesce(F.sum("size").over(order), F.lit(0)) / task_bytes))
    work = dealt.groupBy("archive", "task").agg(F.sort_array(F.collect_list("member")).alias("members"))
    joined = work.join(found.select(F.col("path").alias("archive"), "content"), "archive")

    def inflated(own: zipfile.ZipFile, member: str) -> tuple[bytes | None, str | None]:
        info, out = own.getinfo(member), bytearray()
        most = min(MOST_MEMBER_BYTES, MOST_RATIO * info.compress_size)
        with own.open(info) as stream:
            while part := stream.read(1 << 20):
                out += part
                if len(out) > most:
                    return None, "too_many_bytes"
        return bytes(out), None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, members, content in zip(batch["archive"], batch["members"], batch["content"], strict=True):
                with _opened(name, content) as own:
                    names = {x.replace("\\", "/"): x for x in own.namelist()}
                    for member in members:
                        try:
                            data, error = inflated(own, names[member])
                        except (KeyError, zipfile.BadZipFile, EOFError, zlib.error, RuntimeError, NotImplementedError) as e:
                            data, error = None, type(e).__name__
                        yield pd.DataFrame({"archive": [name], "member": [member], "content": [data], "error": [error]})

    return joined.select("archive", "members", "content").mapInPandas(read, "archive string, member string, content binary, error string")


def archive_problems(members: DataFrame) -> DataFrame:
    """archive, member, problem: members that may not be unpacked, and archives with too many or too large ones."""
    bad = (
        F.when(F.col("error").isNotNull(), "unreadable")
        .when(F.col("encrypted"), "encrypted")
        .when(F.col("link"), "link")
        .when(F.col("size") > MOST_MEMBER_BYTES, "member_too_large")
        .when((F.col("size") > 0) & (F.col("packed") <= 0), "invalid_packed_size")
        .when(F.col("size") > MOST_RATIO * F.col("packed"), "ratio_too_high")
        .when(F.col("member").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), "unsafe_path")
    )
    single = members.select("archive", "member", bad.alias("problem")).where("problem is not null")
    sums = members.groupBy("archive").agg(F.count("member").alias("n"), F.sum("size").alias("bytes"))
    many = F.when(F.col("n") > MOST_MEMBERS, "too_many_members").when(F.col("bytes") > MOST_TOTAL_BYTES, "too_many_bytes")
    whole = sums.select("archive", F.lit(None).cast("string").alias("member"), many.alias("problem")).where("problem is not null")
    twice = members.groupBy("archive", "member").agg(F.count("*").alias("n")).where("n > 1").select("archive", "member", F.lit("repeated_member").alias("problem"))
    return single.unionByName(whole).unionByName(twice)


def scalar_epochs(scalars: DataFrame, names: dict[str, str], steps_per_epoch: int) -> DataFrame:
    """epoch and a column per name: means of the scalars (tag, step, value) of each epoch of so many steps, from 1."""
    own = scalars.where(F.col("tag").isin(list(names))).withColumn("epoch", F.floor(F.col("step") / steps_per_epoch) + 1)
    return own.groupBy("epoch").pivot("tag", list(names)).agg(F.avg("value")).select("epoch", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def from_epoch_one(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed, empty texts null, epochs counted from 1 also where they were counted from 0."""
    first = rows.agg(F.min(F.col("epoch").cast("int")).alias("least"))
    shifted = rows.join(F.broadcast(first)).withColumn("epoch", F.col("epoch").cast("int") + F.when(F.col("least") == 0, 1).otherwise(0))
    return shifted.select("epoch", *[F.nullif(F.col(f"`{k}`"), F.lit("")).cast("double").alias(v) for k, v in names.items()])


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write where nothing is yet, or where the same rows are already, in any order; AnalysisException otherwise."""
    try:
        df.write.mode("errorifexists").format(kind).save(path)
    except AnalysisException:
        there = df.sparkSession.read.schema(df.schema).format(kind).load(path)
        if not (df.exceptAll(there).isEmpty() and there.exceptAll(df).isEmpty()):
            raise


def write_ordered_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """CSV with a header and the columns in a fixed order, its files sorted one after the other."""
    df.select(columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("header", True).csv(path)
