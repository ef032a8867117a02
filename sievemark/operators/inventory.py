"""Inventories of large trees of files, compared from the root down, so that only folders that differ are looked into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.session import written

_PART, _PARTS = 15, 4  # hex digits of a hash that are summed as one number, and how many such numbers


def _sums() -> list[Column]:
    """Sums of the parts of a file's hash: whole numbers, so that neither order nor dealing matters."""
    part = lambda i: F.conv(F.substring("h", 1 + _PART * i, _PART), 16, 10).cast("decimal(20,0)")
    return [F.sum(part(i)).cast("string") for i in range(_PARTS)]


def tree(files: DataFrame) -> DataFrame:
    """path, depth, is_file, digest, files, bytes of every file and every folder above one; the root's path is empty.

    files: path (parts joined by /), sha256, bytes; of a path that repeats, each row counts. A folder's digest is that of its
    files' paths and hashes, of any number and in any order: they are summed before anything is gathered, so neither the
    root nor a folder with most of the files is one task's work. It tells trees apart that differ by accident or by an edit;
    it isn't proof against files made to fit."""
    own = files.select("path", F.sha2(F.concat_ws("\0", "path", F.coalesce("sha256", F.lit(""))), 256).alias("h"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))
    parts = F.split("path", "/")
    above = own.select("h", "bytes", "path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "node"))
    whole = F.col("node") == F.col("path")
    sums = above.groupBy(F.col("node").alias("path"), "depth", whole.alias("is_file")).agg(F.concat_ws(":", F.count("*"), *_sums()).alias("s"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sums.select("path", "depth", "is_file", F.sha2("s", 256).alias("digest"), "files", "bytes")


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def differences(expected: DataFrame, actual: DataFrame, most_depth: int = 1000) -> DataFrame:
    """path, depth, is_file, problem (missing, unexpected or changed), expected, actual (digests) of every node that two trees
    don't share: folders and files. A level's nodes are compared only where the folder above differs, and no level below the
    last difference is read; rows of tree() may be stored by depth, so that a level is a part of its own."""
    out, front = None, None
    for depth in range(most_depth + 1):
        sides = []
        for side, name in ((expected, "expected"), (actual, "actual")):
            rows = side.where(F.col("depth") == depth).select("path", "is_file", F.col("digest").alias(name))
            if front is not None:
                rows = rows.withColumn("above", _parent(F.col("path"))).join(front.select(F.col("path").alias("above")), "above", "left_semi").drop("above")
            sides.append(rows)
        both = sides[0].join(sides[1], ["path", "is_file"], "full").where(~F.col("expected").eqNullSafe(F.col("actual")))
        problem = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("changed")
        found = written(both.select("path", F.lit(depth).alias("depth"), "is_file", problem.alias("problem"), "expected", "actual"), "level")
        out = found if out is None else out.unionByName(found)
        front = found.where(~F.col("is_file"))
        if front.isEmpty():
            break
    return out


def file_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem of the files in differences()."""
    return differences(expected, actual).where("is_file").select("path", "problem")
