import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sievemark.functions import images, png
from sievemark.plans import files
from sievemark.sources import scans


def test_image_files(spark, tmp_path):
    for name, data in (("raw/a.PNG", b"\x89PNG\r\n\x1a\n1"), ("raw/deep/b.jpg", b"\xff\xd8\xff2"), ("raw/c.txt", b"x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = scans.image_files(spark, str(tmp_path), content=False).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.mime, r.length) for r in rows) == [("a.PNG", "image/png", 9), ("b.jpg", "image/jpeg", 4)]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n[1]\n{"a": 2, "a": 3}\nnot json\n{"a": 4}\n')
    assert [r.a for r in scans.json_lines(spark, str(path), "a int").collect()] == [1, 3, 4]
    found = [(r.line, r.problem) for r in scans.json_line_problems(spark, str(path)).collect()]
    assert sorted(found) == [(3, "not_an_object"), (4, "repeated_key"), (5, "not_json")]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿Image,Width\na.png,5\nb.png,\n".encode())
    assert [tuple(r) for r in scans.csv_rows(spark, str(path), "Image string, Width int").collect()] == [("a.png", 5), ("b.png", None)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.json", json.dumps({"a": 1}))
        z.writestr("../up.txt", "x")
        z.writestr("bomb.txt", "0" * 2_000_000)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    members = scans.archive_members(spark, str(tmp_path))
    assert members.where("member is not null").count() == 3
    assert {(r.archive.rsplit("/", 1)[1], r.member, r.problem) for r in scans.archive_problems(members).collect()} == {("a.zip", "../up.txt", "unsafe_path"), ("a.zip", "bomb.txt", "ratio_too_high"), ("b.zip", None, "unreadable")}


def test_listing_of_many_documents(spark, tmp_path):
    """More of a source than an archive may have members: counts of the SQL, and the guard itself still counts members."""
    n = F.col("id")
    spark.range(25_000).select(n.alias("doc_id"), F.lit("src0").alias("source"), F.lit(10).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.problem: r.n for r in files.sc10_archive_guards(spark, str(tmp_path)).collect()}
    assert got == {"unsafe_path": 1250, "ratio_too_high": 625, "invalid_packed_size": 625, "encrypted": 625, "link": 625}
    member = spark.range(scans.MOST_MEMBERS + 1).select(F.lit("a").alias("archive"), n.cast("string").alias("member"), *[F.lit(1).cast("long").alias(c) for c in ("size", "packed")], *[F.lit(False).alias(c) for c in ("encrypted", "link")], F.lit(None).cast("string").alias("error"))
    assert [tuple(r) for r in scans.archive_problems(member).collect()] == [("a", None, "too_many_members")]


def test_sinks(spark, tmp_path):
    df = spark.range(30)
    scans.write_new(df, str(tmp_path / "t"))
    scans.write_new(df.orderBy("id", ascending=False), str(tmp_path / "t"))  # the same rows are there already
    for other in (spark.range(29), spark.range(31), df.union(spark.range(1))):
        with pytest.raises(AnalysisException):
            scans.write_new(other, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 30
    scans.write_ordered_csv(df.selectExpr("id", "id * 2 as twice"), str(tmp_path / "c"), ["twice", "id"], ["id"])
    lines = [x for p in sorted((tmp_path / "c").glob("part-*")) for x in p.read_text().splitlines() if x != "twice,id"]
    assert lines == [f"{2 * i},{i}" for i in range(30)]


def test_sizes_from_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xff\xc4\x00\x03x" + b"\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01"
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14)
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 200)
    assert [images.size_of(x) for x in (png, jpeg, lossless, lossy)] == [("PNG", 640, 480), ("JPEG", 9, 7), ("WEBP", 100, 50), ("WEBP", 320, 200)]
    for bad in (b"", b"GIF89a", png[:20], b"\xff\xd8\xff\xd9", jpeg[:14], lossy[:20]):
        with pytest.raises(ValueError):
            images.size_of(bad)


def test_inspected_images(spark, tmp_path):
    whole = lambda w, h: png.encode(np.zeros((h, w, 3), np.uint8))
    for name, data in (("train/sbc/a.png", whole(640, 480)), ("web/other/b.png", whole(3000, 100)), ("c.jpg", b"no image"), ("d.txt", b"x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.relative_path: r for r in scans.inspected_images(spark, str(tmp_path), ["sbc"]).collect()}
    assert set(rows) == {"train/sbc/a.png", "web/other/b.png", "c.jpg"}
    a, b, c = (rows[x] for x in ("train/sbc/a.png", "web/other/b.png", "c.jpg"))
    assert (a.class_name, a.source, a.split, a.width, a.height, a.format, a.decode_ok, a.quality_flags, a.error) == ("sbc", "train", "train", 640, 480, "PNG", True, "", None)
    assert (b.class_name, b.quality_flags, b.decode_ok) == ("UNASSIGNED", "LOW_HEIGHT|EXTREME_ASPECT_RATIO|UNASSIGNED_CLASS", True)
    assert (c.decode_ok, c.quality_flags, c.error, c.width, c.source) == (False, "DECODE_FAILED", "cannot identify image", None, "local")


def test_archives_opened_by_path(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("labels/1.txt", "0 0.5 0.5 0.25 0.25\n")
        z.writestr("labels/2.TXT", "")
    found = scans.archives(spark, str(tmp_path), most_held=1)
    assert found.where("content is null").count() == 1
    assert sorted((r.member, r.text) for r in scans.texts_of(found, ".txt").collect()) == [("labels/1.txt", "0 0.5 0.5 0.25 0.25\n"), ("labels/2.TXT", "")]
