"""Ingest of real archives: members by task, guards, rules and numbering."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from sievemark.functions import png
from sievemark.operators import ingest
from sievemark.sources import scans

LABELS = {"board": (0, "board"), "Chip": (2, "chip")}


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def picture(w, h, seed):
    return png.encode(np.random.default_rng(seed).integers(0, 256, (h, w, 3)))


def run(spark, archives):
    found = spark.createDataFrame(list(archives.items()), "path string, content binary")
    members = scans.members_of(found)
    texts = scans.texts_of(found, ".json")
    contents = scans.member_contents(found, members.where(F.lower("member").rlike(r"\.png$")), task_bytes=2000)
    probes = scans.probed_files(contents.withColumnRenamed("member", "relative_path").withColumn("length", F.octet_length("content").cast("long")).drop("archive", "error"), [])
    probes = contents.select("archive", "member").join(probes, F.col("member") == F.col("relative_path")).select("archive", "member", F.col("sha256_file").alias("sha256"), "width", "height", "decode_ok")
    return ingest.ingested(texts, probes, LABELS)


def test_a_clean_archive(spark):
    document = {
        "images": [{"id": 7, "file_name": "b.png", "width": 8, "height": 6}, {"id": 5, "file_name": "deep/a.png", "width": 4, "height": 4}],
        "categories": [{"id": 3, "name": "Chip"}, {"id": 1, "name": "board"}],
        "annotations": [{"id": 90, "image_id": 5, "category_id": 1, "bbox": [0, 0, 4, 4]}, {"image_id": 7, "category_id": 3, "bbox": [-1e-7, 1, 2.5, 2], "iscrowd": 0}],
    }
    problems, images, annotations = run(spark, {"z.zip": archive({"train/x.json": json.dumps(document), "train/b.png": picture(8, 6, 1), "deep/a.png": picture(4, 4, 2)})})
    assert problems.count() == 0
    rows = {r.id: r for r in images.collect()}
    assert [(rows[i].source_image_id, rows[i].member, rows[i].width) for i in (1, 2)] == [(7, "train/b.png", 8), (5, "deep/a.png", 4)]
    assert rows[1].file_name == rows[1].sha256[:20] + ".png"
    got = sorted((r.id, r.image_id, r.category_id, list(r.bbox), r.area, r.source_id) for r in annotations.collect())
    assert got == [(1, 2, 1, [0.0, 0.0, 4.0, 4.0], 16.0, "90"), (2, 1, 3, [0.0, 1.0, 2.5, 2.0], 5.0, "2")]
    assert sorted(map(tuple, ingest.class_counts(annotations).collect())) == [(1, 1, 1), (3, 1, 1)]


def test_every_rule(spark):
    same = picture(4, 4, 3)
    document = {
        "images": [
            {"id": 1, "file_name": "ok.png", "width": 4, "height": 4}, {"id": "2", "file_name": "ok.png"}, {"id": True}, {"id": 3, "file_name": "ok2.png"}, {"id": 3, "file_name": "ok2.png"},
            {"id": 4, "file_name": 9}, {"id": 5, "file_name": "none.png"}, {"id": 6, "file_name": "two.png"}, {"id": 7, "file_name": "bad.png"}, {"id": 8, "file_name": "size.png", "width": 5, "height": 4},
            {"id": 9, "file_name": "same1.png", "width": 4, "height": 4}, {"id": 10, "file_name": "same2.png", "width": 4, "height": 4},
        ],
        "categories": [{"id": 1, "name": "board"}, {"id": 2, "name": ""}, {"id": 3, "name": "cat"}, {"id": 4.0, "name": "board"}, {"id": 5, "name": "Chip"}, {"id": 5, "name": "board"}],
        "annotations": [
            {"image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"image_id": 99, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"image_id": 1, "category_id": 98, "bbox": [0, 0, 1, 1]}, {"image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "iscrowd": 1},
            {"image_id": 1, "category_id": 1, "bbox": [0, 0, 0, 1]}, {"image_id": 1, "category_id": 1, "bbox": [3, 3, 1.1, 1]}, {"image_id": 1, "category_id": 1, "bbox": [0, 0, 1]}, {"image_id": 1, "category_id": 1}, {"image_id": 9, "category_id": 1, "bbox": [0, 0, 1, 1]},
        ],
    }
    members = {"x.json": json.dumps(document), "y.json": "[1]", "z.json": '{"images": []}', "ok.png": picture(4, 4, 1), "ok2.png": picture(4, 4, 2), "a/two.png": picture(1, 1, 1), "b/two.png": picture(1, 2, 1), "bad.png": picture(4, 4, 9)[:-5], "size.png": picture(4, 4, 5), "same1.png": same, "same2.png": same}
    problems, images, annotations = run(spark, {"z.zip": archive(members)})
    got = sorted((r.document, -1 if r["at"] is None else r["at"], r.problem) for r in problems.collect())
    want = [("x.json", i, p) for i, p in [(1, "image_id"), (2, "image_id"), (3, "repeated_image_id"), (4, "repeated_image_id"), (5, "file_name"), (6, "member_missing"), (7, "member_ambiguous"), (8, "not_decoded"), (9, "dimensions"), (10, "repeated_content"), (11, "repeated_content")]]
    want += [("x.json", i, p) for i, p in [(1, "category_name"), (2, "label_not_allowed"), (3, "category_id"), (4, "repeated_category_id"), (5, "repeated_category_id")]]
    want += [("x.json", i, p) for i, p in [(1, "unknown_image"), (2, "unknown_category"), (3, "crowd"), (4, "bbox"), (5, "bbox"), (7, "bbox"), (6, "bbox")]]
    assert got == sorted([*want, ("y.json", -1, "not_a_document"), ("z.json", -1, "not_a_document")])
    assert [r.source_image_id for r in images.collect()] == [1] and [(r.image_id, r.category_id) for r in annotations.collect()] == [(1, 1)]


def test_members_that_are_bombs_or_damaged(spark):
    whole = archive({"a.png": b"x" * 5000, "zeros.png": b"\0" * 3_000_000, "b.png": bytes(range(256)) * 8})
    broken = bytearray(whole)
    broken[whole.index(b"b.png") + 12] ^= 255
    found = spark.createDataFrame([("z.zip", whole), ("w.zip", bytes(broken))], "path string, content binary")
    members = scans.members_of(found)
    rows = {(r.archive, r.member): r for r in scans.member_contents(found, members, task_bytes=1000).collect()}
    assert rows["z.zip", "a.png"].content == b"x" * 5000 and rows["z.zip", "b.png"].content == bytes(range(256)) * 8
    assert (rows["z.zip", "zeros.png"].content, rows["z.zip", "zeros.png"].error) == (None, "too_many_bytes")
    assert rows["w.zip", "b.png"].content is None and rows["w.zip", "b.png"].error and rows["w.zip", "a.png"].error is None
    assert len(rows) == 6
