"""Runs' rows, event files and line numbers."""

import functools
import json
import math
import random
import struct

import numpy as np
import pytest

from sievemark.operators import runs
from sievemark.sources import event_files, scans


def test_run_rows_and_their_fallbacks(spark):
    manifest = {"run_id": "r1", "model": "m", "status": "complete", "protocol": {"seed": 42}, "model_details": {"parameters": 7}, "best_checkpoint": {"mib": 1.5}, "dataset": {"val_annotation_sha256": "ab"}, "protocol_config": {"sha256": "cd"}}
    documents = [
        ("a", json.dumps(manifest), json.dumps({"metrics": {"ap50_95": 0.5, "ap50": None, "tp": 3}}), json.dumps({"e2e_p50_ms": 11.5, "e2e_p95_ms": 12.5, "sustained_fps": 80.0}), json.dumps({"peak_memory_used_mib": 900})),
        ("b", json.dumps({"framework": "f"}), json.dumps({"metrics_common": {"precision": 0.25}}), None, None),
        ("c", None, None, None, "not json"),
    ]
    docs = spark.createDataFrame(documents, "run string, manifest string, metrics string, latency string, gpu string")
    epochs = spark.createDataFrame(
        [("a", 1, 5.0, 0.1, 0.2, 0.3, 0.4, 100.0, 0.0), ("a", 2, 9.0, 0.6, 0.7, 0.8, 0.9, 200.0, 0.0), ("b", 1, 3.0, 0.11, 0.22, 0.33, 0.44, 50.0, None)],
        "run string, epoch int, elapsed_s double, map50 double, map50_95 double, precision double, recall double, gpu_peak_allocated_mib double, train_peak_allocated_mib double",
    )
    extra = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 300.0, 250.0), ("c", 1, 70.0, None)], "run string, line int, epoch_peak_allocated_mib double, train_peak_allocated_mib double")
    rows = {r.run_id: r for r in runs.run_rows(docs, epochs, extra).collect()}
    assert set(rows) == {"r1", "b", "c"} and tuple(rows["r1"].asDict()) == runs.COLUMNS and len(runs.COLUMNS) == 29
    a, b, c = rows["r1"], rows["b"], rows["c"]
    assert (a.ap50_95, a.ap50, a.precision, a.recall, a.tp, a.train_elapsed_s, a.peak_gpu_memory_mib, a.system_peak_gpu_memory_mib) == (0.5, None, 0.8, 0.9, 3, 9.0, 250.0, 900.0)
    assert (a.params, a.checkpoint_mib, a.latency_p50_ms, a.fps, a.seed, a.dataset_sha256, a.protocol_sha256, a.status) == (7, 1.5, 11.5, 80.0, 42, "ab", "cd", "complete")
    assert (b.model, b.status, b.ap50, b.ap50_95, b.precision, b.recall, b.peak_gpu_memory_mib) == ("f", "unknown", 0.11, 0.22, 0.25, 0.44, 50.0)
    assert (c.model, c.ap50, c.train_elapsed_s, c.peak_gpu_memory_mib) == ("c", None, None, 70.0)
    assert runs.repeated_runs(runs.run_rows(docs.union(docs.where("run = 'a'")), epochs, extra)).collect()[0].n == 2
    means = {r.model: r for r in runs.aggregates(runs.run_rows(docs, epochs, extra)).collect()}
    assert (means["m"].runs, means["m"].ap50_95_mean, means["m"].ap50_95_std, means["m"].ap50_mean) == (1, 0.5, None, None)


def test_checksums_and_messages():
    assert event_files.crc32c(b"123456789") == 0xE3069283 and event_files.crc32c(b"") == 0
    event = event_files.encoded(-3, 1.5, {"loss": 0.25, "é/lr": -1.0})
    assert list(event_files.scalars(event)) == [(-3, 1.5, "loss", 0.25), (-3, 1.5, "é/lr", -1.0)]
    tensor = event_files._field(1, 0, event_files._number(2)) + event_files._field(4, 2, struct.pack("<d", 0.1))
    value = event_files._field(1, 2, b"t") + event_files._field(8, 2, tensor)
    assert list(event_files.scalars(event_files._field(5, 2, event_files._field(1, 2, value)))) == [(0, 0.0, "t", 0.1)]
    other = event_files._field(3, 2, b"brain.Event:2")  # a file's first event has no summary
    assert list(event_files.scalars(other)) == []
    for bad in (b"\x80", b"\x0b", b"\x2a\x05ab", b"\x09\x00"):
        with pytest.raises(ValueError):
            list(event_files.scalars(bad))


def test_event_files_of_a_folder(spark, tmp_path):
    events = [event_files.encoded(i, float(i), {"a": i / 4}) for i in range(5)]
    good = event_files.framed(events)
    flipped = bytearray(good)
    flipped[len(event_files.framed(events[:2])) + 14] ^= 1
    for name, content in {"x/good": good, "x/y/flipped": bytes(flipped), "cut": good[:-1], "length": good[:4] + b"\x01" + good[5:]}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {}
    for r in event_files.scan(spark, str(tmp_path)).collect():
        rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    values = lambda k: [(r.step, r.tag, r.value) for r in sorted(rows[k], key=lambda r: r.place) if r.error is None]
    errors = lambda k: [r.error for r in rows[k] if r.error]
    assert values("good") == [(i, "a", i / 4) for i in range(5)] and errors("good") == []
    assert values("flipped") == values("good")[:2] and errors("flipped") == ["damaged record"]
    assert values("cut") == values("good")[:4] and errors("cut") == ["truncated record"] and errors("length") == ["damaged record length"] and values("length") == []


def test_checksums_of_many_files_at_once():
    """Short and long records side by side, damaged ones among them; a plain loop per byte gives the same."""
    rng = random.Random(2)
    plain = lambda data: functools.reduce(lambda x, b: event_files._PLAIN[(x ^ b) & 255] ^ x >> 8, data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    parts = [rng.randbytes(rng.choice([0, 1, 8, 40, 300])) for _ in range(400)] + [rng.randbytes(5000)]
    sizes = np.array([len(x) for x in parts])
    assert event_files._checksums(b"".join(parts), np.cumsum(sizes) - sizes, sizes).tolist() == [plain(x) for x in parts]
    events = [[event_files.encoded(i, 0.0, {"a" * rng.randint(1, 60): 1.0}) for i in range(rng.randint(0, 9))] for _ in range(200)]
    whole = event_files.framed_files(events)
    assert whole == [event_files.framed(x) for x in events]
    cut = [x[:-1] if k % 3 == 0 else x[:-1] + bytes([x[-1] ^ 1]) if x and k % 3 == 1 else x for k, x in enumerate(whole)]
    for k, (own, (found, end)) in enumerate(zip(events, event_files.records(cut), strict=True)):
        short = bool(own) and k % 3 < 2
        assert [x for _, x in found] == own[: len(own) - short] and (end and end[1]) == (["truncated record", "damaged record"][k % 3] if short else None)


def test_line_numbers_over_splits(spark, tmp_path):
    texts = {f"{k}.jsonl": [f"{k}-{i}" * (i % 7) + ("\r" if i % 5 == 0 else "") for i in range(3000 + 100 * k)] for k in range(3)}
    texts["ends.jsonl"] = ["a", "", "b"]
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("" if name == "ends.jsonl" else "\n"), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = scans.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = {}
        for r in rows.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: {i + 1: x.removesuffix("\r") for i, x in enumerate(lines)} for name, lines in texts.items()}
    assert math.isclose(len(got["2.jsonl"]), 3200)
