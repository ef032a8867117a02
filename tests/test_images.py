"""Decoding, resampling and hashes of images, against plain loops."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.functions import images, png
from sievemark.sources import scans


def _plain_rgb(pixels, depth, palette):
    top = (1 << depth) - 1
    if palette is not None:
        return palette[pixels[:, :, 0]]
    eight = pixels >> 8 if depth == 16 else pixels * 255 // top
    return eight[:, :, :3] if pixels.shape[2] > 2 else np.repeat(eight[:, :, :1], 3, axis=2)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 23), st.integers(1, 19), st.sampled_from([(1, 1), (1, 2), (1, 4), (1, 8), (1, 16), (2, 8), (2, 16), (3, 8), (3, 16), (4, 8), (4, 16)]), st.integers(0, 4), st.booleans(), st.booleans(), st.integers(0, 999))
def test_files_decode_to_the_pixels_they_were_made_of(width, height, kind, first, interlace, with_palette, seed):
    samples, depth = kind
    rng = np.random.default_rng(seed)
    pixels = rng.integers(0, 1 << depth, (height, width, samples))
    palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if with_palette and samples == 1 and depth <= 8 else None
    image = png.decode(png.encode(pixels, first, interlace, 1, depth, palette))
    assert (image.rgb == _plain_rgb(pixels, depth, palette)).all()
    modes = {(1, 1): "1", (1, 2): "L", (1, 4): "L", (1, 8): "L", (1, 16): "I;16", (2, 8): "LA", (2, 16): "RGBA", (3, 8): "RGB", (3, 16): "RGB", (4, 8): "RGBA", (4, 16): "RGBA"}
    assert image.mode == ("P" if palette is not None else modes[kind])


def test_filters_against_a_plain_loop():
    rng = np.random.default_rng(2)
    rows, size, step = 40, 33, 3
    data = rng.integers(0, 256, (rows, size + 1)).astype(np.uint8)
    data[:, 0] = rng.integers(0, 5, rows)
    want = np.zeros((rows + 1, size + step), int)
    for y in range(rows):
        for x in range(size):
            a, b, c = want[y + 1, x], want[y, x + step], want[y, x]
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            want[y + 1, x + step] = (int(data[y, x + 1]) + [0, a, b, (a + b) // 2, near][data[y, 0]]) % 256
    assert (png.unfiltered(data.reshape(-1), rows, size, step) == want[1:, step:]).all()


def test_stored_turns():
    rgb = np.arange(2 * 3 * 3).reshape(2, 3, 3).astype(np.uint8)
    shown = {1: rgb, 2: np.fliplr(rgb), 3: np.rot90(rgb, 2), 4: np.flipud(rgb), 5: rgb.transpose(1, 0, 2), 6: np.rot90(rgb, -1), 7: np.rot90(rgb.transpose(1, 0, 2), 2), 8: np.rot90(rgb)}
    for turn, want in shown.items():
        assert (png.decode(png.encode(rgb, turn=turn)).rgb == want).all()
    assert png.turn_of(b"") == png.turn_of(b"II*\0") == png.turn_of(b"MM\0*\0\0\0\x08\xff\xff") == 1


def test_broken_files():
    good = png.encode(np.zeros((5, 4, 3), np.uint8))
    bad = [good[:at] for at in (0, 4, 8, 20, 33, 40, len(good) - 1)]
    bad += [good.replace(b"IHDR", b"IHDX"), good[:50] + bytes([good[50] ^ 255]) + good[51:]]
    chunk = lambda kind, x: len(x).to_bytes(4, "big") + kind + x + zlib.crc32(x, zlib.crc32(kind)).to_bytes(4, "big")
    header = lambda w, h, rest=b"\x08\x02\0\0\0": png.SIGNATURE + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + rest)
    end = chunk(b"IEND", b"")
    bad += [header(4, 5) + end, header(4, 5) + chunk(b"IDAT", zlib.compress(b"\0" * 9)) + end, header(4, 5) + chunk(b"IDAT", b"nonsense") + end, header(1, 1) + chunk(b"IDAT", zlib.compress(b"\x05abc")) + end]
    bad += [header(1 << 20, 1 << 20) + end, header(0, 1) + end, header(1, 1, b"\x03\x02\0\0\0") + end, header(1, 1, b"\x08\x03\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + end]
    for content in bad:
        with pytest.raises(ValueError):
            png.decode(content)


def test_resampling_against_plain_sums():
    rng = np.random.default_rng(3)
    gray = rng.integers(0, 256, (37, 70)).astype(np.uint8)

    def line(values, out):
        scale = len(values) / out
        wide, found = max(scale, 1), []
        for i in range(out):
            centre = (i + 0.5) * scale
            lo, hi = max(0, int(centre - 3 * wide + 0.5)), min(len(values), int(centre + 3 * wide + 0.5))
            at = [(k - centre + 0.5) / wide for k in range(lo, hi)]
            w = [0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 for x in at]
            found.append(min(255, max(0, math.floor(sum(a * int(b) for a, b in zip(w, values[lo:hi], strict=True)) / sum(w) + 0.5))))
        return found

    across = np.array([line(row, 32) for row in gray])
    want = np.array([line(column, 32) for column in across.T]).T
    assert np.abs(images.resampled(gray, 32, 32).astype(int) - want).max() <= 1
    assert (images.resampled(gray, 37, 70) == gray).all() and images.resampled(gray[:1, :1], 32, 32).shape == (32, 32)


def test_hashes_stay_under_scaling_and_change_with_content():
    y, x = np.mgrid[0:96, 0:128]
    one = (128 + 60 * np.sin(x / 17) + 50 * np.cos(y / 11 + x / 40)).clip(0, 255).astype(np.uint8)
    bits = lambda a, b: (int(images.perceptual_hash_of(a), 16) ^ int(images.perceptual_hash_of(b), 16)).bit_count()
    assert bits(one, images.resampled(one, 192, 256)) <= 4 and bits(one, np.minimum(one.astype(int) + 10, 255).astype(np.uint8)) <= 4
    assert bits(one, one.T.copy()) > 10 and len(images.perceptual_hash_of(one)) == 16
    assert images.grey(np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], np.uint8)).tolist() == [[255, 76, 0]]


def test_folder_of_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    good = png.encode(rgb, 1, turn=6)
    for name, content in {"train/board/a.png": good, "val/other/b.PNG": good[:-4], "c.png": b"text", "train/board/short.png": b"\x89", "d.txt": good}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.relative_path: r for r in scans.inspected_images(spark, str(tmp_path), ["board"]).collect()}
    assert set(rows) == {"train/board/a.png", "val/other/b.PNG", "c.png", "train/board/short.png"}
    a, shown = rows["train/board/a.png"], np.rot90(rgb, -1)
    assert (a.width, a.height, a.mode, a.format, a.decode_ok, a.error) == (6, 5, "RGB", "PNG", True, None)
    assert a.sha256_pixels == hashlib.sha256(b"6x5:RGB" + shown.tobytes()).hexdigest() and a.phash64 == images.perceptual_hash_of(images.grey(shown))
    assert a.sha256_file == hashlib.sha256(good).hexdigest() and a.quality_flags == "LOW_WIDTH|LOW_HEIGHT"
    for name, error in {"val/other/b.PNG": "truncated PNG", "c.png": "cannot identify image", "train/board/short.png": "cannot identify image"}.items():
        assert (rows[name].decode_ok, rows[name].error, rows[name].quality_flags, rows[name].phash64) == (False, error, "DECODE_FAILED", None)
    nothing = spark.createDataFrame([(None,)], "x binary").select(images.image_probe(F.col("x")).alias("p")).collect()[0].p
    assert set(nothing) == {None}


def test_workers_hold_few_images_at_a_time(spark):
    """Batches of the probe are bounded whatever a partition holds."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    files = spark.range(1).selectExpr("'train/a.png' AS relative_path", "1L AS length", "X'00' AS content")
    scans.probed_files(files, [])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == scans.IMAGES_HELD and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 16 << 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
