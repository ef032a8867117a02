"""Column functions on values whose results are known."""

import html
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.functions import geometry as g
from sievemark.functions import identity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tiles(spark):
    assert one(spark, g.tile_starts(F.lit(500), 640, 0.2)) == [0]
    assert one(spark, g.tile_starts(F.lit(1280), 640, 0.2)) == [0, 512, 640]
    assert one(spark, g.tile_starts(F.lit(1152), 640, 0.2)) == [0, 512]
    grid = one(spark, g.tile_grid(F.lit(1280), F.lit(100), 640, 0.2))
    assert [(t.left, t.top, t.right, t.bottom) for t in grid] == [(0, 0, 640, 100), (512, 0, 1152, 100), (640, 0, 1280, 100)]


def test_half_even_and_no_negative_zero(spark):
    for value, want in (("1.0005", "1.000"), ("1.0015", "1.002"), ("-0.0001", "0.000"), ("2.5", "2.500")):
        assert one(spark, g.quantized(F.lit(value))) == want


def test_yolo_and_coco_meet_at_three_decimals(spark):
    box = (F.lit(10.0), F.lit(8.0), F.lit(50.0), F.lit(40.0))
    shares = [x + 4e-9 for x in g.to_unit_centre(box, F.lit(100.0), F.lit(80.0))]
    assert one(spark, g.canonical_from_yolo(tuple(shares), F.lit(100), F.lit(80))) == one(spark, g.canonical_from_coco(box)) == ["10.000", "8.000", "50.000", "40.000"]
    assert one(spark, g.yolo_line(F.lit(0), box, F.lit(100), F.lit(80))) == "0 0.35000000 0.35000000 0.50000000 0.50000000"
    assert one(spark, g.yolo_line(F.lit(0), box, F.lit(40), F.lit(80))) is None and one(spark, g.yolo_line(F.lit(0), box, F.lit(0), F.lit(80))) is None


def test_boxes_in_an_image(spark):
    ok = lambda *b: one(spark, g.valid_xywh(tuple(F.lit(float(x)) for x in b), F.lit(100), F.lit(80)))
    assert ok(-5e-7, 0, 100, 80) and ok(0, 0, 1, 1)
    assert not any((ok(-1e-3, 0, 1, 1), ok(0, 0, 0, 1), ok(60, 0, 41, 1), ok(math.nan, 0, 1, 1), ok(0, 0, math.inf, 1)))


def test_two_overlaps(spark):
    b = lambda *x: tuple(F.lit(float(v)) for v in x)
    assert one(spark, g.iou_xywh(b(0, 0, 10, 10), b(5, 0, 10, 10))) == pytest.approx(1 / 3)
    assert one(spark, g.iou_xyxy(b(0, 0, 10, 10), b(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, g.iou_xyxy(b(10, 10, 0, 0), b(0, 0, 10, 10))) == 0 and one(spark, g.iou_xywh(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0


def test_ratios(spark):
    assert one(spark, g.safe_ratio(F.lit(0), F.lit(0))) == 0 and one(spark, g.safe_ratio(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, g.wilson_lower(F.lit(0), F.lit(0))) == 0 and one(spark, g.wilson_lower(F.lit(95), F.lit(100))) == pytest.approx(0.8882495, abs=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 50), st.integers(1, 50))
def test_wilson_bound_is_below_the_share(spark, good, more):
    n = good + more
    assert 0 <= one(spark, g.wilson_lower(F.lit(good), F.lit(n))) <= good / n + 1e-12


def test_paths(spark):
    p = lambda f, x, *a: one(spark, f(F.lit(x), *a))
    assert p(text.class_of_path, "raw/web/board/one.png", ["board"]) == "board" and p(text.class_of_path, "a/one.png", ["one.png"]) == "UNASSIGNED"
    assert p(text.class_of_path, "x/a/b/c.png", ["a", "b"]) == "b" and p(text.class_of_path, "c.png", ["a"], "d") == "d"
    assert (p(text.source_of_path, "a/b.png"), p(text.source_of_path, "b.png")) == ("a", "local")
    assert (p(text.split_of_path, "val/a.png"), p(text.split_of_path, "x/val/a.png")) == ("val", "UNASSIGNED")
    assert [p(text.source_split, x) for x in ("a/Valid/x.json", "test/train/x.json", "x.json")] == ["val", "train", "train"]
    safe = lambda x: p(text.is_safe_relative_path, x)
    assert safe("a/b.png") and safe("a\\b") and not any(map(safe, ("/a", "a/../b", "C:\\a", "c:a", "", "  ", "..")))


def test_licenses_and_keywords(spark):
    allowed = lambda x: one(spark, text.license_allowed(F.lit(x), ["CC BY", "CC0", "Public domain"]))
    assert allowed("CC BY-SA 4.0") and allowed("cc_by 4.0") and not any(map(allowed, ("All rights reserved", "CC BY-NC 4.0", "CC BY-ND", "CC BY Non-Commercial")))
    keep = lambda x: one(spark, text.keywords_allow(F.lit(x), ["nucleo", "discovery"], ["logo"]))
    assert keep("STM32 Nucleo board.jpg") and not keep("Nucleo logo.png") and not keep("generic board")


def test_addresses(spark):
    problem = lambda x: one(spark, text.url_problem(F.lit(x), ["upload.example.org"], "image_url"))
    assert problem("https://upload.example.org/a.jpg") is None and problem("https://UPLOAD.example.org:443/a") is None
    assert [problem(x).split(":", 1)[1] for x in ("", "http://upload.example.org/a", "https://u:p@upload.example.org/a", "https://upload.example.org:8443/a", "https://evil.org/a", "https://upload.example.org/a#b", "https://upload.example.org")] == [
        "missing_url", "https_required", "credentials_forbidden", "port_not_allowed:8443", "host_not_allowed:evil.org", "fragment_forbidden", "invalid_path"]


def test_texts(spark):
    raw = "<p>A &amp; B</p>\n <b>c&nbsp;d</b>"
    assert one(spark, text.clean_html(F.lit(raw))) == "A & B c d" == " ".join(html.unescape("A &amp; B c d").split())
    assert one(spark, text.safe_stem(F.lit("File:Ünï x/y.jpg"))) == "n_x_y.jpg" and one(spark, text.safe_stem(F.lit("///"))) == "image"
    assert one(spark, text.mediawiki_sha1(F.lit("phoiac9h4m842xq45sp7s6u21eteeq1"))) == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert one(spark, text.mediawiki_sha1(F.lit("zz!"))) is None and one(spark, text.mediawiki_sha1(F.lit("DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"))) == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert one(spark, text.utc_or_null(F.lit("2024-02-30T00:00:00Z"))) is None and one(spark, text.utc_or_null(F.lit("2024-02-29T10:00:00Z"))) is not None
    assert [one(spark, text.sniffed_mime(F.lit(x))) for x in (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n0", b"RIFF1234WEBPx", b"RIFF1234WAVE")] == ["image/jpeg", "image/png", "image/webp", ""]
    assert one(spark, text.redacted(F.lit("see C:\\Users\\me\\x, D:\\y and /home/me/z or a/b"), {"D:\\y": "<ROOT>"})) == "see <USER_HOME>\\x, <ROOT> and <USER_HOME>/z or a/b"
    assert one(spark, text.without_ansi(F.lit("\x1b[1;31mred\x1b[0m"))) == "red" and one(spark, text.canonical_text(F.lit("\ufeffa\r\nb\rc"))) == "a\nb\nc"


def test_flags(spark):
    flags = lambda w, h, c: one(spark, text.quality_flags(F.lit(w), F.lit(h), F.lit(c)))
    assert flags(640, 480, "a") == "" and flags(100, 500, "UNASSIGNED") == "LOW_WIDTH|EXTREME_ASPECT_RATIO|UNASSIGNED_CLASS" and flags(0, 0, "a") == "LOW_WIDTH|LOW_HEIGHT"


def test_hashes(spark):
    assert one(spark, identity.hash64(F.lit("ffffffffffffffff"))) == -1 and one(spark, identity.hamming(F.lit(-1), F.lit(0))) == 64
    v = {k: one(spark, c) for k, c in identity.newline_variants(F.lit("a\r\nb")).items()}
    assert v["raw"] == v["crlf"] != v["lf"]
