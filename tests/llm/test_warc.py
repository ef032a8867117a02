import hashlib

import zstandard
from pyarrow import fs

from sievemark.llm import warc

BIG = "x" * 1000
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "http://a b\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (None, "u", BIG), (10, "u", "long\r\n\r\n" * 9000), (9, None, BIG)]


def _pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, frame string").repartition(3)


def test_every_payload_comes_back(spark):
    got = warc.archive(_pages(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        html = next(h for p, _, h in ROWS if p == r.page_id)
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        same = [p for p, _, h in ROWS if h == html and p is not None]
        first = max(same) if len(raw) >= 1000 and same else r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first) if r.page_id != first else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw


def test_bundles_are_plain_zstandard_with_a_seek_table(spark):
    index = warc.write_bundles(warc.with_revisits(_pages(spark)), frame_bytes=2000).collect()
    for path in {r.bundle for r in index}:
        store, _ = fs.FileSystem.from_uri(index[0].folder)
        with store.open_input_file(path) as f:
            table = warc.read_seek_table(f)
            f.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
        assert sum(n for _, _, n in table) == len(whole)
        for r in (r for r in index if r.bundle == path):
            at = sum(n for _, _, n in table[: r.frame]) + r.offset
            fields = warc.parse_record(whole[at : at + r.length])["fields"]
            assert fields["WARC-Record-ID"] == warc.record_id(r.page_id)
            assert "X" not in fields


def test_no_pages(spark):
    assert warc.archive(_pages(spark, [])).count() == 0
