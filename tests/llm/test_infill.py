import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm import infill, queries

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, ""), (None, "x\n\ny\n"), (5, "has <P> in it\nso plain"), (6, "ñ🎉\n" * 3000), (7, "no newline at all " * 2000), (8, "\n"), (9, "<\n<P\n>\n<S\n"), (10, "tail <")]


def plain(key, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in infill.MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cuts_and_round_trip_against_the_plain_rule(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, text string, output string, n int")
    cut = infill.fill_in_middle(docs)
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted((tuple(r) for r in cut.collect()), key=key) == sorted(((k, *plain(k, t)) for k, t in ROWS), key=key)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in infill.with_digests(cut).collect()) == sorted(sha(t) for _, t in ROWS)
    assert infill.with_digests(infill.fill_in_middle(docs.where("false"))).count() == 0


def test_whole_table_against_its_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.op12_fill_in_middle(spark, SF)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['op12_fill_in_middle']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>PSM\n\té🎉", max_size=30), st.integers(0, 99), st.sampled_from(["line", "word", "char"]))
def test_pieces_rebuild_every_text(text, key, unit):
    n, form, prefix, middle, output = infill.rearranged(text, key, unit, 7, 100, 50, infill.MARKS)
    parts = re.split("<P>|<S>|<M>", output)
    if form != "plain":
        assert len(parts) == 4 and (parts[1] + parts[3] + parts[2] if form == "psm" else parts[2] + parts[3] + parts[1]) == text
        assert (parts[1] if form == "psm" else parts[2]) == text[:prefix] and parts[3] == text[prefix : prefix + middle]
    else:
        assert output == text and (not text or any(m in text for m in infill.MARKS))


def test_units():
    edges = lambda text, unit: infill.boundaries(infill.code_points(text), unit).tolist()
    assert edges("a\n\nb", "line") == [0, 2, 3, 4] and edges("a\n", "line") == [0, 2] and edges("", "line") == [0]
    assert edges("ab  c d", "word") == [0, 4, 6, 7] and edges(" a", "word") == [0, 1, 2] and edges("é🎉", "char") == [0, 1, 2]
    with pytest.raises(ValueError):
        infill.boundaries(np.zeros(1, np.uint32), "page")


def test_shares_of_forms(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'a b c' AS text")
    forms = lambda **k: {r.form: r["count"] for r in infill.fill_in_middle(docs, unit="word", **k).groupBy("form").count().collect()}
    some = forms(percent=50, spm_percent=25)
    assert 900 < some["plain"] < 1100 and 190 < some["spm"] < 310
    assert forms(percent=0) == {"plain": 2000} and set(forms(spm_percent=0)) == {"psm"}
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, marks=("<P>", "P", "<M>"))
