import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.llm import private

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = lambda x: 2 * x - 9 * (x > 4)
    return sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def is_valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    spans = [(m.start(), i, m.end()) for i, (kind, form) in enumerate(BASE.items()) for m in re.finditer(form, text or "") if is_valid(kind, m[0])]
    return sorted(spans)


def told(spans):
    return ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in spans)


MENTION = private.MENTION.replace(r"|\G", r"|(?<=@[A-Za-z0-9-])")  # Python has no \G; the tests' texts don't need it


def plain_learned(texts, rounds=3, support=3.0, confidence=0.8):
    """All spans of each text by a plain version: dicts for the graph of patterns and identifiers."""
    mentions = {}
    for text in set(texts):
        own, last = [], 0
        found = list(re.finditer(MENTION, text))
        for i, m in enumerate(found):
            before, after = text[last : m.start()], text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
            last = m.end()
            digits = re.sub("[^0-9]", "", m[0])
            if not (6 <= len(m[0]) <= 64 and ("@" in m[0] or len(digits) >= 5)):
                continue
            seed = next((k for k, kind in enumerate(private.KINDS) if re.fullmatch(BASE[kind], m[0]) and is_valid(kind, m[0])), None)
            left, right = before[-80:].lower().split(), after[:80].lower().split()
            patterns = ["2:" + (" ".join(left[-2:]) or "^"), f"1:{left[-1] if left else '^'}_{right[0] if right else '$'}"]
            own.append((m.start(), m.end(), m[0].lower(), seed, patterns))
        mentions[text] = own
    seeds, edges = {}, defaultdict(set)
    for own in mentions.values():
        for _, _, m, seed, patterns in own:
            for p in patterns:
                edges[p].add(m)
            if seed is not None:
                seeds[m] = seed
    found = {}
    for _ in range(rounds):
        patterns = {}
        for p, ms in edges.items():
            for k in range(4):
                s = sum(seeds.get(m) == k for m in ms)
                w = s + sum(found[m][1] for m in ms if m in found and found[m][0] == k)
                if w >= support and s >= support:
                    patterns[p, k] = w / len(ms)
        chance = defaultdict(float)
        for (p, k), c in patterns.items():
            for m in edges[p]:
                if m not in seeds:
                    chance[m, k] += math.log(1 - 0.99 * min(c, 1))
        found = {}
        for (m, k), x in chance.items():
            score = 1 - math.exp(x)
            if score > found.get(m, (0, -1))[1] or score == found[m][1] and k < found[m][0]:
                found[m] = (k, score)
        found = {m: x for m, x in found.items() if x[1] >= confidence / 2}
    patterns = {x: c for x, c in patterns.items() if c >= confidence}
    out = {}
    for text, own in mentions.items():
        spans = base(text)
        for s, e, _, seed, ps in own:
            kinds = [(patterns[p, k], -k) for p in ps for k in range(4) if (p, k) in patterns]
            if seed is None and kinds and not any(a < e and b > s for a, _, b in base(text)):
                spans.append((s, -max(kinds)[1], e))
        out[text] = sorted(spans)
    return out


CARDS = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "4222222222222220", "30569309025904"]


def corpus():
    rows = [f"please note card number: {c} and thank you" for c in CARDS[:5]]
    rows += [f"call me at {p} today" for p in ("+1 (743) 555-3824", "+44 20 7946 0958", "+49 30 901820-11", "+1 (310) 555-4510")]
    rows += ["please note card number: 4111-1111-1111-1112 and thank you", "your card number: 99887766 was used", "call me at 555-867-5309x today", "we call at 1234567 noon"]
    rows += ["version 2.0.13 build 20240101 is out", "in 123456 of 999999 cases, order 7654321 shipped"]
    return rows


def spans_of(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in private.report(private.find_private(docs, **more)).collect()}


def test_patterns_find_what_forms_miss(spark):
    texts = corpus()
    got = spans_of(spark, texts)
    want = plain_learned(texts)
    assert got == {i: told(want[t]) for i, t in enumerate(texts)}
    at = lambda i, x, kind: f"{kind}:{texts[i].index(x)}:{texts[i].index(x) + len(x)}"
    assert got[9] == at(9, "4111-1111-1111-1112", "card") and got[10] == at(10, "99887766", "card") and got[11] == at(11, "555-867-5309x", "phone")
    assert got[12] == got[13] == got[14] == ""


def test_copies_teach_nothing_new(spark):
    texts = [*corpus()[:2] * 20, "please note card number: 123456789 and thank you"]
    assert spans_of(spark, texts)[40] == ""


def test_whole_table_against_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    want = plain_learned(list(rows.values()))
    for r in private.report(private.find_private(docs)).collect():
        spans = base(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told(spans).encode()).hexdigest() and r.spans == told(want[rows[r.doc_id]])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]


@pytest.fixture(scope="module")
def of_texts(spark):
    def of(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
        return [[tuple(x) for x in r.b] for r in df.select("i", private.base_spans(F.col("t")).alias("b")).orderBy("i").collect()]

    return of


def test_base_spans_against_the_forms(of_texts):
    chunk = st.sampled_from(["a", "B.", "é", "🎉", "@", "a@b", ".c", "1", "12", "255", "256", "0255", ".", "-", " ", "+", "+1", "(", ")", "4111111111111111", "_", "%", "\n", "a@b.c_d@e.f"])
    collected = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(chunk, max_size=14))
    def collect(parts):
        collected.append("".join(parts))

    collect()
    assert of_texts(collected) == [base(t) for t in collected]


def test_long_texts_take_time_in_proportion(of_texts):
    texts = ["a" * 1_000_000, "7" * 1_000_000, "a@" * 300_000, "1.2." * 200_000 + "x", "+1" + "(" * 500_000, "x a.b@c.de 1.2.3.4 " * 20_000]
    got = of_texts(texts)
    assert [len(x) for x in got[:5]] == [0, 0, 0, 100_000, 0] and got[5] == base(texts[5])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "mail a@b.cd now"), (4, "mail a@b.cd now"), (4, "mail a@b.cd now"), (5, "x")]
    docs = spark.createDataFrame([(*r, "k", 1, "m") for r in rows], "doc_id long, text string, key string, base int, mentions string")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in private.report(private.find_private(docs)).collect())
    assert got == sorted([("1", 0, ""), ("2", 0, ""), ("None", 1, "email:5:11"), ("4", 1, "email:5:11"), ("4", 1, "email:5:11"), ("5", 0, "")])
    assert private.report(private.find_private(docs.where("false"))).count() == 0


def test_masked_texts(spark):
    df = spark.createDataFrame([("mail a@b.cd or 1.2.3.4!",), ("no",), ("",)], "t string")
    out = [r.m for r in df.select(private.masked(F.col("t"), private.base_spans(F.col("t"))).alias("m")).collect()]
    assert out == ["mail <email> or <ip>!", "no", ""]


def test_no_python_runs_on_the_main_path(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = private.marked(docs)._jdf.queryExecution().toString() + private.report(private.find_private(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
