import random
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sievemark.llm import licenses
from tests.llm.test_shared import plain_words

TEXTS = [
    None,
    "",
    "no words about it",
    "Released under the MIT License. The MIT-license; mit\nLICENSE",
    "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License, version 3, and the apache license",
    "permit license mitlicense licenses mit é license éapache license",
    "GNU Lesser General Public License",
    "general public. license public license",
    "SPDX-License-Identifier: BSD-3-Clause. All rights reserved.",
    "word " * 20000 + "mit license",
    "mit",
    "license",
]


def plain(text):
    words = plain_words(text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_hundreds_of_rules():
    assert sum(map(len, licenses.rules().values())) > 300


def test_base_places_are_those_of_a_plain_search(spark):
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(4, TEXTS[4], "clash"), (None, TEXTS[3], "clash")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "")
    labels = {r.doc_id: r.labels for r in got}
    assert labels[4] == "apache" and labels[5] == "apache,gpl,gpl-3.0" and labels[9] == "bsd-3-clause,proprietary" and "lgpl" in labels[7]
    assert labels[2] == labels[6] == "" or labels[2] == ""
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_lies_inside_a_stronger_detection_goes():
    a, b, c = licenses.Detection(0, 30, "a", 90, 1.0), licenses.Detection(5, 20, "b", 50, 0.7), licenses.Detection(25, 40, "c", 10, 0.5)
    assert licenses.settle([c, b, a, a]) == [a, c]
    assert licenses.settle([licenses.Detection(5, 20, "b", 95, 0.7), a]) == [a, licenses.Detection(5, 20, "b", 95, 0.7)]


def test_settled_detections_are_those_of_all_pairs():
    for seed in range(500):
        rng, found = random.Random(seed), []
        for _ in range(rng.randint(0, 25)):
            at = rng.randint(0, 30)
            found.append(licenses.Detection(at, at + rng.randint(1, 12), rng.choice("ab"), rng.randint(1, 4), 0.5))
        kept = []
        for x in sorted(set(found), key=lambda x: (-x.priority, x.start - x.end, x.start, x.label)):
            if not any(y.start <= x.start and x.end <= y.end for y in kept):
                kept.append(x)
        assert licenses.settle(found) == sorted(kept)


_EDGES = len(rb"(?<![0-9a-z\x80-\xff])"), len(rb"(?![0-9a-z\x80-\xff])")
_WITHIN = [(k, st.from_regex(re.compile(r.pattern.pattern[_EDGES[0] : -_EDGES[1]]), fullmatch=True)) for k, rules in licenses.rules().items() for r in rules]


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(_WITHIN).flatmap(lambda x: st.tuples(st.just(x[0]), x[1])))
def test_whatever_a_rule_matches_holds_its_keyword(drawn):
    keyword, text = drawn[0], drawn[1].lower()
    assert licenses._GATES.get(keyword, keyword) in licenses.squeezed(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))[0]


def test_labels_on_documents_are_those_of_all_rules(spark):
    """Every rule on every text, without keywords, over the documents' texts with license lines put into some."""
    notices = ["Licensed under the Apache License, Version 2.0 (the \"License\")", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: MIT OR Apache-2.0", "No rights reserved", "either version 2.1 of the License"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "")[:400] + ("\n" + notices[r.doc_id % 7] if r.doc_id % 7 < 5 else "")) for r in docs.collect()]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        raw, (_, n_base, _, _, base) = text.encode().lower(), plain(text)
        every = licenses.settle([licenses.Detection(*m.span(), r.label, r.priority, r.weight) for rules in licenses.rules().values() for r in rules for m in r.pattern.finditer(raw)])
        labels = {x.label for x in every} | set(filter(None, base.split(",")))
        assert got[i] == (",".join(sorted(labels)), max([0.6 * bool(n_base), *(x.weight for x in every)]))
    assert sum(bool(x) for x, _ in got.values()) > 100


def test_gate_loses_nothing():
    for text in TEXTS[:10]:
        raw = (text or "").lower().encode()
        assert licenses.detect(raw) == licenses.settle([licenses.Detection(*m.span(), r.label, r.priority, r.weight) for rules in licenses.rules().values() for r in rules for m in r.pattern.finditer(raw)])


def test_gate_with_breaks_inside_keywords(spark):
    texts = ["GNU Lesser\nGeneral Public License", "Creative\n  Commons Attribution", "Permission is\r\nhereby  granted, free of charge, to any person obtaining a copy"]
    texts += ["must not be used without prior\nwritten permission", "Creative Commons Attribution-Non-Commercial 4.0", "Python  Software\tFoundation License"]
    texts += [f" {k.decode()} license".replace(" ", " \n ") for k in licenses.rules()] + [r"  open", "font license"]
    rows = [(i, x) for i, x in enumerate(texts)]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for i, text in rows:
        raw = text.lower().encode()
        every = licenses.settle([licenses.Detection(*m.span(), r.label, r.priority, r.weight) for rules in licenses.rules().values() for r in rules for m in r.pattern.finditer(raw)])
        assert licenses.detect(raw) == every and {x.label for x in every} <= set(got[i].split(","))
    assert [x in got[i].split(",") for i, x in enumerate(["lgpl", "cc-by", "mit", "proprietary", "cc-by-nc", "psf"])] == [True] * 6
