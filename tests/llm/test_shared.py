import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm.shared import Words, components, spanning

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .é漢\n", max_size=12)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    h = w.hashes()
    seen = {}
    for i, text in enumerate(texts):
        own = range(w.bounds[i], w.bounds[i + 1])
        assert [bytes(w.data[w.first[k] : w.last[k]]).decode() for k in own] == plain_words(text)
        for k in own:
            assert seen.setdefault(h[k], bytes(w.data[w.first[k] : w.last[k]])) == bytes(w.data[w.first[k] : w.last[k]])


def test_grams_of_short_and_long_texts():
    w = Words(pa.array(["a b c", "a b", "", "b a b c"]))
    grams, at = w.grams(3)
    assert list(w.of[at]) == [0, 1, 3, 3]
    assert grams[0] == grams[3] and len(set(grams)) == 3


def test_components_are_those_of_a_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 260)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()} == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_spanning_forest_keeps_components():
    for seed in range(30):
        links = np.triu(np.random.default_rng(seed).random((10, 10)) < 0.15, 1)

        def labels(edges):
            of = list(range(10))
            for a, b in edges:
                of = [of[a] if x == of[b] else x for x in of]
            return [of.index(x) for x in of]

        edges = spanning(links, np.arange(10), np.arange(10), 10)
        assert labels(edges) == labels(np.argwhere(links).tolist()) and len(edges) < 10
