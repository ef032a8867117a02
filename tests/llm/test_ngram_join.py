import random
import tracemalloc
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa

from sievemark.llm import ngram_join, shared
from tests.llm.test_shared import plain_words


def plain_set(text, n=5):
    words = plain_words(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain(rows, similarity=0.8):
    sets = [plain_set(x) for _, x in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {p for own in where.values() for p in combinations(own, 2)}
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            up[max(root(i), root(j))] = min(root(i), root(j))
    name = lambda own: min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [k for k in range(len(rows)) if sets[k] == sets[i]] if sets[i] else [i]
        top = name([k for k in range(len(rows)) if root(k) == root(i)])
        out.append((doc, name(same), links[i], top, doc == top))
    return sorted(out, key=str)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cde", "fg", "hij", "klm", "no"]) + rng.choice("pqrstu") + str(rng.randrange(40))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, row int").repartition(4)


def test_links_are_those_of_all_pairs(spark):
    rows = corpus(1, 30, 6)
    rows += [(500, rows[3][1]), (501, rows[3][1].upper() + " !!"), (3, rows[3][1]), (None, rows[3][1]), (502, None), (503, ""), (504, "..."), (505, "one two"), (506, "One, two"), (507, "one two three"), (508, "a b c d " * 9000)]
    assert sorted((tuple(r) for r in ngram_join.join(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_links_over_many_blocks(spark):
    rows = corpus(2, 2, 90)
    assert sorted((tuple(r) for r in ngram_join.join(frame(spark, rows), block=16).collect()), key=str) == plain(rows)


def test_one_row_of_each_group_stays(spark):
    rows = corpus(3, 8, 5) + [(900, None), (901, ""), (0, corpus(3, 8, 5)[0][1])]
    docs = frame(spark, rows)
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[0] for x in plain(rows) if x[4]})
    assert ngram_join.join(docs.where("false")).count() == 0 and ngram_join.without_near_copies(docs.where("false")).count() == 0


def test_both_ways_of_counting_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([x[2:], [np.uint64(99)]])) for x in sets]
    asked = np.triu(np.ones((40, 40), bool), 1)
    all_ = ngram_join.similar(sets, sets, asked, 0.8)
    for i, j in np.argwhere(asked):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        one = np.zeros_like(asked)
        one[i, j] = True
        assert all_[i, j] == ngram_join.similar(sets, sets, one, 0.8)[i, j] == (len(a & b) >= 0.8 * len(a | b) - 1e-9)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.band_plan(0.8, 0.99999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999
    rng, hit = np.random.default_rng(0), 0
    for _ in range(60):
        grams = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        hit += (ngram_join.bands_of(grams[:80], bands, rows) == ngram_join.bands_of(grams[10:], bands, rows)).any()  # 70 of 90 in common
    assert hit >= 59


def test_a_text_with_few_words_is_one_gram():
    assert [len(x) for x in ngram_join.gram_sets(pa.array(["a", "a b c d", "a b c d e f", "", None]))] == [1, 1, 2, 0, 0]


def test_a_task_holds_the_words_of_a_few_texts_at_a_time():
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(1 << 24):x}" for _ in range(15_000)) for _ in range(40)]
    rows = pd.DataFrame({"root": range(40), "i": 0, "j": 0, "block": 0, "row": range(40), "n": 1, "bands": [[k] for k in range(40)], "text": texts})
    shared._powers.cache_clear()
    tracemalloc.start()
    try:
        found = ngram_join._verify(rows, 0.8, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not len(found) and peak < 100 << 20, peak
