import math
import zlib
from collections import Counter

import numpy as np

from sievemark.llm import brown

SF = "/root/testdata/sf0.01/documents.parquet"


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, *[word] * bool(word), "<end>"]


def check(rows, got):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(t for i, x in rows if not held(i) for t in plain_tokens(x))
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for i, x in rows:
        own = plain_tokens(x)
        want[i, held(i), len(own), sum(counts[t] > 0 for t in own), total, round(sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_base_scores_are_those_of_plain_counts(spark):
    docs = spark.read.parquet(SF)
    got = brown.score_texts(docs, kept=500, clustered=100, classes=12).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "A a\x1fb \t\x0bÉ é"), (3, "A a\x1fb \t\x0bÉ é"), (None, "a"), (4, "x " * 30000), (11, "only here"), (12, "\n\n"), (13, "zz zz")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = brown.score_texts(docs).collect()
    check(rows, got)
    assert all(math.isfinite(r.score) for r in got)
    assert brown.score_texts(docs.where("false")).count() == 0
    untrained = brown.score_texts(docs.where("doc_id = 3 or doc_id is null"), kept=1).collect()
    check([r for r in rows if r[0] in (3, None)], untrained)
    alone = brown.score_texts(docs.where("doc_id = 13")).collect()
    check([(13, "zz zz")], alone)


def test_probabilities_sum_to_one():
    table = np.array([[3.0, 1, 0], [0, 0, 2], [0, 0, 0]])
    assert np.allclose((10 ** brown.transitions(table)).sum(axis=1), 1)


def test_exchange_finds_words_that_stand_alike():
    rng = np.random.default_rng(2)
    pairs = np.zeros((12, 12))
    for _ in range(4000):  # even words are followed by odd ones, and odd ones by even ones
        a, b = rng.integers(0, 5, 2)
        pairs[2 * a, 2 * b + 1] += 1
        pairs[2 * b + 1, 2 * rng.integers(0, 5)] += 1
    of = brown.exchange(pairs, 10, 2)
    assert len({*of[0:10:2]}) == 1 and len({*of[1:10:2]}) == 1 and of[0] != of[1]


def test_rare_words_get_classes_by_their_neighbours(spark):
    """Two kinds of words of one length, most types seen a few times only, next to different words."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x, y = (f"{k}{rng.integers(100, 400) if rng.random() < 0.7 else ''}" for k in "xy")
        rows.append((i, f"the {x} runs on a {y} of"))
    train = spark.createDataFrame(rows, "doc_id long, text string")
    counts, model = brown.word_counts(train).cache(), brown.fit(train, 8, 7, 4)
    assert set(model.known) == {b"the", b"runs", b"on", b"a", b"of", b"x", b"y", b"\n"} and model.types == counts.count()
    kind = {r.word: r.k for r in counts.join(model.rare, "h").collect()}
    assert len(kind) == model.types - 8 and model.table.sum() == model.tokens == 600 * 8
    first, second = ({k for w, k in kind.items() if w[0] == x and w[1:].isdigit()} for x in "xy")
    assert not first & second and len(first) <= 3 and len(second) <= 3


def test_classes_grow_with_the_words(spark):
    train = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', id * 50, id * 50 + 1, 'a', id * 7 % 6000) as text")
    model = brown.fit(train, 100_000, 10, 2)
    assert model.classes == math.ceil(model.types**0.25) > 2 and len(model.known) == model.types


def plain_model(model, hashes, train):
    """Tables by loops over all tokens: classes as the model has them, everything else counted anew."""
    rare = {r.h: (r.n, r.k) for r in model.rare.collect()}
    counts = Counter(t for x in train for t in plain_tokens(x))
    name = lambda t: b"\n" if t == "<end>" else t.encode()
    of = {t: int(model.k[model.known[name(t)]]) if name(t) in model.known else rare[hashes[t]][1] for t in counts}
    assert all(rare[hashes[t]][0] == n for t, n in counts.items() if name(t) not in model.known)
    history = lambda t: of[t] if name(t) in model.known else model.classes + 1
    open_class = lambda t: model.classes + 1 + min((len(name(t)) - 1) // 2, 7)
    pairs, once = Counter(), Counter(open_class(t) for t, n in counts.items() if n == 1)
    for x in train:
        own = plain_tokens(x)
        for a, b in zip(["<end>", *own], own, strict=False):
            pairs[history(a), of[b]] += 1
    total, cols = sum(pairs.values()), model.classes + 1
    row, col = Counter(), Counter()
    for (a, b), n in pairs.items():
        row[a] += n
        col[b] += n
    for k, n in once.items():
        for a in list(row):
            pairs[a, k] += row[a] / total * n
        col[k] += n
    row = {a: sum(n for (x, _), n in pairs.items() if x == a) for a in range(cols + 1)}
    size, types = Counter(of[t] for t in counts.elements()), Counter(of.values())

    def score(text):
        out, before = 0.0, model.classes
        for t in plain_tokens(text):
            k = of.get(t, open_class(t))
            single = (col[k] + 1) / (sum(col.values()) + cols + 8)
            p = (pairs[before, k] + 10 * single) / (row[before] + 10)
            out += math.log10(p * (counts[t] + 1) / (size[k] + types[k] + once.get(k, 0) + 1))
            before = history(t) if t in of else model.classes + 1
        return out

    return score


def test_scores_are_those_of_a_plain_class_model(spark):
    docs = spark.read.parquet(SF).where("doc_id % 7 = 1")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = docs.where("crc32(cast(doc_id as string)) % 7 <> 2")
    model = brown.fit(train, 300, 60, 6)
    hashes = {r.word: r.h for r in brown.word_counts(train).collect()}
    score = plain_model(model, hashes, [x for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r.doc_id: r.score for r in brown.score_texts(docs, 300, 60, 6).collect()}
    assert len(got) == len(rows) and all(abs(got[i] - score(x)) < 1e-6 * max(1, abs(got[i])) for i, x in rows)
