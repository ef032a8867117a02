import random

import numpy as np
import pyarrow as pa

from sievemark.llm import decontam


def words(rng, n):
    return [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("klmnp") + rng.choice("aeiou") + rng.choice("rst") for _ in range(n)]


def plain_align(item, text):
    best, above = 0.0, [0.0] * (len(text) + 1)
    for a in item:
        row = [0.0]
        for j, b in enumerate(text):
            row.append(max(0.0, above[j] + (decontam.MATCH if a == b else decontam.MISMATCH), above[j + 1] + decontam.GAP, row[j] + decontam.GAP))
            best = max(best, row[-1])
        above = row
    return best


def test_alignment_is_that_of_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64)
        assert abs(decontam.align(item, text)[0] - plain_align(item.tolist(), text.tolist())) < 1e-9


def _case(spark):
    rng = random.Random(5)
    items = [words(rng, n) for n in (30, 50, 12, 40)]
    edited = [w for i, w in enumerate(items[1]) if i % 9 != 4]
    edited[7] = "other"
    texts = {
        0: words(rng, 200),
        1: words(rng, 90) + items[0] + words(rng, 50),
        2: words(rng, 20) + edited + words(rng, 30),
        3: [w.upper() + "," for w in items[2]],
        4: items[0][:9] + words(rng, 100) + items[1][:12],
        5: words(rng, 9000) + items[3] + words(rng, 9000) + items[3] + items[1],
    }
    benchmark = spark.createDataFrame([*((i, " ".join(x), "c") for i, x in enumerate(items)), (8, None, "c"), (9, "", "c"), (10, "two words", "c"), (None, " ".join(words(rng, 20)), "c")], "item_id long, text string, score string")
    rows = [*((k, " ".join(v), "c") for k, v in texts.items()), (1, " ".join(texts[1]), "c"), (6, None, "c"), (7, "", "c"), (None, " ".join(items[0]), "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4), benchmark, rows


def test_copies_and_edited_copies_are_found_and_nothing_else(spark):
    docs, benchmark, rows = _case(spark)
    got = decontam.leaks(docs, benchmark).collect()
    found = sorted((str(r.doc_id), r.item_id) for r in got)
    assert found == sorted([("1", 0), ("1", 0), ("2", 1), ("3", 2), ("5", 3), ("5", 1), ("None", 0)])
    by = {(r.doc_id, r.item_id): r for r in got}
    assert (by[1, 0].first_word, by[1, 0].last_word, by[1, 0].score) == (90, 119, 1.0)
    assert by[5, 3].first_word == 9000 and 0.5 < by[2, 1].score < 1
    kept = decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4, 6, 7]


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, benchmark, _ = _case(spark)
    texts = pa.array([r.text for r in docs.collect()], pa.string())
    blocks = list(decontam.item_blocks(benchmark, 60))
    assert len(blocks) > 1
    key = lambda found: sorted((x.row, str(x.item_id), x.score, x.first_word) for x in found)
    whole = next(decontam.item_blocks(benchmark))
    assert key(x for b in blocks for x in decontam.find_leaks(texts, b)) == key(decontam.find_leaks(texts, whole))


def test_empty_tables(spark):
    docs, benchmark, rows = _case(spark)
    assert decontam.leaks(docs.where("false"), benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.where("false")).count() == 0
    assert decontam.without_leaks(docs, benchmark.where("false")).count() == len(rows)


def test_every_planted_passage_is_found(spark):
    """Against all pairs on the small table: an item that stands word for word in a document is a leak."""
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    flat = lambda x: " ".join(x.lower().replace(",", " ").replace(".", " ").split())
    texts, wanted = {r.doc_id: flat(r.text) for r in docs.collect()}, {r.item_id: flat(r.text) for r in items.collect()}
    plain = {(d, i) for d, t in texts.items() for i, x in wanted.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert plain and plain <= got and len(got - plain) <= 0.2 * len(plain)


def test_a_shared_context_and_short_items_are_found():
    rng = random.Random(8)
    context, items = words(rng, 200), []
    items = [" ".join([*context, *words(rng, 10)]) for _ in range(6)] + ["zzword", "qqpair rrpair", "漢字。"]
    texts = pa.array([" ".join([*words(rng, 50), *context, *words(rng, 50)]), "a zzword b", "rrpair qqpair", "x qqpair, rrpair", "qqpair rrpair", " ".join(words(rng, 300)), "漢字。", "zzword"], pa.string())
    want = {*((0, i) for i in range(6)), (1, 6), (3, 7), (4, 7), (6, 8), (7, 6)}
    found = decontam.find_leaks(texts, decontam.prepare(list(range(9)), items))
    assert {(x.row, x.item_id) for x in found} == want and len(found) == len(want)
    assert all(x.score > 0.9 for x in found)


def test_seeds_are_those_of_the_whole_benchmark(spark):
    rng = random.Random(9)
    context = words(rng, 60)
    rows = [(i, " ".join([*context, *words(rng, 12)])) for i in range(40)]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    seeds = lambda blocks: sorted((b.ids[i], int(h)) for b in blocks for h, i in zip(b.seeds, b.seed_item, strict=True))
    blocks = list(decontam.item_blocks(benchmark, 1000))
    assert len(blocks) > 1 and seeds(blocks) == seeds(decontam.item_blocks(benchmark))
