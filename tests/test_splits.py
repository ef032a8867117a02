"""Exact splits against a plain walk over all states."""

import random
import time
import tracemalloc

from sievemark.operators import splits


def plain(sizes, val, test):
    """The first way to each state, trying train, val, test over states in the order in which they were met."""
    states = {(0, 0): ()}
    for size in sizes:
        met = {}
        for (v, t), way in states.items():
            for split, new in (("train", (v, t)), ("val", (v + size, t)), ("test", (v, t + size))):
                if new[0] <= val and new[1] <= test:
                    met.setdefault(new, (*way, split))
        states = met
    return list(states[val, test]) if (val, test) in states else None


def test_choices_are_those_of_the_plain_walk():
    rng = random.Random(8)
    none = 0
    for _ in range(1500):
        sizes = [rng.choice((1, 1, 2, 3, rng.randint(1, 9))) for _ in range(rng.randint(0, 14))]
        val, test = rng.randint(0, 9), rng.randint(0, 9)
        want = plain(sizes, val, test)
        assert splits.exact_choice(sizes, val, test) == want
        none += want is None
    assert 200 < none < 1300


def test_many_components_in_little_memory():
    rng = random.Random(9)
    sizes = [rng.randint(1, 6) for _ in range(4000)]
    val = test = sum(sizes) // 10
    tracemalloc.start()
    chosen = splits.exact_choice(sizes, val, test)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [sum(s for s, c in zip(sizes, chosen, strict=True) if c == part) for part in ("val", "test")] == [val, test]
    assert most < 3 * 64 * val * test / 8


def test_audit_tells_torn_and_spread_components(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), ("a", "3", "y"), ("b", "4", "y"), ("b", "5", "z")], "model string, group_id string, component_id string")
    assigned = spark.createDataFrame([("a", "x", "train"), ("a", "x", "val"), ("a", "y", "test"), ("b", "y", "train")], "model string, component_id string, split string")
    got = {r.model: (r.torn, r.spread) for r in splits.split_audit(rows, assigned).collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}


def test_choices_among_large_components_or_odd_sizes():
    rng = random.Random(10)
    for _ in range(400):
        pool = rng.choice([(1, 2, 5, 9), (4, 6, 10), (3, 7), (1, 8), (1, 20, 2), (1, 1, 1, 2, 3, 4)])
        sizes = [rng.choice(pool) for _ in range(rng.randint(0, 24))]
        val, test = rng.randint(0, 14), rng.randint(0, 14)
        assert splits.exact_choice(sizes, val, test) == plain(sizes, val, test)


def test_work_is_the_number_of_components():
    """Of 100,000, whose sums of val and test would be a billion pairs."""
    rng = random.Random(11)
    sizes = [rng.choice((1, 1, 2, 3, 4, 8)) for _ in range(100_000)]
    val = test = sum(sizes) // 10
    start = time.process_time()
    chosen = splits.exact_choice(sizes, val, test)
    assert time.process_time() - start < 20
    assert [sum(s for s, c in zip(sizes, chosen, strict=True) if c == part) for part in ("val", "test")] == [val, test]
