import numpy as np
import pandas as pd

from sievemark.llm import near_vectors


def plain(rows, cosine=0.98):
    units = []
    for _, e, label in rows:
        v = None if e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or not any(e) else np.array(e, float)
        units.append(None if v is None else v / np.linalg.norm(v))
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)), key=lambda x: rows[x][0])
                up[b] = a
    return sorted((rows[i][0], links[i], rows[root(i)][0], rows[root(i)][0] == rows[i][0]) for i in range(len(rows)))


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    rows = [(i, None if e is None else [x if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]
    assert sorted(tuple(r) for r in near_vectors.link_vectors(docs, **options).collect()) == plain(rows)


def _cloud(seed, n, size=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, size))
    near = [base[k % len(base)] + rng.normal(size=size) * rng.choice([0.02, 0.15, 0.2, 0.3]) for k in range(n)]
    chain = [base[0] + 0.5 * k * base[1] / 5 for k in range(12)]
    return [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate([*base, *near, *chain])]


def test_links_are_those_of_all_pairs(spark):
    rows = _cloud(1, 150)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [float("nan")] * 64, 0), (2003, [1.0, None], 0), (2004, [float("inf"), 1.0], 0), (2005, rows[5][1], None), (2006, [2 * x for x in rows[5][1]], rows[5][2]), (2007, [], 0), (2008, [3.0], 1), (2009, [4.0], 1), (2010, [1e-30, 0.0], 0), (2011, [1e30, 1e28], 0)]
    check(spark, rows)


def test_links_over_many_blocks_and_strips(spark):
    check(spark, _cloud(2, 200), block=16, pool=50)


def test_no_vectors(spark):
    assert near_vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = _cloud(3, 30)
    plain_rows = [r for r in rows if r[2] == 0]
    again = [(r[0], r[1], 0) for r in plain_rows[:5]] + [(None, plain_rows[0][1], 0), (None, [float(x) for x in np.eye(64)[3]], 0), (None, None, 0)]
    docs = spark.createDataFrame(plain_rows + again, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in near_vectors.link_vectors(docs).collect()]
    want = {r[0]: r for r in plain([(k, *r[1:]) for k, r in enumerate(plain_rows + again)])}
    ids = [r[0] for r in plain_rows + again]
    named = lambda k: min((ids[x] for x in want if want[x][2] == want[k][2] and ids[x] is not None), default=None)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    assert sorted(got, key=key) == sorted(((ids[k], want[k][1], named(k), named(k) == ids[k]) for k in range(len(ids))), key=key)


def test_pairs_at_the_threshold_are_found():
    """Of pairs at the threshold all are found, and of unrelated ones few are even counted."""
    rng = np.random.default_rng(4)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.9801 * u + np.sqrt(1 - 0.9801**2) * w
    depth, tables = near_vectors.bucket_plan(2000, 64, 0.98, 0.9999999)
    a, b = (near_vectors.buckets_of(x, depth, tables, 0.98) for x in (u, v))
    assert (a == b).any(axis=1).all()
    assert (a == np.roll(b, 1, axis=0)).any(axis=1).mean() < 0.02
    rows = pd.DataFrame({"id": range(4000), "unit": [x.tobytes() for x in (*u, *v)], "buckets": [x.tobytes() for x in (*a, *b)]})
    rows = rows.assign(n=1, label="x", table=0, bucket=0, i=0, j=0, block=0)
    found = near_vectors._verify(rows, 0.98, 0.9999999)
    assert {tuple(sorted(x)) for x in found[found.a != found.b][["a", "b"]].to_numpy().tolist()} == {(i, i + 2000) for i in range(2000)}
