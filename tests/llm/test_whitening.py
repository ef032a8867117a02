import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from sievemark.llm import whitening

SF = "/root/testdata/sf0.001/embeddings.parquet"


def plain(rows, components=4):
    """Key and x of the usable rows, and the numbers of the contract, by numpy's own eigenvectors."""
    x = {k: tuple(math.floor(256 * float(c)) for c in v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(x.values())), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], values.sum()


def test_all_embeddings_against_plain_numpy(spark):
    t = pq.read_table(SF).to_pydict()
    x, n, sums, values, vectors, trace = plain(zip(t["vec_id"], t["embedding"], strict=True))
    rows = whitening.whiten(spark.read.parquet(SF)).collect()
    assert len(rows) == 4 * len(x) and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    signs = {}
    for r in rows:
        own = np.array(x[r.vec_id], object)
        assert r.deviation == int(((n * own - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        want = float((own - sums / n).astype(float) @ vectors[:, r.component - 1]) / math.sqrt(values[r.component - 1])
        sign = signs.setdefault(r.component, math.copysign(1, want * r.whitened)) if abs(want) > 1e-3 else signs.get(r.component)
        assert abs(r.whitened - (sign or 1) * want) < 1e-8 or sign is None


def test_jacobi_is_accurate_for_small_eigenvalues():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 16):
        g = rng.normal(size=(d, d))
        a = g @ g.T
        values, vectors = whitening.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10, atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(1, values[0]))
    # Scales of 1 and 1e-8 with a known spectrum: D H D with H well conditioned keeps small eigenvalues to all digits.
    scale = np.diag([1.0, 1e-4, 1e-8])
    h = np.array([[2.0, 1, 0.5], [1, 2, 1], [0.5, 1, 2]])
    values, _ = whitening.jacobi(scale @ h @ scale)
    assert np.prod(values) == pytest.approx(np.linalg.det(h) * 1e-24, rel=1e-12) and values[2] > 0


def test_exact_products_of_any_size():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 26, 1 << 30):
        z = rng.integers(-most, most, (50, 3))
        z[0, 0] = most
        assert (whitening.exact_products(z) == z.astype(object).T @ z.astype(object)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, -0.3]), (2, [0.5, -0.25, 0.125]), (3, [0.9, 0.1, 0.2]), (3, [0.9, 0.1, 0.2]), (None, [-0.4, 0.7, 0.1]), (5, [0.0, -0.0, 0.0])]
    bad = [(6, None), (7, [0.1, None, 0.2]), (8, [nan, 0.0, 0.0]), (9, [0.0, inf, 0.0]), (10, [1.0, 2.0]), (11, []), (12, [1e30, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, key string, x int, n string, component string"
    df = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in good + bad], schema)
    rows = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == sorted((k or 0, c) for k, _ in good for c in (1, 2, 3))
    assert {r.n for r in rows} == {5} and rows[0].identity_error < 1e-9
    _, n, sums, values, vectors, trace = plain(good)
    for r in rows:
        own = np.array([math.floor(256 * c) for c in next(v for k, v in good if k == r.vec_id)], object)
        assert r.deviation == int(((n * own - sums) ** 2).sum())
        assert abs(r.whitened) == pytest.approx(abs(float((own - sums / n).astype(float) @ vectors[:, r.component - 1])) / math.sqrt(values[r.component - 1]), abs=1e-9)
    for some in (df.where("false"), df.where("vec_id = 3"), df.where("vec_id in (6, 11)")):
        out = whitening.whiten(some)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_dimensions_without_variance_have_no_component(spark):
    df = spark.createDataFrame([(i, [i * 0.5, 1.0, i * 1.0, float(i % 2)]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2} and rows[0].identity_error < 1e-9
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1)


def test_deviations_beyond_a_long_are_null():
    assert whitening.deviations(np.array([[1 << 30], [1]]), 1 << 10, [0]) == [None, 1 << 20]
