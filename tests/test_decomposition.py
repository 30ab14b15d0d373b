"""Decompositions against dense solves."""

import numpy as np
import pytest

from cellweave.operators import decomposition as D


def entries_of(spark, a):
    i, j = np.nonzero(a)
    rows = [(f"r{x:03d}", int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)]
    return spark.createDataFrame(rows, "row string, col long, x double")


def arrays(df, name):
    return np.array([r[name] for r in sorted(df.collect(), key=lambda r: r["id"])])


@pytest.fixture(scope="module")
def sparse():
    r = np.random.default_rng(2)
    a = r.poisson(r.gamma(0.4, 1.2, (40, 1)) * r.gamma(0.7, 1.0, (1, 60)) * 1.5).astype(float)
    a[:, 0] += 1
    a[0] += 1
    return a[a.sum(1) > 0][:, a.sum(0) > 0]


def test_singular_values_equal_a_dense_solve(spark, sparse):
    u, s, v = D.truncated_svd(entries_of(spark, sparse), 5)
    want = np.linalg.svd(sparse, compute_uv=False)[:5]
    assert s == pytest.approx(want, rel=1e-6)
    u, v = arrays(u, "u"), arrays(v, "v")
    assert u.T @ u == pytest.approx(np.eye(5), abs=1e-6) and v.T @ v == pytest.approx(np.eye(5), abs=1e-6)
    left, _, right = np.linalg.svd(sparse, full_matrices=False)
    assert u * s @ v.T == pytest.approx(left[:, :5] * want @ right[:5], abs=1e-4 * want[0])


def test_svd_past_the_rank_and_of_nothing(spark):
    a = np.outer([1.0, 2, 0, 3], [1.0, 0, 2])
    _, s, _ = D.truncated_svd(entries_of(spark, a), 3)
    assert s == pytest.approx([np.linalg.norm(a), 0], abs=1e-7)  # it has two columns with entries
    assert len(D.truncated_svd(entries_of(spark, a).limit(0), 3)[1]) == 0


def test_reduced_kernel_equals_the_dense_update(spark, sparse):
    u, s, v = D.reduced_kernel(entries_of(spark, sparse), 6)
    mu = sparse.mean(1)
    a1 = mu / np.linalg.norm(mu)
    b1 = -sparse.T @ a1
    b2 = -(a1.mean() * b1 + sparse.mean(0))
    # the update of the table's best approximation of that rank
    left, values, right = np.linalg.svd(sparse, full_matrices=False)
    best = left[:, :6] * values[:6] @ right[:6] + np.outer(a1, b1) + np.outer(np.ones(len(a1)), b2)
    want_u, want, want_v = np.linalg.svd(best, full_matrices=False)
    assert s == pytest.approx(want[:6], rel=1e-5)
    u, v = arrays(u, "u"), arrays(v, "v")
    assert u * s @ v.T == pytest.approx(want_u[:, :6] * want[:6] @ want_v[:6], abs=1e-4 * want[0])


def test_simplex_regression_meets_its_conditions(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(6, 4))
    b = np.concatenate([r.dirichlet(np.ones(4) * 0.3, 40) @ a.T + 0.3 * r.normal(size=(40, 6)), 9 * r.normal(size=(40, 6))])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)] + [(-1, None)], "id long, x array<double>")
    h = arrays(D.simplex_regression(table, a, 1e-12), "h")
    assert len(h) == 80 and (h >= 0).all() and h.sum(1) == pytest.approx(np.ones(80))
    slope = (h @ a.T - b) @ a
    # where a weight is positive its slope is the least, elsewhere no less
    least = slope.min(1, keepdims=True)
    assert (np.where(h > 1e-4, slope - least, 0) < 1e-4).all()
    draws = r.dirichlet(np.ones(4) * 0.5, 3000)
    assert (((h @ a.T - b) ** 2).sum(1) <= ((draws @ a.T)[None] - b[:, None]).__pow__(2).sum(2).min(1) + 1e-9).all()


def test_successive_projection_finds_the_corners(spark):
    r = np.random.default_rng(4)
    corners = r.normal(size=(3, 7))
    x = np.concatenate([corners, r.dirichlet(np.ones(3), 50) @ corners])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = D.successive_projection(table, 5)
    assert {i for i, _ in got} == {0, 1, 2}
    left = x.copy()
    for i, residual in got:
        assert residual == pytest.approx((left**2).sum(1).max()) and (left[i] ** 2).sum() == pytest.approx(residual)
        u = left[i] / np.linalg.norm(left[i])
        left = left - np.outer(left @ u, u)
