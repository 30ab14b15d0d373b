"""Archetypal analysis against its conditions, pruning against numpy."""

import numpy as np
import pytest

from cellweave.operators import archetypes as A


def table(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(more), "id long, x array<double>")


def test_corners_of_a_hull_are_found(spark):
    r = np.random.default_rng(5)
    corners = r.normal(size=(4, 6)) * 5
    x = np.concatenate([corners, r.dirichlet(np.ones(4), 120) @ corners])
    support, w, trace = A.archetypal_analysis(table(spark, x, [(-1, None), (-2, [1.0, None] + [0.0] * 4)]), 4)
    assert trace[-1] <= 1e-5 * (x * x).sum()
    near = np.linalg.norm(w.T[:, None] - corners[None], axis=2)
    assert sorted(near.argmin(1)) == [0, 1, 2, 3] and near.min(1).max() < 0.05
    assert {r["archetype"] for r in support.collect()} == {0, 1, 2, 3}


def test_noisy_points_meet_the_conditions(spark):
    r = np.random.default_rng(6)
    x = r.dirichlet(np.ones(3) * 0.6, 150) @ (r.normal(size=(3, 5)) * 4) + 0.4 * r.normal(size=(150, 5))
    support, w, trace = A.archetypal_analysis(table(spark, x), 3)
    assert all(b <= a * (1 + 1e-7) for a, b in zip(trace, trace[1:]))
    c = np.zeros((150, 3))
    for s in support.collect():
        c[s["id"], s["archetype"]] = s["weight"]
    assert (c >= 0).all() and c.sum(0) == pytest.approx(np.ones(3)) and x.T @ c == pytest.approx(w, abs=1e-6)
    h = A.simplex_weights(w, x)
    assert trace[-1] == pytest.approx(((x - h @ w.T) ** 2).sum(), rel=1e-6)
    # no point as part of an archetype would lower the residual by much: the duality gap is small
    slope = x @ (w @ (h.T @ h) - x.T @ h)
    assert ((c * slope).sum(0) - slope.min(0)).sum() <= 1e-4 * (x * x).sum()
    # and it is no worse than the reference scheme, archetype by archetype over all points
    v, least = x[np.linalg.norm(x, axis=1).argsort()[-3:]].T.copy(), np.inf
    for _ in range(60):
        g = A.simplex_weights(v, x)
        for i in range(3):
            goal = v[:, i] + (x - g @ v.T).T @ g[:, i] / max(g[:, i] @ g[:, i], 1e-8)
            v[:, i] = x.T @ A.simplex_weights(x.T, goal[None], 1e-7)[0]
        least = min(least, ((x - A.simplex_weights(v, x) @ v.T) ** 2).sum())
    assert trace[-1] <= 1.02 * least


def test_few_points(spark):
    same = np.ones((5, 3))
    support, w, trace = A.archetypal_analysis(table(spark, same), 3)
    assert w.shape == (3, 1) and trace[-1] == pytest.approx(0, abs=1e-9) and support.count() >= 1
    assert A.archetypal_analysis(table(spark, same).limit(0), 2)[1].size == 0


def test_pruning_equals_numpy(spark):
    r = np.random.default_rng(7)
    h = np.concatenate([r.dirichlet(np.ones(k) * 0.4, 80) for k in (2, 3, 4)], axis=1)
    h[:, 5] = r.permutation(h[:, 5])
    supports = [(j, int(i), float(v)) for j in range(9) for i, v in zip(np.r_[h[:, j].argsort()[-(j % 4 + 1) :], [j]] if j != 4 else [0, 1, 2], r.random(j % 4 + 2) if j != 4 else [0.2] * 3)]
    supports = list({(j, i): (j, i, v) for j, i, v in supports}.values())
    got = {x["archetype"]: x for x in A.prune_archetypes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(h)], "id long, h array<double>"), spark.createDataFrame(supports, "archetype int, id long, weight double"), min_z=-1.0).collect()}
    b = np.maximum(np.corrcoef(h.T), 0) - np.eye(9)
    b = np.where(b > 1e-12, b, 0)
    mask = (b > 0).astype(float)
    value = np.full(9, np.nan)
    for k in range(9):
        if mask[k].sum() > 1:
            value[k] = sum((b[k, i] + b[k, j]) / 2 for i in range(9) for j in range(9) if b[i, k] * b[k, j] * b[j, i] > 0) / (b[k].sum() * (mask[k].sum() - 1))
    z = np.nan_to_num((value - np.nanmean(value)) / np.nanstd(value, ddof=1))
    for j in range(9):
        own = [(i, v) for a, i, v in supports if a == j]
        marks = sorted((-v, i) for i, v in own if h[:, j].max() - h[i, j] < 1e-3)
        assert got[j]["landmark"] == (marks[0][1] if marks else None) and got[j]["cells"] == len(own)
        assert got[j]["z"] == pytest.approx(z[j], abs=1e-9)
        assert got[j]["kept"] == (z[j] >= -1 and bool(marks) and len(own) >= 3)
