"""Ensemble bins, network enhancement, limits of diffusion and adjusted p against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import bins, graph
from cellweave.operators import network as N

EDGE = "celltype string, condition string, gene1 long, gene2 long, lls double"


@pytest.mark.parametrize("n_bins", [1, 4, 10])
def test_bins_equal_sorting(spark, n_bins):
    r = np.random.default_rng(6)
    groups = {"a": (r.gamma(1, 3, 300) + 1e6, 300), "b": (r.integers(0, 4, 90).astype(float), 130), "c": (np.array([-2.0, 5.0]), 9), "d": (np.array([7.0]), 1), "e": (np.full(500, 3.0), 700)}
    rows = [(g, "f", float(v)) for g, (x, _) in groups.items() for v in x]
    table = spark.createDataFrame([*rows, ("c", "f", None)], "g string, feature string, value double")
    sizes = spark.createDataFrame([(g, n) for g, (_, n) in groups.items()], "g string, size long")
    got = {(x["g"], x["bin"]): x for x in bins.ensemble_bins(table, ["g", "feature"], sizes, n_bins, 0.5).collect()}
    assert len(got) == len(groups) * n_bins
    for g, (x, n) in groups.items():
        full = np.sort(np.concatenate([x, np.zeros(n - len(x))]))
        for b, at in enumerate(np.linspace(1, (1 - 1 / n_bins) * n, n_bins) if n_bins > 1 else [1], 1):
            cut = max(1, round(at))
            top, own = full[cut - 1 :], got[g, b]
            assert own["above"] == pytest.approx(full[cut:].sum() + 0.5, rel=1e-9, abs=1e-6) and own["mean"] == pytest.approx(top.mean(), rel=1e-9, abs=1e-9)
            assert own["variance"] == pytest.approx(top.var(ddof=1) if len(top) > 1 else 0, rel=1e-6, abs=1e-6)


@pytest.fixture(scope="module")
def net(spark):
    r = np.random.default_rng(8)
    return spark.createDataFrame([(c, "x", a, b, float(r.integers(1, 6))) for c in "pq" for a in range(25) for b in range(a + 1, 25) if r.random() < 0.15], EDGE).cache()


def matrices(net):
    out = {}
    for r in net.collect():
        a = out.setdefault(r["celltype"], np.zeros((25, 25)))
        a[r["gene1"], r["gene2"]] = a[r["gene2"], r["gene1"]] = r["lls"]
    return out


@pytest.mark.parametrize("root", [False, True])
def test_enhancement_is_the_matrix_product(net, root):
    got = {(r["celltype"], r["gene1"], r["gene2"]): r["weight"] for r in graph.enhanced(net, root).collect()}
    for c, a in matrices(net).items():
        p = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
        d = np.sqrt(p.sum(0) + 1e-16)
        w = p * d if root else p / d
        want = w @ w.T
        assert all(got.get((c, i, j), 0.0) == pytest.approx(want[i, j]) for i in range(25) for j in range(i + 1, 25))
    few = {(r["celltype"], r["gene1"], r["gene2"]): r["weight"] for r in graph.enhanced(net, root, most=2).collect()}
    assert len(few) < len(got) and all(x <= got[k] + 1e-12 for k, x in few.items())


def test_limit_of_diffusion_solves_the_system(spark, net):
    seeds = spark.createDataFrame([("p", "x", 0, 0.5), ("p", "x", 7, 0.5), ("q", "x", 3, 1.0), ("q", "x", 99, 1.0)], "celltype string, condition string, gene long, x0 double")
    got = {(r["celltype"], r["gene"]): r["x"] for r in graph.diffusion_limit(net, seeds).collect()}
    for c, a in matrices(net).items():
        x0 = np.zeros(25)
        x0[[0, 7] if c == "p" else [3]] = 0.5 if c == "p" else 1
        seen = np.flatnonzero(a.sum(0))
        p = a[np.ix_(seen, seen)] / a[np.ix_(seen, seen)].sum(0)
        x = np.linalg.solve(np.eye(len(seen)) - 0.85 * p, 0.15 * x0[seen])
        assert [got[c, int(i)] for i in seen] == pytest.approx(x.tolist(), abs=1e-9)
        far = x0[seen]  # rounds of diffusion until nothing moves
        for _ in range(300):
            far = 0.85 * p @ far + 0.15 * x0[seen]
        assert [got[c, int(i)] for i in seen] == pytest.approx(far.tolist(), abs=1e-9)
        assert np.abs(0.85 * p @ [got[c, int(i)] for i in seen] + 0.15 * x0[seen] - x).max() < 1e-8
    assert graph.diffusion_limit(net.limit(0), seeds).count() == 0


def test_by_of_many_genes(spark):
    n = 3000
    rows = spark.range(n).select(F.lit("c").alias("celltype"), F.lit("x").alias("condition"), F.col("id").alias("gene"), ((F.col("id") + 1) / (2 * n)).alias("p"))
    got = N.p_adjust(rows, "p", N.NET, ["gene"], ["by"]).agg(F.min("p_by"), F.max("p_by")).first()
    assert list(got) == pytest.approx([min(1, 0.5 * sum(1 / i for i in range(1, n + 1)))] * 2)
