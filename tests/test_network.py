"""Operators on hand-sized networks, and a round trip of the sources."""

import pytest

from cellweave.operators import expression, graph, hubs, paths
from cellweave.operators import network as N
from cellweave.sources import networks as S


@pytest.fixture()
def net(spark):
    rows = [("t", "F", 1, 2, 2.0, 1.0), ("t", "F", 2, 3, 3.0, 1.0), ("t", "F", 1, 3, 4.0, 1.0), ("t", "F", 3, 4, 5.0, 1.0), ("t", "F", 8, 9, 1.0, 1.0)]
    return spark.createDataFrame(rows, "celltype string, condition string, gene1 long, gene2 long, lls double, scinet_weight double")


def test_canonical_drops_loops_and_repeats(spark):
    e = spark.createDataFrame([("t", "F", "b", "a", 1.0), ("t", "F", "a", "b", 3.0), ("t", "F", "c", "c", 9.0)], "celltype string, condition string, gene1 string, gene2 string, scinet_weight double")
    assert [tuple(r) for r in N.canonical(e).collect()] == [("t", "F", "a", "b", 3.0)]


def test_strength_and_rank(net):
    got = {r["gene"]: (r["value"], r["pr"]) for r in N.percent_rank(N.strength(net)).collect()}
    assert got[3] == (12.0, 1.0) and got[1][0] == 6.0 and got[8] == got[9] == (1.0, 0.0)


def test_ribosomal_prefixes(spark):
    c = spark.createDataFrame([("RPS6",), ("RPLP0",), ("MRPL1",), ("NDUFA1",), ("GRPS",)], "gene string")
    assert [r[0] for r in N.drop_ribosomal(c).collect()] == ["GRPS"]


def test_ribosomal_genes_go_before_the_ranks(spark):
    c = spark.createDataFrame([("c", "x", "RPS1", 9.0), ("c", "x", "A", 1.0), ("c", "x", "B", 2.0)], "celltype string, condition string, gene string, value double")
    assert {r["gene"]: r["pr"] for r in N.percent_rank(N.drop_ribosomal(c)).collect()} == {"A": 0.0, "B": 1.0}


def test_components_and_cores(net):
    got = {r["gene"]: r["component"] for r in graph.components(net).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    core = {r["gene"]: r["core"] for r in graph.core_numbers(net).collect()}
    assert core == {1: 2, 2: 2, 3: 2, 4: 1, 8: 1, 9: 1}


def test_null_is_reproducible_and_p_in_range(net):
    a = hubs.find_all_hub(net, reps=5, seed=3).collect()
    b = hubs.find_all_hub(net.repartition(7), reps=5, seed=3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(0 < r["p"] <= 1 and r["q"] >= r["p"] - 1e-12 for r in a)


def test_null_size_is_derived_from_the_nodes(net):
    nodes = {tuple(r[:2]): r["n"] for r in N.endpoints(net).distinct().groupBy(*N.NET).count().toDF(*N.NET, "n").collect()}
    got = {tuple(r[:2]): r["reps"] for r in hubs.rewired(net, None, 0.5, 1, values=1000).groupBy(*N.NET).agg({"rep": "max"}).toDF(*N.NET, "reps").collect()}
    assert got == {k: -(-1000 // n) for k, n in nodes.items()}


def test_round_trip(spark, net, tmp_path):
    S.write_bundle({"net": net}, str(tmp_path / "b"))
    assert S.read_bundle(spark, str(tmp_path / "b"), ["net"])["net"].count() == 5


def test_filter_cascade_runs_to_its_end(spark):
    # each cell falls only after the one before it: 24 rounds, and nothing stays
    counts = spark.createDataFrame([(c, f, 1.0) for c in range(24) for f in (c, c + 1)], "cell_id long, feature long, value double").coalesce(1)
    assert expression.qc_filter(counts, 2, 2, 0.0).count() == 0


def test_eigenvector_converges_where_rounds_are_few(spark):
    import numpy as np

    n = 12
    a = np.zeros((n, n))
    for i in range(n - 1):
        a[i, i + 1] = a[i + 1, i] = 1
    net = spark.createDataFrame([("c", "x", i, i + 1, 1.0) for i in range(n - 1)], "celltype string, condition string, gene1 long, gene2 long, lls double").coalesce(1)
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r["gene"]: r["value"] for r in paths.eigenvector(net, tolerance=1e-4).collect()}
    assert [got[i] for i in range(n)] == pytest.approx((v / v.max()).tolist(), abs=5e-3)
