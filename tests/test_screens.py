"""Screening, null tests and annotation on hand-sized tables."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cellweave.operators import expression, graph, nulls, screening, statistics

EDGE = "celltype string, condition string, gene1 long, gene2 long, lls double"


@pytest.fixture()
def two_cliques(spark):
    """Genes 1-4 all joined, 11-14 likewise, and a bridge."""
    pairs = [(a + k, b + k) for k in (0, 10) for a in range(1, 5) for b in range(a + 1, 5)] + [(4, 11)]
    return spark.createDataFrame([("t", "F", a, b, float(a + b)) for a, b in pairs], EDGE)


def test_inverse_normal_equals_the_library(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(screening.inverse_normal(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-12)


def test_drop_constant(spark):
    rows = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, None)], "i int, same string, lost string, half string")
    assert screening.drop_constant(rows).columns == ["i", "half"]
    assert screening.drop_constant(rows.where("i > 5")).columns == rows.columns


def test_networks_have_ends_and_a_weight(two_cliques):
    assert screening.is_network(two_cliques) and not screening.is_network(two_cliques.drop("lls")) and not screening.is_network(two_cliques.drop("gene1"))


def test_translate_takes_the_first_name(spark):
    rows = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "gene string")
    names = spark.createDataFrame([("e1", "B", 2), ("e1", "A", 1), ("e2", None, 1)], "id string, name string, position int")
    assert sorted(r[0] for r in screening.translate(rows, "gene", names).collect()) == ["", "", "A"]


def test_top_features_leave_out_the_blacklist(spark):
    rows = spark.createDataFrame([("t", g, s) for g, s in (("RPL3", 9.0), ("MT-CO1", 8.0), ("AC1.2", 7.0), ("CD4", 5.0), ("CD8A", 5.0), ("IL2", 1.0))], "celltype string, feature string, score double")
    assert [(r["feature"], r["rank"]) for r in screening.top_features(rows, "celltype", "score", 2).orderBy("rank").collect()] == [("CD4", 1), ("CD8A", 2)]


def test_qc_by_group_drops_everywhere_what_one_group_drops(spark):
    counts = spark.createDataFrame([(c, f, 1.0) for c, fs in ((1, "ab"), (2, "ab"), (3, "a"), (4, "a")) for f in fs], "cell_id int, feature string, value double")
    cells = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "cell_id int, g string")
    got = screening.qc_by_group(counts, cells, "g", min_cells=2, min_features=1, min_umis=1)
    assert sorted(tuple(r) for r in got.collect()) == [(i, "a", 1.0) for i in (1, 2, 3, 4)]


def test_degree_pools_equal_a_scan(two_cliques):
    pools = {r["gene"]: r for r in nulls.degree_pools(two_cliques).collect()}
    for r in pools.values():
        near = [x["pos"] for x in pools.values() if int(0.8 * r["degree"]) <= x["degree"] <= -int(-1.2 * r["degree"] // 1)]
        assert (r["low"], r["pool"]) == (min(near), len(near))


def test_connectivity_of_a_clique_is_rare_and_draws_repeat(spark, two_cliques):
    clique = spark.createDataFrame([(g,) for g in (1, 2, 3, 99)], "gene long")
    first, again = (nulls.connectivity_test(two_cliques, clique, sims=500).collect() for _ in range(2))
    assert first == again
    (r,) = first
    # a triangle has the most edges three genes can have, so nothing is above it
    assert (r["detected"], r["connectivity"], r["p"]) == (3, 3, 1 / 500)
    apart = spark.createDataFrame([(1,), (12,)], "gene long")
    (r,) = nulls.connectivity_test(two_cliques, apart, sims=500).collect()
    assert r["connectivity"] == 0 and 0.3 < r["p"] < 0.7
    whole = two_cliques.select(F.explode(F.array("gene1", "gene2")).alias("gene")).distinct()
    (r,) = nulls.connectivity_test(two_cliques, whole, sims=50).collect()
    assert (r["detected"], r["connectivity"]) == (8, 13)
    assert nulls.connectivity_test(two_cliques, clique.where("gene > 99"), sims=5).count() == 0


def test_weight_hubs_and_autocorrelation_of_sides(spark, two_cliques):
    hubs = nulls.weight_hubs(two_cliques, reps=20).collect()
    assert len(hubs) == 8 and all(0 < r["p"] <= 1 and r["q"] >= r["p"] for r in hubs)
    side = two_cliques.select("celltype", "condition", F.explode(F.array("gene1", "gene2")).alias("gene")).distinct().withColumn("x", (F.col("gene") > 10).cast("double"))
    (r,) = nulls.autocorrelation_z(two_cliques, side, reps=50).collect()
    assert r["z"] > 1


def test_core_centrality_within_groups(spark, two_cliques):
    groups = spark.createDataFrame([("t", "F", g, "a" if g < 10 else "b") for g in (1, 2, 3, 4, 11, 12, 13, 14)], "celltype string, condition string, gene long, label string")
    assert {(r["core"], r["z"]) for r in graph.core_centrality(two_cliques, groups).collect()} == {(3, 3.0)}
    alone = groups.withColumn("label", F.col("gene").cast("string"))
    assert {(r["core"], r["z"]) for r in graph.core_centrality(two_cliques, alone).collect()} == {(0, 0.0)}


def test_renormalize_brings_cells_to_one_scale(spark):
    counts = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 10.0), (2, "b", 20.0)], "cell_id int, feature string, value double")
    cells = spark.createDataFrame([(1, "x"), (2, "x")], "cell_id int, g string")
    got = {(r["cell_id"], r["feature"]): r["value"] for r in expression.renormalize(counts, cells, "g").collect()}
    assert got[1, "a"] == pytest.approx(got[2, "a"]) == pytest.approx(5.5)


def test_annotate_clusters(spark):
    rows = spark.createDataFrame([(1, "T")] * 8 + [(1, "B")] + [(2, "B")] * 5 + [(2, "T")], "cluster int, label string")
    assert {(r["cluster"], r["label"]) for r in statistics.annotate_clusters(rows, "cluster", "label").collect()} == {(1, "T"), (2, "B")}
