"""Diffusion, annotation, similarity and adaptive cuts on hand-sized tables."""

import math
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import expression, profiles
from cellweave.sources.networks import read_reference, save_graphml

EDGE = "celltype string, condition string, gene1 long, gene2 long, lls double"


@pytest.fixture()
def square(spark):
    """1-2-3-4-1 with a tail 4-5."""
    pairs = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (1, 4, 3.0), (4, 5, 1.0)]
    return spark.createDataFrame([("t", "F", a, b, w) for a, b, w in pairs], EDGE)


def matrix(square):
    a = np.zeros((5, 5))
    for r in square.collect():
        a[r.gene1 - 1, r.gene2 - 1] = a[r.gene2 - 1, r.gene1 - 1] = r.lls
    return a


def test_spread_equals_the_matrix_product(spark, square):
    rows = spark.createDataFrame([("t", "F", 1, "f", 3.0), ("t", "F", 2, "f", 1.0), ("t", "F", 99, "f", 5.0)], "celltype string, condition string, gene long, feature string, x double")
    got = {r.gene: r.x for r in profiles.spread(square, rows).collect()}
    a = matrix(square)
    x0 = x = np.array([0.75, 0.25, 0, 0, 0])
    for _ in range(5):
        x = 0.85 * (a / a.sum(0)) @ x + 0.15 * x0
    assert [got[i] for i in range(1, 6)] == pytest.approx(list(x))
    smooth = {r.gene: r.x for r in profiles.impute_by_diffusion(square, rows.where("gene < 99")).collect()}
    assert max(smooth.values()) == pytest.approx(3.0)


def test_rows_of_one_feature_are_not_dealt_to_one_task(spark):
    """2,000 genes in a row, one feature: a join by network and feature would put all rows into one partition."""
    net = spark.range(1, 2000).selectExpr("'t' AS celltype", "'F' AS condition", "id AS gene1", "id + 1 AS gene2", "1.0D AS lls")
    rows = spark.range(1, 2001).selectExpr("'t' AS celltype", "'F' AS condition", "id AS gene", "'f' AS feature", "CAST(id % 7 + 1 AS DOUBLE) AS x")
    conf, was = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(conf, "false")
    try:
        parts = [r["count"] for r in profiles.impute_by_diffusion(net, rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(conf, was)
    assert sum(parts) == 2000 and max(parts) < 1000


@pytest.mark.parametrize("few", [0, 100_000])
def test_imputation_by_either_join(spark, square, monkeypatch, few):
    """Features that meet their scale by a shuffle or in every task; a gene outside the network counts for the maximum only."""
    monkeypatch.setattr(profiles, "FEW", few)
    given = [(1, "f", 3.0), (2, "f", 1.0), (5, "g", 2.0), (4, "h", 0.0), (99, "f", 5.0), (99, "k", 1.0)]
    rows = spark.createDataFrame([("t", "F", g, f, x) for g, f, x in given], "celltype string, condition string, gene long, feature string, x double")
    got = {(r.feature, r.gene): r.x for r in profiles.impute_by_diffusion(square, rows).collect()}
    a, want = matrix(square), {}
    for f, x0, top in (("f", np.array([0.75, 0.25, 0, 0, 0]), 5.0), ("g", np.eye(5)[4], 2.0)):
        x = x0
        for _ in range(5):
            x = 0.85 * (a / a.sum(0)) @ x + 0.15 * x0
        want |= {(f, i + 1): v * top / x.max() for i, v in enumerate(x) if v > 0}
    assert got == pytest.approx(want)


def test_sparse_pagerank_solves_its_optimum(spark, square):
    """At the optimum every positive value satisfies the stationarity condition of the penalised form."""
    seeds = spark.createDataFrame([("t", "F", 1, 1.0)], "celltype string, condition string, gene long, x0 double")
    got = {r.gene: r.x for r in profiles.sparse_pagerank(square, seeds, rho=0.0, epsilon=0.0, rounds=60).collect()}
    a = matrix(square)
    exact = np.linalg.solve((1.15 / 2) * np.eye(5) - (0.85 / 2) * a / a.sum(0), 0.15 * np.eye(5)[0])
    assert [got[i] for i in range(1, 6)] == pytest.approx(list(exact), abs=1e-3)


def test_adaptive_neighbours_stop_at_the_first_far_one(spark):
    rows = spark.createDataFrame([("a", o, d) for o, d in ((1, 0.1), (2, 0.2), (3, 9.0), (4, 9.5))], "id string, other long, distance double")
    got = profiles.adaptive_neighbours(rows, ["id"]).orderBy("rank")
    assert [r.other for r in got.collect()] == [1, 2]


def test_double_norm_of_empty_and_negative_values(spark):
    rows = spark.createDataFrame([("a", "x", 4.0), ("a", "y", -1.0), ("b", "y", None)], "a string, b string, v double")
    assert [tuple(r) for r in profiles.double_norm(rows, "a", "b", "v").collect()] == [("a", "x", 1.0)]
    assert profiles.double_norm(rows.where("v > 9"), "a", "b", "v").count() == 0


def test_footprints_alike_apart_and_in_blocks(spark):
    rows = spark.createDataFrame([("p", 1, 2.0), ("q", 1, 5.0), ("q", 2, 5.0), ("r", 1, 1.0)], "archetype string, item int, x double")
    got = {(r.a, r.b): r.similarity for r in profiles.footprint_similarity(rows).collect()}
    js = 1 - (1.5 * math.log2(1.5) - 0.5 * math.log2(0.5)) / 2
    assert got["p", "r"] == pytest.approx(1.0) and got["p", "q"] == pytest.approx(1 - math.sqrt(js))
    for most in (1, 2):  # tables that were refused once: several blocks, the same pairs
        assert {(r.a, r.b): r.similarity for r in profiles.footprint_similarity(rows, most=most).collect()} == pytest.approx(got)


def test_annotation_by_markers_of_a_constant_panel(spark):
    scores = spark.createDataFrame([("c", g, 1.0) for g in range(6)], "c string, gene long, x double")
    markers = spark.createDataFrame([("l", 1, 1), ("l", 2, -1), ("m", 3, 1)], "label string, gene long, sign int")
    got = {r.label: (r.score, r.z) for r in profiles.annotate_by_markers(scores, markers, ["c"], reps=20).collect()}
    assert got == {"l": (0.0, 0.0), "m": (1.0, 0.0)}


def test_agreeing_labels_score_high(spark, square):
    labels = spark.createDataFrame([("t", "F", g, l) for g, l in ((1, "a"), (4, "a"), (5, "a"), (2, "b"), (3, "b"))], "celltype string, condition string, gene long, label string")
    row = profiles.label_autocorrelation(square, labels, reps=50).first()
    share = {"a": 0.6, "b": 0.4}
    of = {1: "a", 4: "a", 5: "a", 2: "b", 3: "b"}
    phi = sum((2 if of[r.gene1] == of[r.gene2] else -2) * r.lls / (share[of[r.gene1]] * share[of[r.gene2]]) for r in square.collect())
    assert row.phi == pytest.approx(phi) and row.z > 0


def test_doublets_lie_below_the_median(spark):
    scores = spark.createDataFrame([(c, l, float(x)) for c in range(1, 6) for l, x in (("a", 1), ("b", c))], "cell_id long, label string, x double")
    centrality = spark.createDataFrame([(c, c) for c in range(1, 7)], "cell_id long, c long")
    got = {r.cell_id: r for r in profiles.doublet_score(scores, centrality, how="max").collect()}
    assert got[1].by_centrality > 0 > got[6].by_centrality and got[6].by_scores > 0 and got[6].doublet


def test_graphml_round_trip(spark, tmp_path):
    net = spark.createDataFrame([("n1", "A&B", "C", 2.0), ("n1", "C", "D", None), ("n2", "E", "F", 1.5)], "net_id string, gene1 string, gene2 string, LLS double")
    save_graphml(net, str(tmp_path / "g"))
    files = {p.parent.name: p for p in (tmp_path / "g").glob("net_id=*/part-*")}
    assert set(files) == {"net_id=n1", "net_id=n2"}
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(files["net_id=n1"].read_text())
    assert [n.get("id") for n in root.iter(f"{space}node")] == ["A&B", "C", "D"]
    assert [(e.get("source"), e.get("target"), [d.text for d in e]) for e in root.iter(f"{space}edge")] == [("A&B", "C", ["2.0"]), ("C", "D", [])]


def test_archetypes_of_one_cell_group_each_are_clusters(spark):
    counts = spark.createDataFrame([(c, f, float(c + f)) for c in range(1, 7) for f in range(3) if (c * f) % 4 != 1], "cell_id long, feature long, value double")
    cells = spark.createDataFrame([(c, "xy"[c % 2]) for c in range(1, 8)], "cell_id long, k string")
    one = {(r.k, r.feature): (r.upper, r.lower) for r in expression.cluster_specificity(counts, cells, "k").collect()}
    weights = cells.selectExpr("cell_id", "k AS archetype", "2.0D AS weight")
    two = {(r.archetype, r.feature): (r.upper, r.lower) for r in expression.archetype_specificity(counts, weights, 7).collect()}
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(v) for k, v in one.items())


def test_features_that_a_cluster_lacks_have_their_lower_bound(spark):
    counts = spark.createDataFrame([(1, "a", 4.0), (2, "a", 2.0), (3, "b", 1.0), (4, "b", 1.0)], "cell_id long, feature string, value double")
    cells = spark.createDataFrame([(c, "xy"[c > 2]) for c in range(1, 5)], "cell_id long, k string")
    got = {(r.k, r.feature): (r.obs, r.upper, r.lower) for r in expression.cluster_specificity(counts, cells, "k").collect()}
    # two cells of coverage 1 (b1 = b2 = 2), half of all cells with a mean of 3: expected 1.5, spread 9 / 4
    assert len(got) == 4 and got["y", "a"] == (0, 0, pytest.approx(1.5**2 / (2 * 2.25) / math.log(10)))


def test_qc_by_share_and_upper_bound(spark):
    counts = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 90.0), (3, "b", 1.0)], "cell_id long, feature string, value double")
    got = expression.qc_filter(counts, min_cells=0.5, min_features=1, min_umis=0, max_umis=50).collect()
    assert sorted((r.cell_id, r.feature) for r in got) == [(1, "a"), (2, "a")]


def test_reference_has_each_edge_once(spark, tmp_path):
    path = tmp_path / "ref.csv"
    path.write_text("Gene1,gene2,LLS\nB,A,1.5\nA,B,2.5\nC,C,9\nA,C,1\n")
    assert sorted(map(tuple, read_reference(spark, str(path)).collect())) == [("A", "B", 2.5), ("A", "C", 1.0)]
    path.write_text("gene1,LLS\nA,1\n")
    with pytest.raises(ValueError):
        read_reference(spark, str(path))
