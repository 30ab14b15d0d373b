"""Path centralities, labels and count files on small fixtures with known answers."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import labels, paths, statistics
from cellweave.sources import counts


@pytest.fixture(scope="module")
def net(spark):
    """A path a-b-c-d beside a single edge x-y."""
    rows = [("t", "c", *e, 1.0) for e in (("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"))]
    return spark.createDataFrame(rows, "celltype string, condition string, gene1 string, gene2 string, lls double").withColumn("scinet_weight", F.lit(1.0))


def values(df):
    return {r["gene"]: r["value"] for r in df.collect()}


def test_closeness_within_components(net):
    got, scaled = values(paths.closeness(net)), values(paths.closeness(net, component_scaling=True))
    assert got["a"] == pytest.approx(1 / 6) and got["b"] == pytest.approx(1 / 4) and got["x"] == 1
    assert scaled["a"] == pytest.approx(3 / 6 * 3 / 5) and scaled["x"] == pytest.approx(1 / 5)


def test_betweenness_of_a_path_and_a_square(spark, net):
    assert values(paths.betweenness(net)) == {"a": 0, "b": 2, "c": 2, "d": 0, "x": 0, "y": 0}
    square = spark.createDataFrame([("t", "c", *e) for e in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"))], "celltype string, condition string, gene1 string, gene2 string")
    assert values(paths.betweenness(square)) == dict.fromkeys("abcd", 0.5)


def test_eigenvector_of_a_star(spark):
    star = spark.createDataFrame([("t", "c", "m", x, 2.0) for x in "abcd"], "celltype string, condition string, gene1 string, gene2 string, lls double")
    got = values(paths.eigenvector(star))
    assert got["m"] == 1 and got["a"] == pytest.approx(0.5, abs=1e-6)


def test_empty_network(net):
    none = net.where("gene1 = 'q'")
    assert paths.closeness(none).count() == paths.betweenness(none).count() == paths.eigenvector(none).count() == 0


def test_labels_spread_to_unknown_nodes_only(spark):
    clique = [("t", "c", a, b, 1.0) for g in ("abcdefgh", "ijklmnop") for k, a in enumerate(g) for b in g[k + 1 :]]
    net = spark.createDataFrame(clique, "celltype string, condition string, gene1 string, gene2 string, lls double")
    known = spark.createDataFrame([("t", "c", g, -1 if g in "ai" else int(g > "h")) for g in "abcdefghijklmnop"], "celltype string, condition string, gene string, label long")
    got = {r["gene"]: r["label"] for r in labels.infer_missing(net, known, least=0.5).collect()}
    assert got["a"] == 0 and got["i"] == 1 and got["h"] == 0
    assert {r["label"] for r in labels.without_small(known, 3).collect()} == {-1, 0, 1}


def test_hypergeometric_and_fisher(spark):
    rows = spark.createDataFrame([(10, 5, 4, 3), (10, 5, 4, 0), (10, 5, 4, 5), (2000, 700, 900, 500)], "n long, s long, d long, k long")
    got = [r[0] for r in rows.select(statistics.hypergeometric_log10(F.col("n"), F.col("s"), F.col("d"), F.col("k"))).collect()]
    p = sum(math.comb(5, i) * math.comb(5, 4 - i) for i in (3, 4)) / math.comb(10, 4)
    big = sum(math.comb(700, i) * math.comb(1300, 900 - i) for i in range(500, 701)) * 10**300 // math.comb(2000, 900)
    assert got[0] == pytest.approx(-math.log10(p)) and got[1] == 0 and got[2] == math.inf
    assert got[3] == pytest.approx(300 - math.log10(big))
    t = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 0, 0)], "a long, b long, c long, d long")
    r, empty = statistics.fisher_exact(t, "a", "b", "c", "d").collect()
    assert r["odds_ratio"] == 9 and r["p_value"] == pytest.approx(34 / 70) and empty["p_value"] == pytest.approx(1)


def test_score_enrichment_finds_the_best_cut(spark):
    scores = spark.createDataFrame([("n", f"g{i}", 10.0 - i) for i in range(10)], "net string, gene string, x double")
    sets = spark.createDataFrame([("top", "g0"), ("top", "g1"), ("top", "g9"), ("one", "g0")], "set_name string, gene string")
    (r,) = statistics.score_enrichment(scores, sets, ["net"]).collect()
    over, squares = 19 - 19 * 0.3, 181 * 0.3
    assert (r["set_name"], r["threshold"]) == ("top", 1) and r["log_p"] == pytest.approx(over**2 / (2 * (squares + 10 * over / 3)))


@pytest.mark.parametrize("header", [False, True])
def test_triples_split_features_by_kind(spark, tmp_path, header):
    def put(name, lines):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")

    put("matrix.mtx.gz", ["%%MatrixMarket matrix coordinate integer general", "%", "3 2 4", "1 1 5", "3 1 2", "2 2 7", "1 2 0"])
    put("features.tsv.gz", ["id\tname\tkind"] * header + ["e1\tA\tGene Expression", "e2\tB\tGene Expression", "h1\tH\tAntibody Capture"])
    put("barcodes.tsv.gz", ["c1", "c2"])
    got = counts.read_10x(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got["counts"].collect())) == [("c1", "A", 5.0), ("c2", "B", 7.0)]
    assert list(map(tuple, got["maps"].collect())) == [("Antibody Capture", "c1", "h1", 2.0)]


def test_delimited_and_sparse_export(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("gene\tc1\tc2\nA\t1\t0\nB\t0\t2.5\n")
    long = counts.read_delimited(spark, f"file://{tmp_path}/t.tsv")
    assert sorted(map(tuple, long.collect())) == [("c1", "A", 1.0), ("c2", "B", 2.5)]
    (tmp_path / "n.tsv").write_text("c1\tc2\n4\t0\n0\t6\n")
    assert sorted(map(tuple, counts.read_delimited(spark, f"file://{tmp_path}/n.tsv").collect())) == [("c1", "1", 4.0), ("c2", "2", 6.0)]
    cells = spark.createDataFrame([("c1", "x"), ("c2", "y")], "cell_id string, celltype string").repartition(2)
    counts.write_sparse(long, cells, f"file://{tmp_path}/out")
    read = lambda d: [x for p in sorted((tmp_path / "out" / d).glob("part*")) for x in p.read_text().splitlines()]
    features, names, lines = read("features.txt"), [x.split("\t")[0] for x in read("metadata.tsv")], read("counts.mtx")
    assert lines[0].startswith("%%MatrixMarket") and lines[1] == "2 2 2"
    assert sorted((names[int(j) - 1], features[int(i) - 1], float(v)) for i, j, v in map(str.split, lines[2:])) == [("c1", "A", 1.0), ("c2", "B", 2.5)]


def test_eigenvector_solves_small_components_by_themselves(spark, monkeypatch):
    """Two equal components, a lighter one and a pair: no product of tables, and the same values by products."""
    ring = [(a, b, 1.0 + (a % 3)) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 4)]]
    rows = [("t", "c", 10 * k + a, 10 * k + b, w * s) for k, s in enumerate((1.0, 0.9, 1.0)) for a, b, w in ring] + [("t", "c", 90, 91, 0.5)]
    net = spark.createDataFrame(rows, "celltype string, condition string, gene1 long, gene2 long, lls double")
    tables = values(paths.eigenvector(net, tolerance=1e-10, together=2))
    monkeypatch.setattr(paths, "krylov_step", None)
    alone = values(paths.eigenvector(net, tolerance=1e-10))
    a = np.zeros((5, 5))
    for i, j, w in ring:
        a[i, j] = a[j, i] = w
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    want = {10 * k + i: (v / v.max())[i] if k != 1 else 0.0 for k in range(3) for i in range(5)} | {90: 0.0, 91: 0.0}
    assert alone == pytest.approx(want, abs=1e-9) and tables == pytest.approx(want, abs=1e-7)
