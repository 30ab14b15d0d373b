"""Hub nulls against plain Python over the same rewirings, and close eigenvalues."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweave.operators import hubs, paths

EDGE = "celltype string, condition string, gene1 string, gene2 string, lls double"


@pytest.fixture(scope="module")
def net(spark):
    r = np.random.default_rng(5)
    rows = [(c, k, f"g{a:02d}", f"g{b:02d}", float(r.integers(1, 9))) for c in "xy" for k in ("F", "O") for a in range(30) for b in range(a + 1, 30) if r.random() < 0.05]
    return spark.createDataFrame(rows, EDGE).cache()


def test_nodes_without_edges_are_zeros_of_the_null(net):
    got = {(r["celltype"], r["condition"], r["gene"]): (r["value"], r["p"]) for r in hubs.find_all_hub(net, None, 3, values=200).collect()}
    nodes = defaultdict(set)
    for r in net.collect():
        nodes[r["celltype"], r["condition"]] |= {r["gene1"], r["gene2"]}
    null = defaultdict(Counter)
    for r in hubs.rewired(net, None, 0.5, 3, values=200).collect():
        for i in (r["a"], r["b"]):
            null[r["celltype"], r["condition"]][r["rep"], i] += r["lls"]
    for (c, k, gene), (value, p) in got.items():
        n = len(nodes[c, k])
        values = [null[c, k].get((rep, i), 0.0) for rep in range(1, math.ceil(200 / n) + 1) for i in range(n)]
        assert 0.0 in values and p == pytest.approx((1 + sum(v > value for v in values)) / (len(values) + 1))


def test_differences_of_two_zeros_stay_in_the_null(spark, net):
    cells = spark.createDataFrame([(c, k) for c in "xy" for k in ("F", "O")] * 5, "celltype string, condition string")
    got = {(r["celltype"], r["gene"]): (r["size"], r["p"]) for r in hubs.find_diff_hub(net, cells, "F", "O", None, 3, min_cells=5, values=300).collect()}
    base = net.where("condition = 'F'")
    ranks = []
    for side in (0, 1):
        strengths = defaultdict(Counter)
        for r in hubs.rewired(base, None, 0.9, 3 + side, shuffle_each=False, values=300).collect():
            for i in (r["a"], r["b"]):
                strengths[r["celltype"], r["rep"]][i] += r["lls"]
        ranks.append({(*key, i): sum(x < v for x in own.values()) / (len(own) - 1) for key, own in strengths.items() for i, v in own.items()})
    null = defaultdict(list)
    for key in ranks[0].keys() | ranks[1].keys():
        null[key[0]].append(abs(ranks[1].get(key, 0.0) - ranks[0].get(key, 0.0)))
    assert any(ranks[0].get(k, 0.0) == 0 == ranks[1].get(k, 0.0) for k in ranks[0].keys() | ranks[1].keys())
    assert all(p == pytest.approx((1 + sum(v > size + 1e-12 for v in null[c])) / (len(null[c]) + 1), abs=2e-3) for (c, _), (size, p) in got.items())


@pytest.mark.parametrize("method", ["betweenness", "closeness"])
def test_other_centralities_are_tested_against_their_own_null(net, method):
    one = net.where("celltype = 'x' AND condition = 'F'")
    got = {r["gene"]: (r["value"], r["p"]) for r in hubs.find_all_hub(one, 2, 3, centrality=method).collect()}
    n = len({x for r in one.collect() for x in (r["gene1"], r["gene2"])})
    values = [r["value"] for r in hubs.null_centralities(hubs.rewired(one, 2, 0.5, 3), method).collect()]
    values += [0.0] * (2 * n - len(values))
    assert got and all(p == pytest.approx((1 + sum(v > value for v in values)) / (2 * n + 1)) for value, p in got.values())


def test_eigenvector_of_two_components_that_nearly_tie(spark):
    """Two paths, of which the second's weights are a ten-thousandth smaller: only the first has values."""
    rows = [("c", "x", f"a{i:02d}", f"a{i + 1:02d}", 1.0 + i % 3) for i in range(40)] + [("c", "x", f"b{i:02d}", f"b{i + 1:02d}", (1.0 + i % 3) * 0.9999) for i in range(40)]
    rows += [("d", "x", "p", "q", 1.0), ("d", "x", "q", "r", 2.0)]
    got = {(r["celltype"], r["gene"]): r["value"] for r in paths.eigenvector(spark.createDataFrame(rows, EDGE), tolerance=1e-10).collect()}
    a = np.zeros((41, 41))
    for i in range(40):
        a[i, i + 1] = a[i + 1, i] = 1 + i % 3
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert [got["c", f"a{i:02d}"] for i in range(41)] == pytest.approx((v / v.max()).tolist(), abs=1e-6)
    assert max(abs(got["c", f"b{i:02d}"]) for i in range(41)) < 1e-6
    assert [got["d", g] for g in "pqr"] == pytest.approx([1 / 5**0.5, 1.0, 2 / 5**0.5], abs=1e-9)
