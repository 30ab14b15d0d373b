"""Triangles, density clusters, spanners and forests against plain Python on random networks."""

import itertools

import numpy as np
import pytest

from cellweave.operators import triangles as T

EDGE = "celltype string, condition string, gene1 long, gene2 long, lls double"


def random_net(seed, n, share, high):
    r = np.random.default_rng(seed)
    return {(a, b): float(r.integers(1, high)) for a in range(n) for b in range(a + 1, n) if r.random() < share}


NETS = {"p": random_net(1, 30, 0.2, 9), "q": random_net(2, 22, 0.35, 4), "r": {(0, 1): 2.0, (1, 2): 3.0, (5, 6): 1.0}, "hub": {(0, i): float(1 + i % 5) for i in range(1, 60)} | {(i, i + 1): 1.0 for i in range(1, 20)}}


@pytest.fixture(scope="module")
def net(spark):
    rows = [(c, "x", *((a, b) if (a + b) % 2 else (b, a)), w) for c, edges in NETS.items() for (a, b), w in edges.items()]
    return spark.createDataFrame([*rows, ("p", "x", 3, 3, 7.0)], EDGE).cache()


def around(edges):
    out = {}
    for (a, b), w in edges.items():
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def test_triangles_and_transitivity(net):
    found = {}
    for r in T.triangles(net).collect():
        key = frozenset((r["a"], r["b"], r["c"]))
        assert key not in found.setdefault(r["celltype"], {})
        found[r["celltype"]][key] = (r["w_ab"] + r["w_ac"] + r["w_bc"])
        of = lambda x, y, e=NETS[r["celltype"]]: e[min(x, y), max(x, y)]
        assert (r["w_ab"], r["w_ac"], r["w_bc"]) == (of(r["a"], r["b"]), of(r["a"], r["c"]), of(r["b"], r["c"]))
    got = {(r["celltype"], r["gene"]): r for r in T.transitivity(net).collect()}
    for c, edges in NETS.items():
        near = around(edges)
        want = {frozenset(t) for t in itertools.combinations(near, 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]}
        assert set(found.get(c, {})) == want
        for g, own in near.items():
            pairs = [(i, j) for i, j in itertools.permutations(own, 2) if j in near[i]]
            assert got[c, g]["triangles"] == len(pairs) // 2
            if len(own) < 2:
                assert got[c, g]["transitivity"] is None
            else:
                assert got[c, g]["transitivity"] == pytest.approx(sum((own[i] + own[j]) / 2 for i, j in pairs) / (sum(own.values()) * (len(own) - 1)))
    assert T.triangles(net.limit(0)).count() == T.transitivity(net.limit(0)).count() == 0


@pytest.mark.parametrize(("least", "eps"), [(3, 4.0), (1, 0.0), (50, 1.0)])
def test_density_clusters(net, least, eps):
    got = {(r["celltype"], r["gene"]): r for r in T.density_clusters(net, least, eps).collect()}
    assert len(got) == sum(len(around(e)) for e in NETS.values())
    for c, edges in NETS.items():
        near = {g: {o: w for o, w in own.items() if w > eps} for g, own in around(edges).items()}
        core = {g for g in near if len(near[g]) >= least}
        own = {}
        for g in sorted(core):
            stack = [g] if g not in own else []
            while stack:
                x = stack.pop()
                if x not in own:
                    own[x] = g
                    stack += [o for o in near[x] if o in core]
        for g in near:
            beside = sorted((-w, o) for o, w in near[g].items() if o in core)
            want = own[g] if g in core else own[beside[0][1]] if beside else None
            assert (got[c, g]["core"], got[c, g]["cluster"]) == (g in core, want)


def shortest(genes, edges):
    at = {g: i for i, g in enumerate(sorted(genes))}
    d = np.full((len(at), len(at)), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), w in edges.items():
        d[at[a], at[b]] = d[at[b], at[a]] = w
    for k in range(len(at)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


@pytest.mark.parametrize("k", [1, 2, 3])
def test_spanner_keeps_its_stretch(spark, net, k):
    dense = {(a, b): float(1 + (a * 7 + b * 3) % 11) for a in range(60) for b in range(a + 1, 60)}
    both = net.unionByName(spark.createDataFrame([("full", "x", a, b, w) for (a, b), w in dense.items()], EDGE))
    rows = {}
    for r in T.spanner(both, k, "lls").collect():
        rows.setdefault(r["celltype"], {})[r["gene1"], r["gene2"]] = r["d"]
    for c, edges in [*NETS.items(), ("full", dense)]:
        genes = around(edges)
        assert set(rows[c].items()) <= set(edges.items())
        assert (shortest(genes, rows[c]) <= (2 * k - 1) * shortest(genes, edges) + 1e-9).all()
    if k == 1:
        assert rows["full"] == dense
    else:
        assert len(rows["full"]) < 0.7 * len(dense)


def test_forest_is_the_lightest(net):
    got = {}
    for r in T.minimum_forest(net, "lls").collect():
        got.setdefault(r["celltype"], []).append((r["d"], r["gene1"], r["gene2"]))
    for c, edges in NETS.items():
        root, want = {g: g for g in around(edges)}, []
        find = lambda x, root=root: x if root[x] == x else find(root[x], root)
        for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
            if find(a) != find(b):
                root[find(a)] = find(b)
                want.append((w, a, b))
        assert sorted(got[c]) == want
    assert T.minimum_forest(net.limit(0), "lls").count() == 0
