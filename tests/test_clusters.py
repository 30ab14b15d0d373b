"""Communities, assignment and neighbour graphs against plain Python on random tables."""

import itertools
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from cellweave.operators import assignment, communities, neighbours

EDGE = "celltype string, condition string, gene1 string, gene2 string, lls double"


def partition_quality(edges, label, resolution=1.0):
    total = 2 * sum(w for _, _, w in edges)
    k, inner = defaultdict(float), 0.0
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
        inner += 2 * w * (label[a] == label[b])
    return inner / total - resolution * sum(x * x for x in k.values()) / total**2


def one_by_one(edges):
    """Moves of one node at a time and contraction until nothing moves."""
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    k = {v: sum(x.values()) for v, x in near.items()}
    total, label = sum(k.values()), {v: v for v in near}
    while True:
        own, size, moved, again = {v: v for v in near}, dict(k), False, True
        while again:
            again = False
            for v in sorted(near):
                ties = defaultdict(float)
                for u, w in near[v].items():
                    ties[own[u]] += w * (u != v)
                size[own[v]] -= k[v]
                worth = lambda c: ties.get(c, 0.0) - k[v] * size[c] / total  # noqa: B023, E731
                best = max(sorted(ties), key=worth)
                if worth(best) > worth(own[v]) + 1e-12:
                    own[v], moved, again = best, True, True
                size[own[v]] += k[v]
        label = {g: own[v] for g, v in label.items()}
        if not moved:
            return label
        merged, sums = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for v in near:
            sums[own[v]] += k[v]
            for u, w in near[v].items():
                merged[own[v]][own[u]] += w
        near, k = merged, sums


@pytest.fixture(scope="module")
def blocks():
    """Three groups, dense within, and a graph without any."""
    r = random.Random(3)
    rows = [("p", "x", f"g{a:03d}", f"g{b:03d}", float(r.randrange(1, 5))) for a in range(30) for b in range(a + 1, 30) if r.random() < (0.8 if a % 3 == b % 3 else 0.1)]
    return rows + [("q", "x", f"g{a:03d}", f"g{b:03d}", 1.0) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.12]


def test_communities_are_as_good_as_one_by_one(spark, blocks, monkeypatch):
    net = spark.createDataFrame(blocks, EDGE)
    seen, original = [], communities.accepted

    def watched(level_edges, wishes, resolution, turn):
        moves = original(level_edges, wishes, resolution, turn)
        seen.append({(r["celltype"], r["node"]): r["to"] for r in moves.collect()})
        return moves

    monkeypatch.setattr(communities, "accepted", watched)
    labels = communities.leiden(net).cache()
    stated = {r["celltype"]: (r["communities"], r["modularity"]) for r in communities.modularity(net, labels).collect()}
    rows = labels.toPandas()
    for c in "pq":
        edges = [x[2:] for x in blocks if x[0] == c]
        own = dict(zip(rows[rows.celltype == c].gene, rows[rows.celltype == c].community, strict=True))
        assert partition_quality(edges, own) == pytest.approx(stated[c][1]) and len(set(own.values())) == stated[c][0]
        assert stated[c][1] >= 0.98 * partition_quality(edges, one_by_one(edges))
        assert all(label == min(g for g in own if own[g] == label) for label in own.values())
        if c == "p":
            assert stated[c][1] >= 0.98 * partition_quality(edges, {f"g{i:03d}": i % 3 for i in range(30)})
        at = {g: g for g in own}  # the first rounds move genes, and each of them gains
        for moves in seen[:2]:
            before = partition_quality(edges, at)
            at |= {g: to for (net_of, g), to in moves.items() if net_of == c}
            assert partition_quality(edges, at) >= before
    # the same figure from SQL over the returned partition
    con = duckdb.connect()
    con.register("e", net.toPandas())
    con.register("l", rows)
    sql = """WITH d AS (SELECT celltype, gene1 AS a, gene2 AS b, lls AS w FROM e UNION ALL SELECT celltype, gene2, gene1, lls FROM e),
        k AS (SELECT d.celltype, x.community, sum(w) AS k, sum(CASE WHEN x.community = y.community THEN w ELSE 0 END) AS i FROM d JOIN l x ON x.celltype = d.celltype AND x.gene = a JOIN l y ON y.celltype = d.celltype AND y.gene = b GROUP BY ALL)
        SELECT celltype, sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)) FROM k GROUP BY ALL"""
    assert dict(con.sql(sql).fetchall()) == pytest.approx({c: q for c, (_, q) in stated.items()})


def test_start_signed_weights_and_empty_networks(spark):
    rows = [("p", "x", a, b, w) for a, b, w in [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0), ("c", "d", -3.0), ("d", "e", 2.0), ("e", "e", 9.0)]]
    net = spark.createDataFrame(rows, EDGE)
    got = {r["gene"]: r["community"] for r in communities.leiden(net, 0.5, "cpm").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    start = spark.createDataFrame([("p", "x", g, 1 if g in "abc" else 2) for g in "abcde"], "celltype string, condition string, gene string, community int")
    assert {r["gene"]: r["community"] for r in communities.leiden(net, 0.5, "cpm", start).collect()} == got
    assert communities.leiden(net.limit(0)).count() == 0


def test_assignment_has_the_greatest_total(spark):
    r = random.Random(8)
    rows, best = [], {}
    for g in range(12):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        w = {(a, b): r.choice([0, 0, 1, 2, 3, 3, 7]) for a in range(n) for b in range(m)}
        rows += [(g, a, f"c{b}", float(x)) for (a, b), x in w.items()]
        best[g] = max(sum(w[a, b] for a, b in zip(p, range(m), strict=False) if a is not None) for p in itertools.permutations([*range(n), *[None] * m], m))
    table = spark.createDataFrame([*rows, (99, None, "c0", 5.0), (99, 1, None, 5.0), (99, 1, "c1", None), (99, 1, "c2", -1.0)], "grp int, a int, b string, w double")
    got = assignment.assign(table, "a", "b", "w", ["grp"], tolerance=0.5).collect()
    for g in best:
        own = [x for x in got if x["grp"] == g]
        assert sum(x["w"] for x in own) == best[g] and len({x["a"] for x in own}) == len({x["b"] for x in own}) == len(own)
    assert all(x["grp"] != 99 for x in got)
    assert assignment.assign(table.limit(0), "a", "b", "w").count() == 0


def test_clusters_take_labels(spark):
    rows = [("x", 1)] * 8 + [("y", 1)] * 3 + [("y", 2)] * 6 + [("x", 3)] * 4 + [("z", 3)]
    table = spark.createDataFrame(rows, "label string, cluster int")
    mapped = {(r["cluster"], r["mapped"]) for r in assignment.renamed(table, "label", "cluster").collect()}
    assert mapped == {(1, "x"), (2, "y"), (3, "z")}


def clustered(n, seed, dims=8):
    r = np.random.default_rng(seed)
    centres = r.dirichlet(np.ones(dims) * 0.5, 30)
    return np.clip(centres[r.integers(0, 30, n)] + r.normal(0, 0.02, (n, dims)), 0, 1)


@pytest.mark.parametrize("measure", ["jsd", "cosine"])
def test_neighbours_are_found(spark, measure):
    x = clustered(600, 4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [0.0] * 8), (-3, [None] * 8)]
    got = neighbours.nn_descent(spark.createDataFrame(rows, "id long, x array<double>"), 10, measure).toPandas()
    unit = x / (x.sum(1, keepdims=True) if measure == "jsd" else np.linalg.norm(x, axis=1, keepdims=True))
    d = neighbours.distances(unit, measure)
    np.fill_diagonal(d, np.inf)
    right = 0
    for i, own in got.groupby("id"):
        assert own.distance.tolist() == pytest.approx(d[i, own.other].tolist(), abs=1e-7)
        right += (own.distance <= np.sort(d[i])[9] + 1e-9).sum()
    assert right >= 0.9 * 10 * 600 and got.id.min() == 0


def test_network_of_mutual_neighbours(spark):
    x = clustered(120, 6)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = neighbours.distances(x / x.sum(1, keepdims=True), "jsd")
    kept = set()
    for i in range(120):
        order = [j for j in np.lexsort((np.arange(120), d[i])) if j != i][:15]
        s = q = 0.0
        for k, j in enumerate(order, 1):
            s, q = s + d[i, j], q + d[i, j] ** 2
            inside = k + s * s - k * q
            if (s + inside**0.5) / k < d[i, j] if inside >= 0 else 0 < d[i, j]:
                break
            kept.add((i, int(j)))
    want = {(a, b): 1 - d[a, b] for a, b in kept if a < b and (b, a) in kept}
    got = {(r["a"], r["b"]): r["weight"] for r in neighbours.neighbour_network(table, 15, least=0.0).collect()}
    assert len(got.keys() & want.keys()) >= 0.97 * len(want) and len(got.keys() - want.keys()) <= 0.03 * len(want)
    assert all(got[e] == pytest.approx(want[e], abs=1e-6) for e in got.keys() & want.keys())
    assert neighbours.neighbour_network(table.limit(1)).count() == 0


def test_the_divergence_is_bounded_by_the_squared_hellinger_distance():
    r = np.random.default_rng(1)
    x = np.vstack([r.dirichlet(np.full(25, c), 150) for c in (0.02, 0.2, 5.0)])
    d = neighbours.distances(x, "jsd")
    assert (1 - np.sqrt(x) @ np.sqrt(x).T <= d * d + 1e-12).all()
    for most in (np.full(d.shape, np.inf), np.full(d.shape, 0.5), d.T * 1.01):
        i, j, found = neighbours.between(x, x, "jsd", most)
        got = set(zip(i[found < most[i, j]], j[found < most[i, j]], strict=True))
        assert got == set(zip(*np.nonzero(d < most), strict=True)) and found == pytest.approx(d[i, j], abs=1e-7)


def test_equal_vectors_are_one_point_of_the_search(spark, monkeypatch):
    x = clustered(60, 9)
    copies = [14 if i % 3 == 0 else 1 + i % 6 for i in range(60)]
    of = [i for i, n in enumerate(copies) for _ in range(n)]
    table = spark.createDataFrame([(i, x[p].tolist()) for i, p in enumerate(of)], "id long, x array<double>")
    got = neighbours.nn_descent(table, 10, least=0.0).toPandas()
    d = neighbours.distances(x / x.sum(1, keepdims=True), "jsd")[np.ix_(of, of)]
    d[np.equal.outer(of, of)] = 0
    right = 0
    for i, own in got.groupby("id"):
        order = [j for j in np.lexsort((np.arange(len(of)), d[i])) if j != i][:10]
        assert len(own) == own.other.nunique() == 10 and i not in set(own.other)
        equal = {j for j in order if of[j] == of[i]}
        assert equal <= set(own.other) and (own.distance[own.other.isin(equal)] == 0).all()
        assert own.distance.tolist() == pytest.approx(d[i, own.other].tolist(), abs=1e-7)
        right += len(set(order) & set(own.other))
    assert got.id.nunique() == len(of) and right >= 0.95 * 10 * len(of)
    # where each vector has more than k copies nothing is searched
    monkeypatch.setattr(neighbours, "searched", None)
    many = neighbours.nn_descent(table.where(f"id in ({','.join(str(i) for i, p in enumerate(of) if copies[p] == 14)})"), 10).toPandas()
    assert (many.distance == 0).all() and (many.groupby("id").size() == 10).all()


@pytest.mark.parametrize("many", [0, 10**9])
def test_rounds_over_nodes_that_may_move_end_where_none_gains(spark, monkeypatch, many):
    """Two cliques of four that one edge joins; whether all nodes are looked at in a round or those near the last moves."""
    monkeypatch.setattr(communities, "MANY", many)
    rows = [("p", "x", f"{g}{a}", f"{g}{b}", 1.0) for g in "ab" for a in range(4) for b in range(a + 1, 4)] + [("p", "x", "a0", "b0", 1.0)]
    seen, original = [], communities.candidates
    monkeypatch.setattr(communities, "candidates", lambda *args: seen.append(len(args) > 4 and args[4] is not None) or original(*args))
    got = {r["gene"]: r["community"] for r in communities.leiden(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {f"{g}{a}": f"{g}0" for g in "ab" for a in range(4)}
    assert any(seen) == (many == 0) and not seen[-1]


def test_parts_that_hang_together_are_solved_in_tasks(spark, monkeypatch):
    # every round of every part was a round over tables: 240 paths of 6 to 40 nodes took as many rounds as the slowest
    r = random.Random(11)
    rows = [(f"c{t % 3}", "x", f"g{t:03d}{a:02d}", f"g{t:03d}{b:02d}", float(r.randrange(1, 9))) for t in range(240) for n in [r.randrange(6, 40)] for a in range(n) for b in {a + 1, (a * 7 + 3) % n} if a < b < n]
    net = spark.createDataFrame(rows, EDGE).cache()
    rounds, original = [], communities.candidates
    monkeypatch.setattr(communities, "candidates", lambda *args: rounds.append(1) or original(*args))
    labels = communities.leiden(net).cache()
    got = {(x["celltype"], x["gene"]): x["community"] for x in labels.collect()}
    assert len(rounds) == 1 and all(label[:4] == gene[:4] for (_, gene), label in got.items())
    stated = {x["celltype"]: x["modularity"] for x in communities.modularity(net, labels).collect()}
    for c in ("c0", "c1", "c2"):
        edges = [x[2:] for x in rows if x[0] == c]
        assert partition_quality(edges, {g: label for (k, g), label in got.items() if k == c}) == pytest.approx(stated[c])
        assert stated[c] >= 0.98 * partition_quality(edges, one_by_one(edges))
    # a part's communities depend on nothing that it meets in a task
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = {(x["celltype"], x["gene"]): x["community"] for x in communities.leiden(net.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == got


def test_the_search_begins_near(spark, monkeypatch):
    # neighbours began at random, so that the first rounds changed nearly all places and met every pair of a list
    monkeypatch.setattr(neighbours, "LEAF", 512)
    x = clustered(2000, 12)
    rounds, original = [], neighbours.joined_locally
    monkeypatch.setattr(neighbours, "joined_locally", lambda *args: rounds.append(1) or original(*args))
    got = neighbours.nn_descent(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), 10).toPandas()
    d = neighbours.distances(x / x.sum(1, keepdims=True), "jsd")
    np.fill_diagonal(d, np.inf)
    right = sum((own.distance <= np.sort(d[i])[9] + 1e-9).sum() for i, own in got.groupby("id"))
    assert len(rounds) <= 3 and right >= 0.98 * 10 * 2000


def test_leaves_share_points_that_lie_on_planes():
    r = np.random.default_rng(2)
    y = (r.random((4000, 6)) < 0.1).astype(float)  # 64 places, most points at one
    leaves = np.bincount(neighbours.leaf_of(y, r.integers(0, 2**62, 4000), neighbours.random_tree(y[:500], 4, r)), minlength=16)
    assert leaves.sum() == 4000 and leaves.max() < 1500
    assert len(neighbours.random_tree(y[:1], 3, r)[2][1]) == 4
    far = [np.concatenate(c) for c in zip(*neighbours.nearest_within(np.arange(3), np.eye(3), 5, "cosine"), strict=True)]
    assert sorted(zip(*far, strict=True)) == [(i, j, 1.0) for i in range(3) for j in range(3) if i != j]
