"""Triangles, transitivity, density clusters, spanners and minimum forests of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, components, stored
from .network import NET


def simple(net: DataFrame, weight: str) -> DataFrame:
    """NET, gene1 < gene2, w: loops gone, edges given twice added up."""
    a, b = F.least("gene1", "gene2"), F.greatest("gene1", "gene2")
    return net.where("gene1 <> gene2").groupBy(*NET, a.alias("gene1"), b.alias("gene2")).agg(F.sum(weight).cast("double").alias("w"))


def triangles(net: DataFrame, weight: str = "lls") -> DataFrame:
    """NET, a, b, c, w_ab, w_ac, w_bc of every triangle, once.

    Edges point from the end of smaller degree (then name) to the other, so no gene has more than
    the root of twice the edges ahead of it, hubs included, and pairs of those are looked up as edges.
    """
    edges = stored(simple(net, weight))
    degree = both_ways(edges).groupBy(*NET, "src").agg(F.count(F.lit(1)).alias("d"))
    side = lambda i: degree.select(*NET, F.col("src").alias(f"gene{i}"), F.struct("d", F.col("src").alias("g")).alias(f"r{i}"))
    ranked = edges.join(side(1), [*NET, "gene1"]).join(side(2), [*NET, "gene2"])
    low, high = F.least("r1", "r2"), F.greatest("r1", "r2")
    ahead = stored(ranked.select(*NET, low["g"].alias("a"), high.alias("to"), "w"))
    leg = lambda name: ahead.select(*NET, "a", F.col("to").alias(name), F.col("w").alias(f"w_a{name}"))
    open_pairs = leg("b").join(leg("c"), [*NET, "a"]).where("b < c").select(*NET, "a", F.col("b.g").alias("b"), F.col("c.g").alias("c"), "w_ab", "w_ac")
    return open_pairs.join(ahead.select(*NET, F.col("a").alias("b"), F.col("to.g").alias("c"), F.col("w").alias("w_bc")), [*NET, "b", "c"]).select(*NET, "a", "b", "c", "w_ab", "w_ac", "w_bc")


def transitivity(net: DataFrame, weight: str = "lls") -> DataFrame:
    """NET, gene, triangles, transitivity: the share of a gene's pairs of neighbours that are linked, each pair
    weighing the mean of its two edges over the gene's mean weight (Barrat); null below two neighbours."""
    t = triangles(net, weight)
    corner = lambda g, x, y: F.struct(F.col(g).alias("gene"), (F.col(x) + F.col(y)).alias("s"))
    at = t.select(*NET, F.explode(F.array(corner("a", "w_ab", "w_ac"), corner("b", "w_ab", "w_bc"), corner("c", "w_ac", "w_bc"))).alias("p"))
    closed = at.groupBy(*NET, F.col("p.gene").alias("gene")).agg(F.count(F.lit(1)).alias("triangles"), F.sum("p.s").alias("s"))
    own = both_ways(simple(net, weight), "w").groupBy(*NET, F.col("src").alias("gene")).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("d"))
    value = F.when(F.col("d") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("total") * (F.col("d") - 1)))
    return own.join(closed, [*NET, "gene"], "left").select(*NET, "gene", F.coalesce("triangles", F.lit(0)).alias("triangles"), value.alias("transitivity"))


def density_clusters(net: DataFrame, min_points: int, eps: float, weight: str = "lls") -> DataFrame:
    """NET, gene, core, cluster (its smallest core gene; null for noise).

    A gene with at least ``min_points`` edges heavier than ``eps`` is a core gene; core genes that such edges
    connect form a cluster, and any other gene joins that of its heaviest such core neighbour (ties: the smallest
    gene).  So the result depends on no order of visits.
    """
    edges = stored(simple(net, weight))
    genes = both_ways(edges).select(*NET, F.col("src").alias("gene")).distinct()
    strong = both_ways(edges.where(F.col("w") > eps), "w")
    core = stored(strong.groupBy(*NET, F.col("src").alias("gene")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(*NET, "gene"))
    end = lambda name: core.select(*NET, F.col("gene").alias(name))
    linked = components(strong.join(end("src"), [*NET, "src"], "left_semi").join(end("dst"), [*NET, "dst"], "left_semi").where("src < dst").select(*NET, F.col("src").alias("gene1"), F.col("dst").alias("gene2")))
    named = core.join(linked, [*NET, "gene"], "left").select(*NET, "gene", F.coalesce("component", "gene").alias("own"))
    near = strong.join(named.select(*NET, F.col("gene").alias("dst"), "own"), [*NET, "dst"])
    border = near.groupBy(*NET, F.col("src").alias("gene")).agg(F.min_by("own", F.struct(-F.col("w"), "dst")).alias("border"))
    return genes.join(named, [*NET, "gene"], "left").join(border, [*NET, "gene"], "left").select(*NET, "gene", F.col("own").isNotNull().alias("core"), F.coalesce("own", "border").alias("cluster"))


def spanner(net: DataFrame, k: int, distance: str, seed: int = 0) -> DataFrame:
    """NET, gene1, gene2, d: edges of ``net`` that keep every distance within 2 ``k`` - 1 times what it was.

    Clusters begin as single genes.  In each of ``k`` - 1 phases a cluster stays with probability n^(-1/k), by a hash.
    A gene of one that goes takes its shortest edge to a cluster that stays and joins it, with a shorter edge
    to any other neighbouring cluster; where none stays near, the shortest edge to each.  Edges to clusters that it
    has thus reached go.  At the end each gene keeps its shortest edge to each cluster left.  Expected size: k n^(1 + 1/k)
    edges.  Of an edge given twice the shorter counts; ``distance`` must not be negative.
    """
    a, b = F.least("gene1", "gene2"), F.greatest("gene1", "gene2")
    base = net.where("gene1 <> gene2").groupBy(*NET, a.alias("gene1"), b.alias("gene2")).agg(F.min(distance).cast("double").alias("d"))
    live = stored(both_ways(base, "d"))
    own = stored(live.select(*NET, F.col("src").alias("gene")).distinct().withColumn("own", F.col("gene")))
    odds = stored(own.groupBy(*NET).agg(F.pow(F.count(F.lit(1)), F.lit(-1 / k)).alias("odds")))
    taken = []

    def reached() -> DataFrame:
        """NET, src, c, e (d, dst): each gene's shortest edge to each neighbouring cluster."""
        to = own.select(*NET, F.col("gene").alias("dst"), F.col("own").alias("c"))
        return live.join(to, [*NET, "dst"]).groupBy(*NET, "src", "c").agg(F.min(F.struct("d", "dst")).alias("e"))

    for phase in range(1, k):
        draw = F.pmod(F.xxhash64(*NET, "own", F.lit(phase), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        stays = stored(own.select(*NET, "own").distinct().join(odds, NET).where(draw < F.col("odds")).select(*NET, "own"))
        going = own.join(stays, [*NET, "own"], "left_anti").select(*NET, F.col("gene").alias("src"))
        near = reached().join(going, [*NET, "src"], "left_semi").join(stays.select(*NET, F.col("own").alias("c"), F.lit(True).alias("stays")), [*NET, "c"], "left")
        to = F.min(F.when(F.col("stays"), F.struct("e", "c"))).over(Window.partitionBy(*NET, "src"))  # a gene's rows: one a neighbouring cluster
        near = near.withColumn("to", to).where(F.col("to").isNull() | (F.col("c") == F.col("to.c")) | (F.col("e") < F.col("to.e")))
        near = stored(near.select(*NET, "src", "c", "e", "to"))
        taken.append(near.select(*NET, "src", "e.dst", "e.d"))
        joined = near.where(F.col("c") == F.col("to.c")).select(*NET, F.col("src").alias("gene"), F.col("c").alias("new"))
        next_own = stored(own.join(stays.withColumn("stays", F.lit(True)), [*NET, "own"], "left").join(joined, [*NET, "gene"], "left").select(*NET, "gene", F.when(F.col("stays"), F.col("own")).otherwise(F.col("new")).alias("own")).where("own IS NOT NULL"))
        # a gene drops its edges to every cluster that it has taken an edge to
        old = own.select(*NET, F.col("gene").alias("dst"), F.col("own").alias("c"))
        gone = live.join(old, [*NET, "dst"]).join(near.select(*NET, "src", "c"), [*NET, "src", "c"], "left_semi").select(*NET, "src", "dst")
        gone = gone.unionByName(gone.select(*NET, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        end = lambda name, c, of=next_own: of.select(*NET, F.col("gene").alias(name), F.col("own").alias(c))
        left = live.join(gone, [*NET, "src", "dst"], "left_anti").join(end("src", "c1"), [*NET, "src"]).join(end("dst", "c2"), [*NET, "dst"])
        live, own = stored(left.where("c1 <> c2").select(*NET, "src", "dst", "d")), next_own
    taken.append(reached().select(*NET, "src", "e.dst", "e.d"))
    rows = taken[0]
    for more in taken[1:]:
        rows = rows.unionByName(more)
    return rows.select(*NET, F.least("src", "dst").alias("gene1"), F.greatest("src", "dst").alias("gene2"), "d").distinct()


def minimum_forest(net: DataFrame, distance: str) -> DataFrame:
    """NET, gene1, gene2, d of the spanning forest of least total distance (ties by gene1, gene2).

    In every round each tree takes its shortest edge out, trees that so meet become one, and of the edges
    between two trees the shortest is left: trees halve at least, hence about log2 of the genes rounds.
    """
    edge = F.struct("d", "gene1", "gene2")
    a, b = F.least("gene1", "gene2"), F.greatest("gene1", "gene2")
    base = net.where("gene1 <> gene2").groupBy(*NET, a.alias("gene1"), b.alias("gene2")).agg(F.min(distance).cast("double").alias("d"))
    live = stored(base.select(*NET, F.col("gene1").alias("a"), F.col("gene2").alias("b"), edge.alias("e")))
    taken = None
    while not live.isEmpty():
        ways = live.select(*NET, "e", F.explode(F.array(F.struct(F.col("a").alias("tree"), F.col("b").alias("to")), F.struct(F.col("b").alias("tree"), F.col("a").alias("to")))).alias("w"))
        best = ways.groupBy(*NET, "w.tree").agg(F.min(F.struct("e", F.col("w.to").alias("to"))).alias("m")).select(*NET, "tree", "m.e", "m.to")
        best = stored(best)
        new = best.select(*NET, "e").distinct()
        taken = new if taken is None else taken.unionByName(new)
        # two trees that took the same edge: the smaller is the root
        back = best.select(*NET, F.col("tree").alias("to"), F.col("to").alias("back"))
        up = stored(best.join(back, [*NET, "to"]).select(*NET, "tree", F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("up")))
        while True:
            jump = up.select(*NET, F.col("tree").alias("up"), F.col("up").alias("far"))
            step = stored(up.join(jump, [*NET, "up"]).select(*NET, "tree", "up", "far"))
            up = step.select(*NET, "tree", F.col("far").alias("up"))
            if step.where("up <> far").isEmpty():
                break
        name = lambda old, c: up.select(*NET, F.col("tree").alias(old), F.col("up").alias(c))
        moved = live.join(name("a", "x"), [*NET, "a"]).join(name("b", "y"), [*NET, "b"]).where("x <> y")
        live = stored(moved.groupBy(*NET, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e")))
    if taken is None:
        return base
    return taken.select(*NET, "e.gene1", "e.gene2", "e.d")
