"""Centralities from shortest paths and from the leading eigenvector, as loops of joins.

A breadth-first search runs from all sources of all networks at once.  A neighbour of level d lies
in level d - 1, d or d + 1, so a new level is checked against the last two levels only.  Closeness
and betweenness need every pair of a component, in any engine; ``sources`` bounds that by choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, components, cut, stored
from .network import NET, endpoints

STATE = [*NET, "source", "gene"]
#: So many rows of at most a few hundred numbers are broadcast, more are joined by shuffles.
MANY_NETWORKS = 5000
#: Components of up to so many edges, counted from both ends, are solved in a task: about 100 MB.
TOGETHER = 200_000
#: Eigenvalues that differ by less than this share count as equal.
TIE = 1e-12


def levels(net: DataFrame, sources: DataFrame | None = None) -> list[DataFrame]:
    """For each distance from 0, the (NET, source, gene) at it with paths, their shortest paths."""
    edges = cut(both_ways(net).distinct())
    start = sources if sources is not None else edges.select(*NET, F.col("src").alias("gene")).distinct()
    found = [cut(start.select(*NET, F.col("gene").alias("source"), "gene", F.lit(1.0).alias("paths")))]
    while True:
        reached = found[-1].join(edges.withColumnRenamed("src", "gene"), [*NET, "gene"]).groupBy(*NET, "source", F.col("dst").alias("gene")).agg(F.sum("paths").alias("paths"))
        for seen in found[-2:]:
            reached = reached.join(seen.select(*STATE), STATE, "left_anti")
        reached = cut(reached)
        if reached.isEmpty():
            return found
        found.append(reached)


def closeness(net: DataFrame, component_scaling: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """1 / sum of distances within the component; scaled, (r - 1)^2 / (n - 1) times that for the r
    nodes of a component among n of the network."""
    far = None
    for d, level in enumerate(levels(net, sources)):
        own = level.groupBy(*NET, "source").agg((F.count(F.lit(1)) * d).alias("far"), F.count(F.lit(1)).alias("seen"))
        far = own if far is None else far.unionByName(own)
    sums = far.groupBy(*NET, F.col("source").alias("gene")).agg(F.sum("far").alias("far"), F.sum("seen").alias("seen")).where("far > 0")
    if not component_scaling:
        return sums.select(*NET, "gene", (1 / F.col("far")).alias("value"))
    n = endpoints(net).groupBy(*NET).agg(F.countDistinct("gene").alias("n"))
    r = F.col("seen") - 1
    return sums.join(n, NET).select(*NET, "gene", (r * r / (F.col("far") * (F.col("n") - 1))).alias("value"))


def betweenness(net: DataFrame) -> DataFrame:
    """Shortest paths through a node, each pair counted once, divided among equal paths."""
    net = cut(net)
    edges = cut(both_ways(net).distinct())
    found = levels(net)
    total = found[0].select(*NET, "gene", F.lit(0.0).alias("share"))
    below = None
    for before, level in reversed(list(zip(found, found[1:], strict=False))):
        at = level.withColumn("share", F.lit(0.0)) if below is None else level.join(below, STATE, "left").fillna(0.0, ["share"])
        at = cut(at)
        total = total.unionByName(at.select(*NET, "gene", "share"))
        up = at.join(edges.withColumnRenamed("src", "gene"), [*NET, "gene"]).select(*NET, "source", F.col("dst").alias("gene"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        below = up.join(before, STATE).groupBy(*STATE).agg((F.sum("part") * F.first("paths")).alias("share"))
    return total.groupBy(*NET, "gene").agg((F.sum("share") / 2).alias("value"))


def eigenvector(net: DataFrame, steps: int = 24, kept: int = 8, restarts: int = 24, tolerance: float = 1e-8, together: int = TOGETHER) -> DataFrame:
    """Weighted eigenvector centrality, largest value 1.

    A network's leading eigenvector is that of its components with the greatest eigenvalue, 0 elsewhere.  With weights
    of at least 0 a component's lies between the longest row of A and the root of the largest row sum of A A, so
    most components are known to be short of another one.  Of the rest each is solved by itself: up to
    ``together`` edges (counted from both ends) in a task, larger ones by products of tables.  Components that tie share the
    vector as the ones that a power iteration begins with do.
    """
    edges = stored(both_ways(net, "lls").groupBy(*NET, "src", "dst").agg(F.sum("lls").cast("double").alias("lls")))
    owner = components(edges.where("src <= dst").select(*NET, F.col("src").alias("gene1"), F.col("dst").alias("gene2")))
    sums = edges.groupBy(*NET, F.col("src").alias("gene")).agg(F.sum(F.abs("lls")).alias("s"), F.sum(F.col("lls") * F.col("lls")).alias("squares"), F.min("lls").alias("least"), F.count(F.lit(1)).alias("n"))
    sums = stored(sums.join(owner, [*NET, "gene"]))
    wide = edges.join(sums.select(*NET, F.col("gene").alias("dst"), "s"), [*NET, "dst"]).groupBy(*NET, F.col("src").alias("gene")).agg(F.sum(F.abs("lls") * F.col("s")).alias("wide"))
    bounds = sums.join(wide, [*NET, "gene"]).groupBy(*NET, "component").agg(F.max("wide").alias("most"), F.max("squares").alias("squares"), F.min("least").alias("least"), F.sum("n").alias("n"))
    bounds = stored(bounds)
    floor = bounds.groupBy(*NET).agg(F.when(F.min("least") >= 0, F.max("squares")).otherwise(F.lit(0.0)).alias("floor"))
    left = bounds.join(floor, NET).where(F.col("most") >= F.col("floor") * (1 - TIE)).select(*NET, "component", "n")
    live = stored(edges.join(owner.join(left, [*NET, "component"]).withColumnRenamed("gene", "src"), [*NET, "src"]).select(*NET, "component", "n", "src", "dst", "lls"))
    gene = net.schema["gene1"].dataType.simpleString()
    found = live.where(F.col("n") <= together).groupBy(*NET, "component").applyInArrow(lambda table: leading(table, steps, kept, restarts, tolerance), f"celltype string, condition string, gene {gene}, x double, theta double")
    large = live.where(F.col("n") > together).select(*NET, "src", "dst", "lls")
    if not large.isEmpty():
        found = found.unionByName(leading_by_products(large, steps, kept, restarts, tolerance))
    found = stored(found)
    best = found.groupBy(*NET).agg(F.max("theta").alias("best"))
    found = found.join(best, NET).where(F.col("theta") >= F.col("best") - TIE * F.abs("best"))
    top = found.groupBy(*NET).agg(F.max(F.abs("x")).alias("top"))
    value = found.join(top, NET).select(*NET, "gene", (F.col("x") / F.col("top")).alias("value"))
    return sums.select(*NET, "gene").join(value, [*NET, "gene"], "left").select(*NET, "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def leading(table: pa.Table, steps: int, kept: int, restarts: int, tolerance: float) -> pa.Table:
    """NET, gene, x, theta: the leading eigenvalue of one component's edges and its vector, as long as ones project on it."""
    src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "lls"))
    genes, src = np.unique(src, return_inverse=True)
    dst = np.searchsorted(genes, dst)
    order = np.lexsort((dst, src))  # so that equal components have equal figures
    src, dst, w = src[order], dst[order], w[order]
    v = images = np.empty((0, len(genes)))
    x, last = np.ones(len(genes)), np.inf
    for _ in range(restarts):
        while len(v) < steps:
            rest = x - (v @ x) @ v
            rest -= (v @ rest) @ v
            if not np.linalg.norm(rest) > 1e-14 * np.linalg.norm(x):
                break  # the basis spans all that ones reach
            v = np.vstack([v, rest / np.linalg.norm(rest)])
            x = np.bincount(src, w * v[-1][dst], len(genes))
            images = np.vstack([images, x])
        h = v @ images.T
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1][:kept], turn[:, ::-1][:, :kept]
        v, images = turn.T @ v, turn.T @ images
        x = images[0] - theta[0] * v[0]
        off = np.linalg.norm(x) / max(abs(theta[0]), 1e-300)
        # it goes on as far as doubles do, so that components that tie are told from those that nearly do
        if off <= 1e-14 or (off <= tolerance and off > last / 2):
            break
        last = off
    if off > tolerance and np.linalg.norm(x) > 0:
        raise ArithmeticError(f"no eigenvector within {tolerance} after {restarts} bases of {steps} products")
    first = table.slice(0, 1)
    own = [pa.array([first.column(c)[0].as_py()] * len(genes), pa.string()) for c in NET]
    return pa.Table.from_arrays([*own, pa.array(genes, table.schema.field("src").type), pa.array(v[0] * v[0].sum()), pa.array(np.full(len(genes), theta[0]))], names=[*NET, "gene", "x", "theta"])


def leading_by_products(edges: DataFrame, steps: int, kept: int, restarts: int, tolerance: float) -> DataFrame:
    """``leading`` of all networks (NET, src, dst, lls) at once, NET, gene, x, theta.

    Rayleigh-Ritz on a Krylov basis of each network.  A node keeps its entries
    of the basis V and of W = A V as arrays; a step is one product of the adjacency table with the
    newest vector (a join and a sum) and one row of dot products a network.  After ``steps`` products
    the small problem of each network (Gram matrices of V and W, one row) is solved in a task, and its
    ``kept`` leading Ritz vectors and the residual of the first start the next basis.  A network is
    done when |A x - t x| <= ``tolerance`` t |x|; the others go on, and ``restarts`` bases without an end raise.
    """
    nodes = edges.select(*NET, F.col("src").alias("gene")).distinct()
    no_vectors = F.array().cast("array<double>")
    # the leading eigenvector has one sign, so it is not orthogonal to ones
    rows = nodes.select(*NET, "gene", no_vectors.alias("v"), no_vectors.alias("w"), F.lit(1.0).alias("x"))
    # figures of networks, one row each, go to all tasks where their number allows it
    few = nodes.select(*NET).distinct().count() <= MANY_NETWORKS
    spread = F.broadcast if few else lambda df: df
    size, done = 0, None
    for _ in range(restarts):
        while size < steps:
            rows, size = krylov_step(rows, edges, spread), size + 1
        ritz = spread(ritz_vectors(rows, kept))
        mix = lambda name, i: F.expr(f"aggregate(zip_with({name}, s[{i}], (a, b) -> a * b), 0D, (a, b) -> a + b)")
        turned = rows.join(ritz, NET).select(*NET, "gene", "theta", F.array(*[mix("v", i) for i in range(kept)]).alias("v"), F.array(*[mix("w", i) for i in range(kept)]).alias("w"))
        rows = cut(turned.withColumn("x", F.expr("w[0] - theta * v[0]")))
        size = kept
        left = rows.groupBy(*NET).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("r"), (F.first("theta") * F.sqrt(F.sum(F.expr("v[0] * v[0]")))).alias("t"))
        open_nets = cut(left.where(~(F.col("r") <= tolerance * F.col("t"))).select(*NET))
        ready = rows.join(spread(open_nets), NET, "left_anti").select(*NET, "gene", F.expr("v[0]").alias("x"), "theta")
        done = ready if done is None else done.unionByName(ready)
        if open_nets.isEmpty():
            scale = done.groupBy(*NET).agg((F.sum("x") / F.sum(F.col("x") * F.col("x"))).alias("scale"))
            return done.join(spread(scale), NET).select(*NET, "gene", (F.col("x") * F.col("scale")).alias("x"), "theta")
        rows = rows.join(spread(open_nets), NET, "left_semi").drop("theta")
        edges = cut(edges.join(spread(open_nets), NET, "left_semi"))
    raise ArithmeticError(f"no eigenvector within {tolerance} after {restarts} bases of {steps} products")


def krylov_step(rows: DataFrame, edges: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Make x (NET, gene, v, w, x) orthogonal to the vectors in v, append it to v and its product to w;
    the product is the next x."""
    # one row a network and vector of the basis, x itself last, so that every step has the same plan
    dots = rows.select(*NET, "x", F.posexplode(F.array_append("v", F.col("x"))).alias("i", "y")).groupBy(*NET, "i").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("y") * F.col("y")).alias("g"))
    dots = dots.groupBy(*NET).agg(F.array_sort(F.collect_list(F.struct("i", "d", "g"))).alias("p"))
    dots = dots.select(*NET, F.expr("transform(slice(p, 1, size(p) - 1), q -> if(q.g > 0, q.d / q.g, 0D))").alias("c"), F.expr("element_at(p, -1).d").alias("own"), "p")
    # what is left of its length, by which it is scaled; the small problem takes lengths as they are
    dots = dots.select(*NET, "c", "own", F.expr("own - aggregate(zip_with(c, slice(p, 1, size(p) - 1), (a, q) -> a * q.d), 0D, (a, b) -> a + b)").alias("new"))
    less = F.expr("x - aggregate(zip_with(v, c, (a, b) -> a * b), 0D, (a, b) -> a + b)")
    # where the basis spans all that the network has, zeros follow
    unit = F.when(F.col("new") > 1e-14 * F.col("own"), less / F.sqrt("new")).otherwise(F.lit(0.0))
    made = rows.join(spread(dots), NET).select(*NET, "gene", F.array_append("v", unit).alias("v"), "w")
    product = edges.join(made.select(*NET, F.col("gene").alias("src"), F.element_at("v", -1).alias("x")), [*NET, "src"]).groupBy(*NET, F.col("dst").alias("gene")).agg(F.sum(F.col("lls") * F.col("x")).alias("x"))
    return cut(made.join(product, [*NET, "gene"]).select(*NET, "gene", "v", F.array_append("w", F.col("x")).alias("w"), "x"))


def ritz_vectors(rows: DataFrame, kept: int) -> DataFrame:
    """NET, theta, s: for each network the leading Ritz value and the ``kept`` leading vectors of
    coefficients, from the Gram matrices V'V and V'W of its basis, added up task by task."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            v, w = (np.array(batch.column(i).to_pylist(), float) for i in (2, 3))
            for key in dict.fromkeys(keys):
                own = np.array([k == key for k in keys])
                found[key] = np.concatenate([(v[own].T @ v[own]).ravel(), (v[own].T @ w[own]).ravel()]).tolist()
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=[*NET, "m"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            theta, s = [], []
            for m in batch.column(2).to_pylist():
                m = np.array([x["m"] for x in m])
                size = int(np.sqrt(len(m) / 2))
                g, h = m.reshape(2, size, size)
                length, axes = np.linalg.eigh((g + g.T) / 2)
                axes = axes[:, length > 1e-10 * length[-1]] / np.sqrt(length[length > 1e-10 * length[-1]])
                values, vectors = np.linalg.eigh(axes.T @ (h + h.T) @ axes / 2)
                vectors = (axes @ vectors)[:, ::-1][:, :kept]
                theta.append(float(values[-1]))
                s.append(np.pad(vectors, ((0, 0), (0, kept - vectors.shape[1]))).T.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(theta, pa.float64()), pa.array(s, pa.list_(pa.list_(pa.float64())))], names=[*NET, "theta", "s"])

    parts = rows.select(*NET, "v", "w").mapInArrow(grams, "celltype string, condition string, m array<double>")
    sums = parts.select(*NET, F.posexplode("m").alias("i", "m")).groupBy(*NET, "i").agg(F.sum("m").alias("m"))
    small = sums.groupBy(*NET).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    return small.mapInArrow(solve, "celltype string, condition string, theta double, s array<array<double>>")
