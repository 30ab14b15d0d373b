"""Networks as long tables: NET keys, gene1, gene2, weights.  All operators are lazy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NET = ["celltype", "condition"]
#: Prefixes of ribosomal, mitochondrial ribosomal and NDUF genes.
RIBOSOMAL = "^(M?RP[SL]|NDUF)"


def canonical(edges: DataFrame) -> DataFrame:
    """Endpoints in order, self-loops gone, the heaviest of repeated edges kept."""
    a, b = F.least("gene1", "gene2"), F.greatest("gene1", "gene2")
    keys = [c for c in edges.columns if c not in ("gene1", "gene2", "scinet_weight", "lls")]
    weights = [c for c in ("scinet_weight", "lls") if c in edges.columns]
    return edges.where("gene1 <> gene2").groupBy(*keys, a.alias("gene1"), b.alias("gene2")).agg(*[F.max(w).alias(w) for w in weights])


def align(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """Edges that the reference network has, with its lls."""
    return edges.join(reference, ["gene1", "gene2"]).select(*NET, "gene1", "gene2", "lls", "scinet_weight")


def block_pairs(nodes: DataFrame, blocks: list[str], values: list[str]) -> DataFrame:
    """Pairs of nodes (``blocks``, gene and other ``values``, named with 1 and 2) of the same blocks, gene1 before gene2."""
    side = lambda k: nodes.select(*blocks, *[F.col(v).alias(f"{v}{k}") for v in values])
    return side(1).join(side(2), blocks).where("gene1 < gene2")


def endpoints(edges: DataFrame, *values: str) -> DataFrame:
    """One row per edge and endpoint, in one pass over the edges."""
    return edges.select(*NET, *values, F.explode(F.array("gene1", "gene2")).alias("gene"))


def strength(net: DataFrame, weight: str = "lls") -> DataFrame:
    return endpoints(net, weight).groupBy(*NET, "gene").agg(F.sum(weight).alias("value"))


def degree(net: DataFrame) -> DataFrame:
    return endpoints(net).groupBy(*NET, "gene").agg(F.count(F.lit(1)).alias("degree"))


def drop_ribosomal(centrality: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Applied to nodes after centrality and before ranks, never to edges, so that neighbours keep
    their weight.  ``symbol`` is a gene's name where "gene" is not."""
    name = F.col("gene").cast("string") if symbol is None else symbol
    return centrality.where(~name.rlike(RIBOSOMAL))


def percent_rank(centrality: DataFrame) -> DataFrame:
    return centrality.withColumn("pr", F.percent_rank().over(Window.partitionBy(*NET).orderBy("value")))


def average_rank(centrality: DataFrame) -> DataFrame:
    """Rank over n with ties at their mean."""
    net, ties = Window.partitionBy(*NET), Window.partitionBy(*NET, "value")
    rank = F.rank().over(net.orderBy("value")) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return centrality.withColumn("pr", rank / F.count(F.lit(1)).over(net))


def top_hub(ranked: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*NET).orderBy(F.desc("pr"), "gene")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_matrix(ranked: DataFrame, genes: DataFrame, columns: list[str]) -> DataFrame:
    """Genes by cell type, 0 where a gene isn't in the network; ``genes`` completes the rows."""
    wide = ranked.groupBy("gene").pivot("celltype", columns).agg(F.first("pr"))
    all_genes = ranked.select("gene").union(genes.select("gene")).distinct()
    return all_genes.join(wide, "gene", "left").fillna(0.0, columns)


def diff_pr(ranked: DataFrame, control: str, disease: str) -> DataFrame:
    """Percentile rank in the disease minus that in the control, by cell type."""
    side = lambda c, name: ranked.where(F.col("condition") == c).select("celltype", "gene", F.col("pr").alias(name))
    both = side(control, "control_pr").join(side(disease, "disease_pr"), ["celltype", "gene"], "full_outer").fillna(0.0, ["control_pr", "disease_pr"])
    both = both.where("NOT (control_pr = 0 AND disease_pr = 0)").withColumn("diff", F.col("disease_pr") - F.col("control_pr"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("celltype").orderBy(F.desc(F.abs("diff")), "gene")))


def top_diff_hub(diff: DataFrame, share: float) -> DataFrame:
    """Genes whose rank among non-zero differences is below a share of them."""
    some = diff.where("diff <> 0").drop("rank")
    w = Window.partitionBy("celltype")
    top = F.row_number().over(w.orderBy(F.desc(F.abs("diff")), "gene")) / F.count(F.lit(1)).over(w)
    return some.withColumn("top", top).where(F.col("top") < share)


def network_stats(net: DataFrame) -> DataFrame:
    nodes = endpoints(net).groupBy(*NET).agg(F.countDistinct("gene").alias("nodes"))
    edges = net.groupBy(*NET).agg(F.count(F.lit(1)).alias("edges"))
    n, m = F.col("nodes"), F.col("edges")
    return nodes.join(edges, NET).select(*NET, "nodes", "edges", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"), (2 * m / n).alias("average_degree"))


def filter_by_size(net: DataFrame, least: int, most: int | None = None) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*NET))
    sized = net.withColumn("n_edges", n).where(F.col("n_edges") >= least)
    return sized if most is None else sized.where(F.col("n_edges") <= most)


def edge_threshold(net: DataFrame, least: float) -> DataFrame:
    return net.where(F.col("scinet_weight") >= least)


def quantile_cut(net: DataFrame, share: float) -> DataFrame:
    """Edges above the share's quantile of the weights of their network (linear interpolation)."""
    cut = net.groupBy(*NET).agg(F.percentile("scinet_weight", F.lit(share)).alias("cut"))
    return net.join(cut, NET).where("scinet_weight > cut")


def ego(net: DataFrame, genes: list) -> DataFrame:
    return net.where(F.col("gene1").isin(genes) | F.col("gene2").isin(genes))


def overlap(net: DataFrame, control: str, disease: str) -> DataFrame:
    """Jaccard, overlap and Dice coefficients of the genes of two conditions."""
    genes = endpoints(net).where(F.col("condition").isin(control, disease)).distinct()
    by = genes.groupBy("celltype", "gene").agg(F.count_if(F.col("condition") == control).alias("a"), F.count_if(F.col("condition") == disease).alias("b"))
    n = by.groupBy("celltype").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    c, a, b = F.col("both"), F.col("a"), F.col("b")
    return n.select("celltype", ratio(c, a + b - c).alias("jaccard"), ratio(c, F.least(a, b)).alias("overlap"), ratio(2 * c, a + b).alias("dice"))


def set_connectivity(net: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges with both ends in a set, by network and set; sets and networks without any are absent."""
    a = sets.select("set_name", F.col("gene").alias("gene1"))
    b = sets.select("set_name", F.col("gene").alias("gene2"))
    return net.join(a, "gene1").join(b, ["gene2", "set_name"]).groupBy(*NET, "set_name").agg(F.count(F.lit(1)).alias("connectivity"))


def set_connectivity_filled(net: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_connectivity`` with a row for every network and set, 0 where a set has no edge.  The names of the networks
    are one row, so that the sets stay where they are."""
    names = net.select(*NET).distinct().agg(F.collect_list(F.struct(*NET)).alias("n"))
    every = sets.select("set_name").distinct().join(F.broadcast(names), F.lit(True)).select("set_name", F.inline("n"))
    return every.join(set_connectivity(net, sets), [*NET, "set_name"], "left").select(*NET, "set_name", F.coalesce("connectivity", F.lit(0)).alias("connectivity"))


def reference_connectivity(reference: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges of the reference network within each set, with the set's size and the genes in it that
    the network has; 0 where there are none."""
    a = sets.select("set_name", F.col("gene").alias("gene1"))
    b = sets.select("set_name", F.col("gene").alias("gene2"))
    edges = reference.join(a, "gene1").join(b, ["gene2", "set_name"]).groupBy("set_name").agg(F.count(F.lit(1)).alias("connectivity"))
    known = reference.select(F.explode(F.array("gene1", "gene2")).alias("gene")).distinct()
    found = sets.join(known, "gene", "left_semi").groupBy("set_name").agg(F.count(F.lit(1)).alias("detected"))
    size = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("size"))
    return size.join(found, "set_name", "left").join(edges, "set_name", "left").fillna(0, ["detected", "connectivity"])


def block_connectivity(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``reference_connectivity`` for a reference that joins all genes of a block (gene, block) pairwise: pairs are counted
    from the sizes of blocks and never made."""
    nodes = nodes.where("gene IS NOT NULL AND block IS NOT NULL").groupBy("gene", "block").agg(F.count(F.lit(1)).alias("times"))
    inside = nodes.join(sets, "gene").groupBy("set_name", "block", "gene").agg(F.sum("times").alias("k"))
    # a gene has no edge with itself, however often it is listed
    pairs = inside.groupBy("set_name", "block").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("pairs"))
    edges = pairs.groupBy("set_name").agg(F.sum("pairs").alias("connectivity"))
    found = sets.join(joined_in_blocks(nodes), "gene", "left_semi").groupBy("set_name").agg(F.count(F.lit(1)).alias("detected"))
    size = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("size"))
    return size.join(found, "set_name", "left").join(edges, "set_name", "left").fillna(0, ["detected", "connectivity"])


def joined_in_blocks(nodes: DataFrame) -> DataFrame:
    """gene: those of ``nodes`` (gene, block; each once) that share a block with another."""
    large = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.join(large, "block", "left_semi").select("gene").distinct()


def connectivity(net: DataFrame, sets: DataFrame) -> DataFrame:
    """Mean degree, edges and density of the subgraph that each set induces; 0 under two genes."""
    seen = endpoints(net).distinct().join(sets, "gene").groupBy(*NET, "set_name").agg(F.count(F.lit(1)).alias("present"))
    rows = seen.join(set_connectivity(net, sets), [*NET, "set_name"], "left").fillna(0, ["connectivity"])
    n, e, able = F.col("present"), F.col("connectivity"), F.col("present") >= 2
    value = lambda x: F.when(able, x).otherwise(F.lit(0.0))
    return rows.select(*NET, "set_name", "present", F.when(able, e).otherwise(0).alias("edges"), value(2 * e / n).alias("mean_degree"), value(2 * e / (n * (n - 1))).alias("density"))


def set_counts(sets: DataFrame) -> DataFrame:
    """In how many sets each gene is, and how many genes are in so many sets."""
    per = sets.distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("sets"))
    return per.groupBy("sets").agg(F.count(F.lit(1)).alias("genes"))


def set_patterns(sets: DataFrame) -> DataFrame:
    """pattern, sets, genes: how many genes are in exactly these sets (their names in order, joined by &)."""
    per = sets.distinct().groupBy("gene").agg(F.array_sort(F.collect_list("set_name")).alias("of"))
    return per.groupBy(F.array_join("of", "&").alias("pattern"), F.size("of").alias("sets")).agg(F.count(F.lit(1)).alias("genes"))


def difference_shares(net: DataFrame, control: str, disease: str, genes: DataFrame) -> DataFrame:
    """celltype, side, genes, inside, share: the genes of ``gene_differences`` on each side and how many of them are among
    ``genes`` (gene)."""
    marked = gene_differences(net, control, disease).join(genes.select("gene").distinct().withColumn("hit", F.lit(1)), "gene", "left")
    out = marked.groupBy("celltype", "side").agg(F.count(F.lit(1)).alias("genes"), F.count("hit").alias("inside"))
    return out.withColumn("share", F.col("inside") / F.col("genes"))


def gene_differences(net: DataFrame, control: str, disease: str) -> DataFrame:
    """Genes of a cell type only in the control, in both, or only in the disease network."""
    genes = endpoints(net).where(F.col("condition").isin(control, disease)).groupBy("celltype", "gene").agg(F.count_if(F.col("condition") == control).alias("a"), F.count_if(F.col("condition") == disease).alias("b"))
    side = F.when(F.col("b") == 0, "control").when(F.col("a") == 0, "disease").otherwise("both")
    return genes.select("celltype", "gene", side.alias("side"))


def deconvolute(net: DataFrame, sets: DataFrame) -> DataFrame:
    """Connectivity per detected gene, with set sizes; sets without any edge are dropped."""
    seen = endpoints(net).distinct().join(sets, "gene").groupBy(*NET, "set_name").agg(F.count(F.lit(1)).alias("detected"))
    size = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("size"))
    joined = seen.join(set_connectivity(net, sets), [*NET, "set_name"], "left").join(size, "set_name").fillna(0, ["connectivity"])
    total = F.sum("connectivity").over(Window.partitionBy("set_name"))
    return joined.withColumn("total", total).where("total > 0").select(*NET, "set_name", "size", "detected", "connectivity", (F.col("connectivity") / F.col("detected")).alias("normalised"))


def membership(net: DataFrame, conditions: list[str]) -> DataFrame:
    """Edges of a cell type with a 0/1 column per condition."""
    return net.groupBy("celltype", "gene1", "gene2").agg(*[F.max(F.when(F.col("condition") == c, 1).otherwise(0)).alias(f"in_{c.lower()}") for c in conditions])


def adjusted(p: Column, by: list[str], order: list[str], method: str) -> Column:
    """Adjusted p-values: bonferroni, bh, by, holm or hochberg."""
    w = Window.partitionBy(*by)
    n, rank = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(p, *order))
    down = w.orderBy(p.desc(), *[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    up = w.orderBy(p, *order).rowsBetween(Window.unboundedPreceding, 0)
    if method == "bonferroni":
        return F.least(F.lit(1.0), p * n)
    if method == "bh":
        return F.least(F.lit(1.0), F.min(F.col("_p_n_r")).over(down))
    if method == "by":
        return F.least(F.lit(1.0), F.min(F.col("_p_n_r") * F.col("_h")).over(down))
    if method == "holm":
        return F.least(F.lit(1.0), F.max(F.col("_p_left")).over(up))
    if method == "hochberg":
        return F.least(F.lit(1.0), F.min(F.col("_p_left")).over(down))
    raise ValueError(method, rank)


def simes_values(x: np.ndarray) -> np.ndarray:
    """For m from 1 the least m y_j / j over the m largest y of ``x`` (ascending).

    y_j / j is the slope from (n - m, 0) to the point (n - m + j, y_j), and the least slope touches the lower
    hull of the last m points, on which it is found by halving.
    """
    n = len(x)
    y, hull, out = x.tolist(), [], np.empty(n)  # the hull's points, the leftmost last
    for left in range(n - 1, -1, -1):
        while len(hull) > 1 and (y[hull[-1]] - y[left]) * (hull[-2] - left) >= (y[hull[-2]] - y[left]) * (hull[-1] - left):
            hull.pop()
        hull.append(left)
        m, low, high = n - left, 0, len(hull) - 1
        while low < high:  # slopes fall towards the touching point from either side
            mid = (low + high) // 2
            if m * y[hull[mid]] / (hull[mid] - left + 1) <= m * y[hull[mid + 1]] / (hull[mid + 1] - left + 1):
                high = mid
            else:
                low = mid + 1
        out[m - 1] = least = m * y[hull[low]] / (hull[low] - left + 1)
        # of points on one line through (n - m, 0), which a side of the hull lies on for one m, rounding picks the least
        if least > 0 and any(abs(m * y[hull[k]] / (hull[k] - left + 1) - least) <= 4e-16 * least for k in (low - 1, low + 1) if 0 <= k < len(hull)):
            out[m - 1] = (m * x[left:] / np.arange(1, m + 1)).min()
    return out


def hommel(rows: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds p_hommel: the largest, over m, of least(m p, c_m), c_m being the Simes value of the m largest p.

    Needs ``_r``, the rank of p in its group.  One task solves a group, as it orders it for the other methods, in
    memory that grows with its rows.
    """
    kinds = rows.select(*by, "_r", p)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_r")
        x, n = group[p].to_numpy(dtype=float), len(group)
        m = np.arange(1, n + 1)
        simes = simes_values(x)
        # c_m / m falls with m: up to some m least(m p, c_m) is m p, beyond it is c_m
        upto = np.searchsorted(-simes / m, -x, side="right")
        beyond = np.append(np.maximum.accumulate(simes[::-1])[::-1], 0.0)
        best = beyond[np.minimum(upto + 2, n)]
        for at in (np.clip(upto + d, 1, n) for d in (-1, 0, 1, 2)):  # where m p and c_m meet rounding may decide
            best = np.maximum(best, np.minimum(at * x, simes[at - 1]))
        group["p_hommel"] = np.minimum(1.0, best)
        return group.drop(columns=p)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema if f.name != p], "p_hommel double"])
    solved = kinds.groupBy(*by).applyInPandas(solve, schema)
    return rows.join(solved, [*by, "_r"])


def p_adjust(rows: DataFrame, p: str, by: list[str], order: list[str], methods: list[str]) -> DataFrame:
    """Adds a column per method: bonferroni, bh, by, holm, hochberg or hommel."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(p, *order)))
    r = r.withColumn("_p_n_r", F.col(p) * F.col("_n") / F.col("_r")).withColumn("_p_left", (F.col("_n") - F.col("_r") + 1) * F.col(p))
    if "by" in methods:
        r = r.withColumn("_h", F.sum(1 / F.col("_r")).over(w.orderBy(p, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if "hommel" in methods:
        r = hommel(r, p, by)
    for m in methods:
        if m != "hommel":
            r = r.withColumn(f"p_{m}", adjusted(F.col(p), by, order, m))
    return r.drop("_n", "_r", "_p_n_r", "_p_left", "_h")
