"""Labels on networks: propagation by enrichment, and association between labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, cut
from .network import NET
from .statistics import hypergeometric_log10


def neighbour_enrichment(net: DataFrame, labels: DataFrame, inertia: float = 0.0) -> DataFrame:
    """NET, gene, label, log_p: Bernstein bound (nats) of a label among a node's neighbours.

    ``labels``: NET, gene, label for all nodes, negative where unknown.  ``inertia`` is the weight
    of a node's own label.  Labels at or below their expectation have no row.
    """
    edges = both_ways(net, "lls")
    if inertia > 0:
        edges = edges.unionByName(labels.select(*NET, F.lit(float(inertia)).alias("lls"), F.col("gene").alias("src"), F.col("gene").alias("dst")))
    n = labels.groupBy(*NET).agg(F.count(F.lit(1)).alias("n"))
    share = labels.where("label >= 0").groupBy(*NET, "label").agg(F.count(F.lit(1)).alias("k")).join(n, NET).select(*NET, "label", "n", (F.col("k") / F.col("n")).alias("p"))
    node = edges.groupBy(*NET, F.col("dst").alias("gene")).agg(F.sum("lls").alias("w"), F.sum(F.col("lls") * F.col("lls")).alias("w2"), F.max("lls").alias("top"))
    seen = edges.join(labels.where("label >= 0").withColumnRenamed("gene", "src"), [*NET, "src"]).groupBy(*NET, F.col("dst").alias("gene"), "label").agg(F.sum("lls").alias("own"))
    rows = seen.join(node, [*NET, "gene"]).join(share, [*NET, "label"])
    over = F.col("n") * F.col("own") / F.col("w") - F.col("p") * F.col("n")
    spread = F.col("p") * F.col("n") * F.col("n") * F.col("w2") / (F.col("w") * F.col("w"))
    bound = over * over / (2 * (spread + over * (F.col("n") * F.col("top") / F.col("w")) / 3))
    return rows.where(over > 0).select(*NET, "gene", "label", bound.alias("log_p"))


def propagate_labels(net: DataFrame, labels: DataFrame, inertia: float = 0.0, rounds: int = 3, least: float = 3.0, fixed: DataFrame | None = None) -> DataFrame:
    """Labels after nodes took the label most enriched around them, where its bound is over
    ``least``; nodes in ``fixed`` (NET, gene) keep theirs.  Ties go to the smallest label."""
    net, labels = cut(net), cut(labels)
    for _ in range(rounds):
        best = neighbour_enrichment(net, labels, inertia).groupBy(*NET, "gene").agg(F.max(F.struct(F.round("log_p", 9).alias("log_p"), (-F.col("label")).alias("label"))).alias("best"))
        best = best.where(F.col("best.log_p") > least).select(*NET, "gene", (-F.col("best.label")).alias("new"))
        if fixed is not None:
            best = best.join(fixed, [*NET, "gene"], "left_anti")
        labels = cut(labels.join(best, [*NET, "gene"], "left").select(*NET, "gene", F.coalesce("new", "label").alias("label")))
    return labels


def infer_missing(net: DataFrame, labels: DataFrame, rounds: int = 3, least: float = 3.0) -> DataFrame:
    """Propagation that changes unknown labels only."""
    return propagate_labels(net, labels, rounds=rounds, least=least, fixed=labels.where("label >= 0").select(*NET, "gene"))


def without_small(labels: DataFrame, least: int) -> DataFrame:
    """Labels of fewer than ``least`` nodes of a network become unknown (-1)."""
    few = labels.groupBy(*NET, "label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") < least)
    return labels.join(few, [*NET, "label"], "left").select(*NET, "gene", F.when(F.col("size").isNotNull(), -1).otherwise(F.col("label")).alias("label"))


def label_association(rows: DataFrame, a: str, b: str, cap: float = 300.0) -> DataFrame:
    """a, b, shared, log10_p of each pair of labels that meet: hypergeometric upper tail."""
    shared = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"))
    total = shared.agg(F.sum("shared").alias("n"))
    by = lambda c, name: shared.groupBy(c).agg(F.sum("shared").alias(name))
    sized = shared.join(by(a, "n_a"), a).join(by(b, "n_b"), b).crossJoin(F.broadcast(total))  # one row
    p = hypergeometric_log10(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("shared"))
    return sized.select(a, b, "shared", F.least(F.lit(cap), p).alias("log10_p"))
