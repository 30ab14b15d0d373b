"""Profiles of archetypes, cells and nodes: diffusion, annotation, similarity, adaptive cuts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import hashed_rows
from . import network as N
from .aggregates import combine_log_p, entropy
from .expression import robust_z
from .graph import both_ways, cut, stored
from .hubs import null_strengths, numbered, rewired
from .nulls import TOGETHER, blocks_for, drawn_positions, in_parts, over_edges, over_shuffles, shuffled, shuffled_strengths
from .statistics import score_enrichment

NET = N.NET
#: Rows of a table by network and feature that are sent to all tasks.
FEW = 100_000


def met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` joined with ``groups``, which has a few rows a network and feature.  They go to all tasks while they are
    few: networks times features is a small number of keys, and a shuffle by them deals all rows of one to one task."""
    groups = cut(groups)
    return rows.join(F.broadcast(groups) if groups.count() <= FEW else groups, [*NET, "feature"])


def spread(net: DataFrame, rows: DataFrame, alpha: float = 0.85, rounds: int = 5) -> DataFrame:
    """NET, gene, feature, x: every feature of ``rows`` (the same columns), scaled to sum 1, diffused
    over the network.  Only nodes that a feature reaches have rows, so features stay sparse."""
    edges = both_ways(net, "lls")
    out = edges.groupBy(*NET, "src").agg(F.sum("lls").alias("w"))
    moves = cut(edges.join(out, [*NET, "src"]).select(*NET, "src", "dst", (alpha * F.col("lls") / F.col("w")).alias("p")))
    own = cut(rows.where("x > 0").join(out.withColumnRenamed("src", "gene"), [*NET, "gene"], "left_semi"))
    total = own.groupBy(*NET, "feature").agg(F.sum("x").alias("s"))
    start = cut(met(own, total).select(*NET, "gene", "feature", (F.col("x") / F.col("s")).alias("x")))
    again = start.withColumn("x", (1 - alpha) * F.col("x"))
    for _ in range(rounds):
        moved = moves.join(start.withColumnRenamed("gene", "src"), [*NET, "src"]).select(*NET, F.col("dst").alias("gene"), "feature", (F.col("p") * F.col("x")).alias("x"))
        start = moved.unionByName(again).groupBy(*NET, "gene", "feature").agg(F.sum("x").alias("x"))
    return start


def impute_by_diffusion(net: DataFrame, rows: DataFrame, alpha: float = 0.85, rounds: int = 5) -> DataFrame:
    """Features diffused over the network and scaled so that their maxima are those before."""
    net, rows = cut(net), cut(rows)
    smooth = cut(spread(net, rows, alpha, rounds))
    top = lambda df, name: df.groupBy(*NET, "feature").agg(F.max("x").alias(name))
    scale = top(rows, "was").join(top(smooth, "is"), [*NET, "feature"]).select(*NET, "feature", (F.col("was") / F.col("is")).alias("scale"))
    return met(smooth, scale).select(*NET, "gene", "feature", (F.col("x") * F.col("scale")).alias("x"))


def annotate_by_diffusion(net: DataFrame, rows: DataFrame, markers: DataFrame, alpha: float = 0.85, rounds: int = 5) -> DataFrame:
    """NET, gene, label, score of ``markers`` (label, feature, weight): sums over a label's features
    of w x log2(x / b), with the feature diffused to x, an even start to b, and w the weight times
    the feature's total, of length 1 over the label."""
    net, rows = cut(net), cut(rows)
    nodes = N.endpoints(net).distinct().select(*NET, "gene", F.lit("").alias("feature"), F.lit(1.0).alias("x"))
    even = spread(net, nodes, alpha, rounds).select(*NET, "gene", F.col("x").alias("b"))
    total = rows.groupBy(*NET, "feature").agg(F.sum("x").alias("total"))
    raw = markers.join(total, "feature").select(*NET, "label", "feature", (F.col("weight") * F.col("total")).alias("w"))
    length = raw.groupBy(*NET, "label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    weights = raw.join(length, [*NET, "label"]).where("length > 0").select(*NET, "label", "feature", (F.col("w") / F.col("length")).alias("w"))
    seen = spread(net, rows, alpha, rounds).join(even, [*NET, "gene"]).where("x > 0").select(*NET, "gene", "feature", (F.col("x") * F.log2(F.col("x") / F.col("b"))).alias("s"))
    return met(seen, weights).groupBy(*NET, "gene", "label").agg(F.sum(F.col("w") * F.col("s")).alias("score"))


def sparse_pagerank(net: DataFrame, seeds: DataFrame, alpha: float = 0.85, rho: float = 1e-4, epsilon: float = 1e-3, rounds: int = 20) -> DataFrame:
    """NET, gene, x: PageRank from seeds (NET, gene, x0) with an l1 penalty ``rho``, by accelerated
    proximal steps, until a step is shorter than ``epsilon`` or ``rounds`` have passed."""
    net = cut(net)
    stay = 1 - alpha
    push = (1 - math.sqrt(stay)) / (1 + math.sqrt(stay))
    edges = both_ways(net.where("gene1 <> gene2"), "lls")
    root = edges.groupBy(*NET, F.col("src").alias("gene")).agg(F.sqrt(F.sum("lls")).alias("root"))
    side = lambda c: root.select(*NET, F.col("gene").alias(c), F.col("root").alias(f"r_{c}"))
    walks = cut(edges.join(side("src"), [*NET, "src"]).join(side("dst"), [*NET, "dst"]).select(*NET, "src", F.col("dst").alias("gene"), (F.col("lls") / (F.col("r_src") * F.col("r_dst"))).alias("p")))
    state = root.join(seeds, [*NET, "gene"], "left").select(*NET, "gene", "root", (stay * F.coalesce("x0", F.lit(0.0)) / F.col("root")).alias("u"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    state = cut(state)
    for _ in range(rounds):
        come = walks.join(state.where("y <> 0").select(*NET, F.col("gene").alias("src"), "y"), [*NET, "src"]).groupBy(*NET, "gene").agg(F.sum(F.col("p") * F.col("y")).alias("come"))
        at = (1 - stay) / 2 * (F.col("y") + F.coalesce("come", F.lit(0.0))) + F.col("u")
        new = F.signum(at) * F.greatest(F.abs(at) - stay * rho * F.col("root"), F.lit(0.0))
        step = state.join(come, [*NET, "gene"], "left").withColumn("new", new)
        state = cut(step.select(*NET, "gene", "root", "u", F.col("new").alias("x"), (F.col("new") + push * (F.col("new") - F.col("x"))).alias("y"), (F.col("new") - F.col("x")).alias("moved")))
        if state.agg(F.sqrt(F.sum(F.col("moved") * F.col("moved")))).first()[0] < epsilon:
            break
    return state.select(*NET, "gene", (F.col("x") * F.col("root")).alias("x"))


def adaptive_neighbours(distances: DataFrame, by: list[str], other: str = "other", density: float = 1.0) -> DataFrame:
    """Neighbours (by, other, distance) in order up to the first, k, whose scaled distance exceeds the
    bound (sum + sqrt(k + sum^2 - k * squares)) / k; ties by ``other``."""
    order = Window.partitionBy(*by).orderBy("distance", other).rowsBetween(Window.unboundedPreceding, 0)
    d = F.col("distance") / density
    k, s, q = F.row_number().over(Window.partitionBy(*by).orderBy("distance", other)), F.sum(d).over(order), F.sum(d * d).over(order)
    inside = k + s * s - k * q
    ranked = distances.withColumns({"rank": k, "_bound": F.when(inside >= 0, (s + F.sqrt(F.greatest(inside, F.lit(0.0)))) / k).otherwise(F.lit(0.0))})
    over = F.max((F.col("_bound") < d).cast("int")).over(order)
    return ranked.withColumn("_over", over).where("_over = 0").drop("_bound", "_over")


def double_norm(rows: DataFrame, a: str, b: str, x: str) -> DataFrame:
    """Values over the roots of both margins and then over their maximum; negative values count as
    0, and the logarithm of 1 + x is taken where any value is above 100."""
    v = rows.select(a, b, F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)).alias("v"))
    v = v.join(F.broadcast(v.agg(F.max("v").alias("_top"))), F.lit(True)).select(a, b, F.when(F.col("_top") > 100, F.log1p("v")).otherwise(F.col("v")).alias("v"))  # one row
    root = lambda c: v.groupBy(c).agg(F.sqrt(F.sum("v")).alias(f"_{c}"))
    both = v.where("v > 0").join(root(a), a).join(root(b), b).select(a, b, (F.col("v") / (F.col(f"_{a}") * F.col(f"_{b}"))).alias(x))
    return both.join(F.broadcast(both.agg(F.max(x).alias("_top"))), F.lit(True)).select(a, b, (F.col(x) / F.col("_top")).alias(x))


def cells_from_archetypes(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """cell_id, label, score: weights (cell_id, archetype, weight) times the doubly normalised
    scores (archetype, label, x)."""
    return weights.join(double_norm(scores, "archetype", "label", "x"), "archetype").groupBy("cell_id", "label").agg(F.sum(F.col("weight") * F.col("x")).alias("score"))


def pseudobulk_by_archetypes(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """feature, archetype, value: counts summed with the cells' weights over their mean weight."""
    k = weights.select("archetype").distinct().count()
    mean = weights.groupBy("cell_id").agg((F.sum("weight") / k).alias("mean"))
    share = weights.join(mean, "cell_id").where("mean > 0").select("cell_id", "archetype", (F.col("weight") / F.col("mean")).alias("h"))
    return counts.join(share, "cell_id").groupBy("feature", "archetype").agg(F.sum(F.col("value") * F.col("h")).alias("value"))


def doublet_score(scores: DataFrame, centrality: DataFrame, how: str = "mean", least: float = 1.0) -> DataFrame:
    """cell_id, by_scores, by_centrality, combined, doublet: how far below the median, in robust
    deviations, a cell's entropy over labels (cell_id, label, x) and its centrality (cell_id, c) lie."""
    h = centrality.join(entropy(scores, ["cell_id"], "x"), "cell_id", "left").select("cell_id", "c", F.coalesce("entropy", F.lit(0.0)).alias("h"))
    h = stored(h)
    z = robust_z(h, "h").withColumnRenamed("z", "zh")
    z = robust_z(z, "c").select("cell_id", (-F.col("zh")).alias("by_scores"), (-F.col("z")).alias("by_centrality"))
    a, b = F.col("by_scores"), F.col("by_centrality")
    combined = {"min": F.least(a, b), "max": F.greatest(a, b), "mean": (a + b) / 2}[how]
    return z.withColumn("combined", combined).withColumn("doublet", F.col("combined") > least)


def annotate_by_markers(scores: DataFrame, markers: DataFrame, by: list[str], reps: int = 1000, seed: int = 1) -> DataFrame:
    """by, label, score, z: the sum of ``scores`` (by, gene, x) over a label's markers (label, gene,
    sign) with their signs, against as many genes drawn without repetition, ``reps`` times.

    Draws depend on label and number only, so panels of the same genes meet the same draws."""
    w = Window.partitionBy(*by)
    panel = cut(scores.select(*by, "gene", "x", (F.row_number().over(w.orderBy("gene")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n")))
    own = panel.join(markers.select("label", "gene", "sign"), "gene")
    slots = own.withColumn("slot", F.row_number().over(Window.partitionBy(*by, "label").orderBy("gene")))
    slots = slots.groupBy(*by, "label").agg(F.sum(F.col("sign") * F.col("x")).alias("score"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("slot", F.col("sign").cast("double").alias("sign")))).alias("slots"))
    slots = cut(slots)
    null = null_scores(panel, slots, by, reps, seed).groupBy(*by, "label").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"))
    return slots.join(null, [*by, "label"]).select(*by, "label", "score", F.coalesce(F.try_divide(F.col("score") - F.col("mean"), F.col("sd")), F.lit(0.0)).alias("z"))


#: So many labels of a panel are drawn in a task at a time.
LABELS = 2


def null_scores(panel: DataFrame, slots: DataFrame, by: list[str], reps: int, seed: int) -> DataFrame:
    """by, label, s: the signed sum of each drawn set.  A task draws the sets of some labels of a panel, whose values then
    pass it in parts."""
    n_tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-slots.select("label").distinct().count() // LABELS) or 1
    block = F.pmod(F.xxhash64("label"), F.lit(blocks))
    prefix = F.concat_ws("|", F.lit(seed).cast("string"), F.col("label").cast("string"))
    asked = slots.select(F.struct(*by).alias("own"), block.alias("block"), F.struct("label", prefix.alias("prefix"), "n", F.col("slots.sign").alias("signs")).alias("asked"))
    parts = in_parts(panel, by, panel.groupBy(*by).agg(F.first("n").alias("n")), F.col("pos").alias("pos"), F.col("x").cast("double").alias("x")).select(F.struct(*by).alias("own"), "items")
    # a panel goes where some of its labels are
    parts = parts.join(asked.select("own", "block").distinct(), "own")
    rows = asked.unionByName(parts, allowMissingColumns=True).repartition(n_tasks, "own", "block").sortWithinPartitions("own", "block", F.col("asked").isNull())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block = None
        drawn: list[list] = []

        def result():
            labels = pa.array(np.repeat(np.arange(len(drawn)), reps))
            named = pa.concat_arrays([d[0] for d in drawn]).take(labels)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([own]).take(pa.array(np.zeros(len(labels), int))), named, pa.array(np.concatenate([d[3] for d in drawn]))], names=["own", "label", "s"])

        for batch in batches:
            for i in range(batch.num_rows):
                here, number = batch.column(0).slice(i, 1), batch.column(1)[i].as_py()
                if batch.column(2)[i].is_valid:
                    if own is None or here != own or number != block:
                        if drawn:
                            yield result()
                        own, block, drawn = here, number, []
                    label = batch.column(2).slice(i, 1)
                    prefix, n, signs = (label.field(k)[0].as_py() for k in (1, 2, 3))
                    low, pool = np.zeros(len(signs), np.int64), np.full(len(signs), n, np.int64)
                    named = [f"{prefix}|{rep}".encode() for rep in range(1, reps + 1)]
                    places = np.concatenate([drawn_positions(low, pool, hashed_rows(named[k : k + TOGETHER], len(signs))).astype(np.int32) for k in range(0, reps, TOGETHER)])
                    drawn.append([label.field(0), places, np.array(signs, float), np.zeros(reps)])
                    continue
                items = batch.column(3)[i].values
                pos, x = (items.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                values = np.zeros(max(int(pos.max()), max(int(d[1].max()) for d in drawn)) + 2)  # the last is of draws that ended
                values[pos] = np.nan_to_num(x)
                for d in drawn:
                    for k in range(0, reps, 50):
                        d[3][k : k + 50] += values[d[1][k : k + 50]] @ d[2]
        if drawn:
            yield result()

    kind = dict(panel.select(F.struct(*by).alias("own")).dtypes)["own"]
    found = rows.select("own", "block", "asked", "items").mapInArrow(summed, f"own {kind}, label {dict(slots.dtypes)['label']}, s double")
    return found.select(*[F.col(f"own.{c}").alias(c) for c in by], "label", "s")


def label_autocorrelation(net: DataFrame, labels: DataFrame, reps: int = 100, seed: int = 1) -> DataFrame:
    """NET, phi, z: sum over edges, both ways, of the weight over both labels' shares, positive where
    labels (NET, gene, label) agree and negative else, against ``reps`` shuffles of the labels."""
    labels = stored(labels.select(*NET, "gene", "label"))
    # a label is a number, its order times 2^32, and the count of its nodes
    of = labels.where("label IS NOT NULL").groupBy(*NET, "label").agg(F.count(F.lit(1)).alias("k"))
    of = of.select(*NET, "label", (F.row_number().over(Window.partitionBy(*NET).orderBy("label")).cast("long") * 2**32 + F.col("k")).alias("x"))
    x = stored(labels.join(of, [*NET, "label"], "left").select(*NET, "gene", "x"))
    net = stored(net)
    blocks = blocks_for(net, reps)
    if blocks is None:
        sides = stored(shuffled(x, reps, seed))
        p = lambda v: (v % 2**32) / F.col("n")
        phi = over_edges(net.join(labels.groupBy(*NET).agg(F.count(F.lit(1)).alias("n")), NET), sides, lambda a, b: {"phi": F.sum(F.when(a == b, 2.0).when(a != b, -2.0) * F.col("lls") / (p(a) * p(b)))}, "lls", "n")
    else:

        def agreement(_, x, i, j, w):
            a, b, n = x[i], x[j], len(x)
            return (np.where(a == b, 2.0, -2.0) * w / ((a % 2**32 / n) * (b % 2**32 / n))).sum(), len(w)

        phi = over_shuffles(net, x, reps, seed, blocks, agreement, "phi double, n long").select(*NET, "rep", F.when(F.col("n") > 0, F.col("phi")).alias("phi"))
    own, rand = F.max(F.when(F.col("rep") == 0, F.col("phi"))), F.when(F.col("rep") > 0, F.col("phi"))
    return phi.groupBy(*NET).agg(own.alias("phi"), F.try_divide(own - F.avg(rand), F.stddev_samp(rand)).alias("z"))


def moments(value: np.ndarray) -> list[np.ndarray]:
    """By column its number, the number of rows, their mean and their squares around it (0 where all are equal)."""
    off = value - value[0]
    mean = off.mean(0)
    return [np.arange(value.shape[1], dtype=np.int32), np.full(value.shape[1], len(value)), value[0] + mean, ((off - mean) ** 2).sum(0)]


def merged_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, sd of ``moments`` of blocks."""
    gap = "x.mean - a.mean"
    step = f"(a, x) -> struct(a.n + x.n AS n, a.mean + ({gap}) * x.n / (a.n + x.n) AS mean, a.m2 + x.m2 + ({gap}) * ({gap}) * a.n * x.n / (a.n + x.n) AS m2)"
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))).alias("b")).select(*keys, F.expr(f"aggregate(slice(b, 2, size(b)), b[0], {step})").alias("s"))
    return found.select(*keys, F.col("s.mean").alias("mean"), F.when(F.col("s.n") > 1, F.sqrt(F.col("s.m2") / (F.col("s.n") - 1))).alias("sd"))


def topological_specificity(net: DataFrame, reps: int = 100, seed: int = 1) -> DataFrame:
    """NET, gene, z, specificity: strength against the same edges with weights shuffled ``reps``
    times, and its logistic function."""
    net = cut(net)
    blocks = blocks_for(net, reps)
    if blocks is None:
        null = null_strengths(rewired(net, reps, 0.0, seed)).groupBy(*NET, "i").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    else:
        null = merged_moments(shuffled_strengths(net, reps, seed, blocks, moments, "i int, n long, mean double, m2 double"), [*NET, "i"])
    own = N.strength(net).join(numbered(net), [*NET, "gene"]).join(null, [*NET, "i"])
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    return own.select(*NET, "gene", z.alias("z")).withColumn("specificity", 1 / (1 + F.exp(-F.col("z"))))


def footprint_similarity(rows: DataFrame, most: int = 256) -> DataFrame:
    """a, b, similarity: 1 - root of the Jensen-Shannon divergence (base 2) of archetypes' footprints
    (archetype, item, x).  Archetypes are dealt into blocks of about ``most``, and an item's archetypes meet in one group a
    pair of blocks, so that no group has more than about the square of ``most`` pairs, however many share the item."""
    blocks = -(-rows.select("archetype").distinct().count() // most) or 1
    total = rows.groupBy("archetype").agg(F.sum("x").alias("s"))
    p = cut(rows.where("x > 0").join(total, "archetype").select("archetype", "item", (F.col("x") / F.col("s")).alias("p")))
    own = F.pmod(F.xxhash64("archetype"), F.lit(blocks)).cast("int")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = p.select("item", F.col("archetype").alias("a"), F.col("p").alias("p"), own.alias("at"), all_blocks.alias("bt"))
    b = p.select("item", F.col("archetype").alias("b"), F.col("p").alias("q"), own.alias("bt"), all_blocks.alias("at"))
    xlog = lambda v: v * F.log2(v)
    common = (xlog(F.col("p") + F.col("q")) - xlog(F.col("p")) - xlog(F.col("q"))) / 2
    return a.join(b, ["item", "at", "bt"]).where("a < b").groupBy("a", "b").agg(F.sum(common).alias("c")).select("a", "b", (1 - F.sqrt(F.greatest(1 - F.col("c"), F.lit(0.0)))).alias("similarity"))


def regulator_activity(scores: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """by, regulator, log_p: enrichment of each regulator's targets (library, regulator, gene) in each
    library, combined over libraries."""
    named = sets.select(F.struct("library", "regulator").alias("set_name"), "gene")
    each = score_enrichment(scores, named, by).select(*by, F.col("set_name.regulator").alias("regulator"), "log_p")
    return combine_log_p(each, [*by, "regulator"], "log_p")
