"""Sparse count tables (cell_id, feature, value), non-zeros only; dimensions are passed along."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bins import median
from .graph import cut


def cell_qc(counts: DataFrame) -> DataFrame:
    """Counts, features seen and largest count of each cell; the largest is 0 at least, as absent features are."""
    return counts.groupBy("cell_id").agg(F.sum("value").alias("umis"), F.count_if(F.col("value") > 0).alias("features"), F.greatest(F.max("value"), F.lit(0)).alias("largest"))


def feature_qc(counts: DataFrame, n_cells: int) -> DataFrame:
    """Cells, mean and variance of features, implicit zeros included."""
    s = counts.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("cells"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    return s.select("feature", "cells", mean.alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / n_cells) / (n_cells - 1)).alias("variance"))


def qc_filter(counts: DataFrame, min_cells: float, min_features: int, min_umis: float, max_umis: float | None = None) -> DataFrame:
    """Drop cells and features outside the bounds, both at once, until nothing changes.  A
    ``min_cells`` between 0 and 1 is a share of the cells that ``counts`` has at first."""
    size = counts.count()
    if 0 < min_cells < 1:
        min_cells *= counts.select("cell_id").distinct().count()
    while True:
        inside = F.lit(True) if max_umis is None else F.col("umis") <= max_umis
        cells = cell_qc(counts).where((F.col("features") >= min_features) & (F.col("umis") >= min_umis) & inside).select("cell_id")
        features = counts.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_cells).select("feature")
        counts = counts.join(cells, "cell_id", "left_semi").join(features, "feature", "left_semi").select("cell_id", "feature", "value")
        counts = cut(counts)
        left = counts.count()
        if left == size:
            return counts
        size = left


def normalize_log(counts: DataFrame) -> DataFrame:
    """log(1 + value x median total / total) by cell."""
    totals = counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    median = totals.agg(F.percentile("total", F.lit(0.5)).alias("median"))
    scale = totals.join(F.broadcast(median), F.lit(True)).select("cell_id", (F.col("median") / F.col("total")).alias("scale"))
    return counts.join(scale, "cell_id").select("cell_id", "feature", F.log1p(F.col("value") * F.col("scale")).alias("value"))


def pseudobulk(counts: DataFrame, cells: DataFrame, by: list[str], min_cells: int = 1) -> DataFrame:
    """Sum, mean and variance by group and feature, implicit zeros included; groups of fewer than ``min_cells`` are dropped."""
    n = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)
    s = counts.join(cells, "cell_id").groupBy(*by, "feature").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("q"))
    k = F.col("n_cells")
    var = F.when(k > 1, (F.col("q") - F.col("sum") * F.col("sum") / k) / (k - 1)).otherwise(F.lit(0.0))
    return s.join(n, by).select(*by, "feature", "n_cells", "sum", (F.col("sum") / k).alias("mean"), var.alias("var"))


def pseudobulk_samples(counts: DataFrame, cells: DataFrame, by: list[str], min_cells: int = 3) -> DataFrame:
    """by, n_cells, features_per_cell: cells of each group of ``min_cells`` or more and how many features they have on
    average, cells without any included."""
    per_cell = counts.where("value > 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("nnz"))
    seen = cells.select("cell_id", *by).join(per_cell, "cell_id", "left")
    out = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.coalesce("nnz", F.lit(0))).alias("features_per_cell"))
    return out.where(F.col("n_cells") >= min_cells)


def every_pair(features: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``features`` once for each group, also where they never met: the names of the groups are one row."""
    names = groups.agg(F.collect_list(key).alias("_names"))
    return features.crossJoin(F.broadcast(names)).withColumn(key, F.explode("_names")).drop("_names")


def cluster_specificity(counts: DataFrame, cells: DataFrame, cluster: str) -> DataFrame:
    """Bernstein bounds (log10) for each feature and cluster against the null of independent
    non-zeros, from cell coverage and feature frequency.  A feature that a cluster lacks has 0 and its lower bound."""
    n = cells.count()
    g = counts.groupBy("feature").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("nnz"), F.max("value").alias("top"))
    g = g.select("feature", (F.col("nnz") / n).alias("row_p"), (F.col("s") / F.col("nnz")).alias("row_factor"), F.col("top").alias("row_max"))
    n_features = g.count()
    cover = cells.join(counts.groupBy("cell_id").agg((F.count_if(F.col("value") > 0) / n_features).alias("col_p")), "cell_id", "left").fillna(0.0, ["col_p"])
    rho = cover.agg(F.avg("col_p").alias("rho"))
    gamma = cover.join(F.broadcast(rho), F.lit(True)).withColumn("b", F.col("col_p") / F.col("rho")).groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.sum("b").alias("b1"), F.sum(F.col("b") * F.col("b")).alias("b2"), F.max("b").alias("bmax"))
    obs = counts.join(cells, "cell_id").groupBy(cluster, "feature").agg(F.sum("value").alias("obs"))
    grid = every_pair(g, gamma, cluster).join(obs, [cluster, "feature"], "left").join(gamma, cluster).withColumn("obs", F.coalesce("obs", F.lit(0)))
    e = F.col("row_p") * F.col("row_factor") * F.col("b1") / F.col("size")
    nu = F.col("row_p") * F.col("row_factor") * F.col("row_factor") * F.col("b2") / (F.col("size") * F.col("size"))
    a = F.col("row_max") * F.col("bmax") / F.col("size")
    d = F.col("obs") / F.col("size") - e
    up = F.when(d > 0, d * d / (2 * (nu + d * a / 3)) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))
    low = F.when(d < 0, d * d / (2 * nu) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))
    return grid.select(cluster, "feature", "obs", F.round(up, 9).alias("upper"), F.round(low, 9).alias("lower"))


def archetype_specificity(counts: DataFrame, weights: DataFrame, n_cells: int) -> DataFrame:
    """``cluster_specificity`` for cells that belong to archetypes by ``weights`` (cell_id, archetype,
    weight), each archetype's scaled to sum 1; ``n_cells`` counts those without any value too."""
    g = counts.groupBy("feature").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("nnz"), F.max("value").alias("row_max")).where("nnz > 0")
    g = g.select("feature", (F.col("nnz") / n_cells).alias("row_p"), (F.col("s") / F.col("nnz")).alias("row_factor"), "row_max")
    cover = counts.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("k"))
    rho = cover.agg((F.sum("k") / n_cells).alias("rho"))  # one row
    total = weights.groupBy("archetype").agg(F.sum("weight").alias("total"))
    share = weights.join(total, "archetype").where("total > 0 AND weight > 0").select("cell_id", "archetype", (F.col("weight") / F.col("total")).alias("h"))
    share = share.join(cover, "cell_id").join(F.broadcast(rho), F.lit(True)).select("cell_id", "archetype", "h", (F.col("h") * F.col("k") / F.col("rho")).alias("b"))
    gamma = share.groupBy("archetype").agg(F.sum("b").alias("b1"), F.sum(F.col("b") * F.col("b")).alias("b2"), F.max("b").alias("bmax"))
    obs = counts.join(share, "cell_id").groupBy("archetype", "feature").agg(F.sum(F.col("h") * F.col("value")).alias("obs"))
    d = F.col("obs") - F.col("row_p") * F.col("row_factor") * F.col("b1")
    nu = F.col("row_p") * F.col("row_factor") * F.col("row_factor") * F.col("b2")
    up = F.when(d > 0, d * d / (2 * (nu + d * F.col("row_max") * F.col("bmax") / 3)) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))
    low = F.when(d < 0, d * d / (2 * nu) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))
    grid = every_pair(g, gamma, "archetype").join(obs, ["archetype", "feature"], "left").join(gamma, "archetype").withColumn("obs", F.coalesce("obs", F.lit(0.0)))
    return grid.select("archetype", "feature", F.round("obs", 9).alias("obs"), F.round(up, 9).alias("upper"), F.round(low, 9).alias("lower"))


def top_markers(specificity: DataFrame, cluster: str, k: int) -> DataFrame:
    w = Window.partitionBy(cluster).orderBy(F.desc("upper"), "feature")
    return specificity.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contingency(cells: DataFrame, a: str, b: str) -> DataFrame:
    return cells.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def robust_z(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD) within groups, or over all rows by medians that no task sees whole."""
    if by is None:
        middle = median(rows, value).first()["median"]
        dev = F.abs(F.col(value) - F.lit(middle))
        mad = median(rows.select(dev.alias("dev")), "dev").first()["median"]
        z = (F.col(value) - F.lit(middle)) / (1.4826 * mad) if mad else F.when(F.col(value).isNotNull(), 0.0)
        return rows.withColumn("z", F.round(z, 9))
    med = rows.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    dev = rows.join(med, by).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = dev.groupBy(by).agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    z = F.when(F.col("mad") > 0, (F.col(value) - F.col("median")) / (1.4826 * F.col("mad"))).otherwise(F.lit(0.0))
    return dev.join(mad, by).withColumn("z", F.round(z, 9)).drop("dev", "median", "mad")


def renormalize(counts: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """Cells scaled by least squares to the mean profile of their group, itself so scaled to the
    mean of the groups' profiles."""
    n = cells.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    bulk = counts.join(cells, "cell_id").groupBy(by, "feature").agg(F.sum("value").alias("s")).join(n, by).select(by, "feature", (F.col("s") / F.col("n")).alias("y"))
    mean = bulk.groupBy("feature").agg((F.sum("y") / n.count()).alias("m"))
    fit = bulk.join(mean, "feature").groupBy(by).agg((F.sum(F.col("m") * F.col("y")) / F.sum(F.col("y") * F.col("y"))).alias("f"))
    bulk = bulk.join(fit, by).select(by, "feature", (F.col("y") * F.col("f")).alias("y"))
    of = counts.join(cells.select("cell_id", by), "cell_id").join(bulk, [by, "feature"])
    scale = of.groupBy("cell_id").agg(F.try_divide(F.sum(F.col("y") * F.col("value")), F.sum(F.col("value") * F.col("value"))).alias("scale"))
    return counts.join(scale, "cell_id").select("cell_id", "feature", (F.col("value") * F.col("scale")).alias("value"))


def specificity_of_presence(counts: DataFrame, cells: DataFrame, cluster: str) -> DataFrame:
    """``cluster_specificity`` of being there at all."""
    return cluster_specificity(counts.where("value > 0").withColumn("value", F.lit(1.0)), cells, cluster)


def impute_by_archetypes(profiles: DataFrame, weights: DataFrame) -> DataFrame:
    """Values of features (feature, archetype, value) in cells (cell_id, archetype, weight): the
    product of both tables, so ``profiles`` holds only the features that are wanted.

    A cell's weights meet the features' profiles, which go to all tasks, and each value is summed in its row, so that
    no task holds sums of its cells."""
    cells = weights.where("archetype IS NOT NULL").groupBy("cell_id").agg(F.collect_list(F.struct("archetype", "weight")).alias("w"))
    features = profiles.where("archetype IS NOT NULL").groupBy("feature").agg(F.collect_list(F.struct("archetype", "value")).alias("p"))
    features = features.select("feature", F.expr("map_from_entries(transform(array_distinct(p.archetype), a -> struct(a, transform(filter(p, q -> q.archetype = a), q -> q.value))))").alias("p"))
    # nulls are left out of a sum, and a sum of nothing is null
    terms = "filter(flatten(transform(w, c -> transform(coalesce(p[c.archetype], array()), v -> double(c.weight * v)))), t -> t IS NOT NULL)"
    both = cells.join(F.broadcast(features), F.expr("exists(w, c -> map_contains_key(p, c.archetype))"))
    return both.select("cell_id", "feature", F.expr(terms).alias("t")).select("cell_id", "feature", F.expr("if(size(t) > 0, aggregate(t, 0D, (a, b) -> a + b), NULL)").alias("value"))


def bind_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of several tables side by side, with the table's name in front of cell ids."""
    parts = [t.select(F.concat_ws("_", F.lit(name), F.col("cell_id").cast("string")).alias("cell_id"), "feature", "value") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
