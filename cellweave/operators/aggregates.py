"""Small aggregates over long tables: group contrasts, combinations, entropy, rank matching."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def welch_t(values: DataFrame, by: str, label: str, value: str = "value", least: int = 3) -> DataFrame:
    """by, label, t: a label's mean against that of all others, unequal variances.

    0 where either side has fewer than ``least`` rows or does not vary.  The other side's moments
    are the totals minus the label's own, so the rows are read once and never paired.
    """
    v = F.col(value).cast("double")
    own = values.groupBy(by, label).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    w = Window.partitionBy(by)  # as many rows as labels
    own = own.select(by, label, "n", "s", "q", (F.sum("n").over(w) - F.col("n")).alias("m"), (F.sum("s").over(w) - F.col("s")).alias("t"), (F.sum("q").over(w) - F.col("q")).alias("u"))
    err = lambda n, s, q: (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1) / F.col(n)
    t = F.try_divide(F.col("s") / F.col("n") - F.col("t") / F.col("m"), F.sqrt(F.greatest(F.lit(0.0), err("n", "s", "q") + err("m", "t", "u"))))
    return own.select(by, label, F.when((F.col("n") >= least) & (F.col("m") >= least), F.coalesce(t, F.lit(0.0))).otherwise(F.lit(0.0)).alias("t"))


def best_label(scores: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """by, label, confidence: the label of the highest score; ties go to the first by name."""
    w = Window.partitionBy(by).orderBy(F.desc(score), label)
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, label, F.col(score).alias("confidence"))


def trimmed_mean(rows: DataFrame, by: list[str], value: str, trim: float = 0.25) -> DataFrame:
    """by, value: mean without the ``trim`` share of values at either end, nulls skipped."""
    w = Window.partitionBy(*by)
    r = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    gone = F.floor(F.col("_n") * trim)
    return r.where((F.col("_r") > gone) & (F.col("_r") <= F.col("_n") - gone)).groupBy(*by).agg(F.avg(value).alias(value))


def combine_log_p(rows: DataFrame, by: list[str], value: str, top: int | None = None, base: float = 10.0) -> DataFrame:
    """by, value: log of the mean of exponentials of the ``top`` largest log p-values (all if None)."""
    r = rows.where(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double") * math.log(base))
    if top is not None:
        r = r.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_x")))).where(F.col("_r") <= top)
    most = r.groupBy(*by).agg(F.max("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    k = F.col("_n") if top is None else F.lit(top)
    return r.join(most, by).groupBy(*by).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("_x") - F.col("_m")))) - F.log(F.first(k))).alias(value))


def entropy(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, entropy (nats) of the positive values as shares of their sum: ln s - sum(x ln x) / s."""
    x = F.col(value).cast("double")
    return rows.where(x > 0).groupBy(*by).agg((F.log(F.sum(x)) - F.sum(x * F.log(x)) / F.sum(x)).alias("entropy"))


def z_scores(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds z = (x - mean) / sample deviation within groups, 0 where nothing varies."""
    m = rows.groupBy(*by).agg(F.avg(value).cast("double").alias("_m"), F.stddev_samp(value).alias("_s"))
    return rows.join(m, by).withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def rank_matching(left: DataFrame, right: DataFrame, by: list[str], id_col: str, value: str, left_least: float, right_least: float) -> DataFrame:
    """by, rank, left_id, right_id: the i-th largest of one side with the i-th largest of the other,
    as far as both are over their thresholds; ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), id_col)
    side = lambda df, least, name: df.where(F.col(value) > least).select(*by, F.row_number().over(order).alias("rank"), F.col(id_col).alias(name))
    return side(left, left_least, "left_id").join(side(right, right_least, "right_id"), [*by, "rank"])
