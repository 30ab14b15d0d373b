"""Sums over the smallest values of each group, and ensemble bins made of them.

No window runs over a whole group: equal values are counted first, a sketch cuts the distinct values
into parts, sums of the parts (at most ``PARTS`` rows a group) give what lies before each, and only
within a part values are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def prefix_sums(values: DataFrame, by: list[str], wanted: DataFrame, few: bool = False) -> DataFrame:
    """``wanted`` (by, at) with x, the ``at``-th smallest value of the group, and s and q, the sums of the ``at`` smallest and
    of their squares.

    ``values``: by, x, times.  ``at`` runs from 0 (where x is null) to the group's number of values.  ``few`` says that
    the groups and ranks asked for are few enough to go to every task.
    """
    spread = F.broadcast if few else lambda df: df
    counted = values.groupBy(*by, "x").agg(F.sum("times").alias("c")).where("c > 0")
    marks = counted.groupBy(*by).agg(F.percentile_approx("x", [i / PARTS for i in range(1, PARTS)], 1000).alias("marks"))
    placed = counted.join(spread(marks), by).select(*by, "x", "c", F.expr("size(filter(marks, m -> m < x))").alias("part"))
    x, c = F.col("x"), F.col("c")
    parts = placed.groupBy(*by, "part").agg(F.sum("c").alias("n"), F.sum(c * x).alias("s"), F.sum(c * x * x).alias("q"))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", "n", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"{v}0") for v in "nsq"])
    own = Window.partitionBy(*by, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(v).over(own), F.lit(0)).alias(name) for v, name in ((c, "n1"), (c * x, "s1"), (c * x * x, "q1"))]
    inner = placed.select(*by, "part", "x", "c", *sums)
    asked = wanted.distinct().join(parts, by).where("at > n0 AND at <= n0 + n").select(*by, "at", "part", (F.col("at") - F.col("n0")).alias("left"), "s0", "q0")
    rest = F.col("left") - F.col("n1")
    found = inner.join(spread(asked), [*by, "part"]).where((rest > 0) & (rest <= c))
    found = found.select(*by, "at", x.alias("x"), (F.col("s0") + F.col("s1") + rest * x).alias("s"), (F.col("q0") + F.col("q1") + rest * x * x).alias("q"))
    return wanted.join(found, [*by, "at"], "left").fillna(0.0, ["s", "q"])


def median(rows: DataFrame, value: str) -> DataFrame:
    """One row, ``median``: that of all values (nulls left out), the mean of the middle two where they are even in number."""
    values = rows.where(F.col(value).isNotNull()).select(F.lit(0).alias("g"), F.col(value).cast("double").alias("x"), F.lit(1).alias("times"))
    n = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select("g", F.explode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).alias("at"))
    return prefix_sums(values, ["g"], wanted.distinct(), few=True).agg(F.avg("x").alias("median"))


def ensemble_bins(rows: DataFrame, by: list[str], sizes: DataFrame, bins: int, pseudocount: float = 0.0, value: str = "value") -> DataFrame:
    """by, bin, above, mean, variance over the cells of each group, those without a row being 0.

    The cuts are ranks round(seq(1, (1 - 1 / bins) n, length = bins)) (halves to even, 1 at least) of the
    n = ``size`` cells that ``sizes`` (some of by, size) gives; above is the sum of what ranks above the cut plus
    ``pseudocount``, mean and variance (0 of a single cell) are those of the cut's value and all above it.
    Negative values are allowed; null values count as 0.
    """
    on = [c for c in by if c in sizes.columns]
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"), F.sum(x).alias("total")).join(sizes, on) if on else rows.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"), F.sum(x).alias("total")).crossJoin(F.broadcast(sizes))  # one row
    own = own.select(*by, "seen", "size", "total", (F.col("total") / F.col("size")).alias("centre"))
    # values less their mean, so that differences of squares don't cancel
    present = rows.join(own, by).select(*by, (x - F.col("centre")).alias("x"), F.lit(1).alias("times"))
    zeros = own.select(*by, (-F.col("centre")).alias("x"), (F.col("size") - F.col("seen")).alias("times"))
    values = present.unionByName(zeros)
    step = (F.lit(1 - 1 / bins) * F.col("size") - 1) / max(1, bins - 1)
    cuts = own.select(*by, "size", "total", "centre", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    cuts = cuts.withColumn("cut", F.greatest(F.bround(1 + (F.col("bin") - 1) * step), F.lit(1)).cast("long"))
    wanted = cuts.select(*by, F.explode(F.array(F.col("cut"), F.col("cut") - 1, F.col("size").cast("long"))).alias("at")).distinct()
    sums = prefix_sums(values, by, wanted)
    at = lambda key, mark: sums.select(*by, F.col("at").alias(key), F.col("s").alias(f"s_{mark}"), F.col("q").alias(f"q_{mark}"))
    out = cuts.withColumn("before", F.col("cut") - 1).withColumn("last", F.col("size").cast("long"))
    for key, mark in (("cut", "cut"), ("before", "before"), ("last", "all")):
        out = out.join(at(key, mark), [*by, key])
    n = F.col("size") - F.col("before")
    s, q = F.col("s_all") - F.col("s_before"), F.col("q_all") - F.col("q_before")
    above = F.col("s_all") - F.col("s_cut") + (F.col("size") - F.col("cut")) * F.col("centre") + F.lit(float(pseudocount))
    variance = F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select(*by, "bin", above.alias("above"), (s / n + F.col("centre")).alias("mean"), variance.alias("variance"))
