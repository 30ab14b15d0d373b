"""Assignment of greatest total weight, by an auction in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .labels import label_association


def assign(pairs: DataFrame, left: str, right: str, weight: str, by: list[str] | None = None, tolerance: float = 1e-6, factor: float = 8.0) -> DataFrame:
    """``by``, left, right, weight of pairs in which each left and each right stands at most once.

    Their total is within ``tolerance`` of the greatest one, in each group of ``by`` (so the greatest
    itself if weights are whole numbers and the tolerance is below 1).  Pairs without a positive weight are
    never taken; of pairs given twice the heaviest counts.

    Auction: whoever has nothing bids for what is worth most to it at present prices, so much that the second
    best would be as good, plus e; each thing goes to its highest bid.  Everyone has a partner of weight 0
    of its own, and so have these among each other, hence all find something and prices may start anywhere:
    e falls by ``factor`` from a group's largest weight, each time from the last prices (price scaling).
    All bidders of all groups bid in the same round.
    """
    by = list(by or [])
    named = pairs.select(*by, F.col(left).alias("l"), F.col(right).alias("r"), F.col(weight).cast("double").alias("w")).where("w > 0 AND l IS NOT NULL AND r IS NOT NULL")
    named = stored(named.groupBy(*by, "l", "r").agg(F.max("w").alias("w")))
    lname, rname = F.concat(F.lit("l:"), F.col("l").cast("string")), F.concat(F.lit("r:"), F.col("r").cast("string"))
    offer = lambda bidder, thing, w: F.struct(bidder.alias("bidder"), thing.alias("thing"), w.alias("w"))
    zero = F.lit(0.0)
    offers = F.array(offer(lname, rname, F.col("w")), offer(lname, lname, zero), offer(rname, rname, zero), offer(rname, lname, zero))
    edges = stored(named.select(*by, F.explode(offers).alias("o")).select(*by, "o.*").distinct())
    state = edges.select(*by, "thing").distinct().select(*by, "thing", zero.alias("price"), F.lit(None).cast("string").alias("owner"))
    bidders = edges.select(*by, "bidder").distinct()
    limits = edges.groupBy(*by).agg(F.max("w").alias("e"), (tolerance / (F.countDistinct("bidder") + 1)).alias("last"))
    limits = stored(limits.withColumn("e", F.greatest(F.col("e") / 2, "last")))
    if limits.isEmpty():
        return named.select(*by, F.col("l").alias(left), F.col("r").alias(right), F.col("w").alias(weight))
    while True:
        state = stored(state.withColumn("owner", F.lit(None).cast("string")))
        while not state.where("owner IS NULL").isEmpty():
            state = stored(bid(edges, bidders, state, limits, by))
        if limits.where("e > last").isEmpty():
            break
        limits = stored(limits.withColumn("e", F.greatest(F.col("e") / factor, "last")))
    own = state.select(*by, F.col("owner").alias("ln"), F.col("thing").alias("rn"))
    keys = [*by, "ln", "rn"]
    return named.withColumn("ln", lname).withColumn("rn", rname).join(own, keys).select(*by, F.col("l").alias(left), F.col("r").alias(right), F.col("w").alias(weight))


def bid(edges: DataFrame, bidders: DataFrame, state: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """The state (by, thing, price, owner) after one round of bids of all who own nothing."""
    owners = state.where("owner IS NOT NULL").select(*by, F.col("owner").alias("bidder"))
    free = bidders.join(owners, [*by, "bidder"], "left_anti")
    worth = edges.join(free, [*by, "bidder"]).join(state.select(*by, "thing", "price"), [*by, "thing"]).withColumn("v", F.col("w") - F.col("price"))
    rank = F.row_number().over(Window.partitionBy(*by, "bidder").orderBy(F.desc("v"), "thing"))
    best = worth.withColumn("rank", rank).where("rank <= 2").groupBy(*by, "bidder").agg(F.min_by(F.struct("thing", "w"), "rank").alias("first"), F.max_by("v", "rank").alias("second"))
    bids = best.join(limits, by) if by else best.crossJoin(F.broadcast(limits))  # one row
    bids = bids.select(*by, "first.thing", F.struct((F.col("first.w") - F.col("second") + F.col("e")).alias("price"), "bidder").alias("bid"))
    won = bids.groupBy(*by, "thing").agg(F.max("bid").alias("bid"))
    return state.join(won, [*by, "thing"], "left").select(*by, "thing", F.coalesce("bid.price", "price").alias("price"), F.coalesce("bid.bidder", "owner").alias("owner"))


def map_labels(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """label, cluster, log10_p: clusters named by labels, each at most once, so that the sum of the
    hypergeometric log p (capped at 300) is greatest (within 1e-4)."""
    return assign(label_association(rows, label, cluster), label, cluster, "log10_p", tolerance=1e-4)


def renamed(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """``rows`` with mapped, the label of the row's cluster (null where the cluster got none)."""
    names = map_labels(rows, label, cluster).select(F.col(cluster).alias("_cluster"), F.col(label).alias("mapped"))
    return rows.join(names, F.col(cluster) == F.col("_cluster"), "left").drop("_cluster")
