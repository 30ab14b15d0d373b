"""Hub tests against reproducible null networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import hashed, uniform
from . import network as N
from . import paths
from .graph import cut

CENTRALITIES = {"degree": N.strength, "betweenness": paths.betweenness, "closeness": paths.closeness, "eigenvector": paths.eigenvector}

#: Into so many blocks a given number of null networks is dealt, by network.
BLOCKS = 10


def numbered(net: DataFrame) -> DataFrame:
    """Genes of each network with their number i in order."""
    return N.endpoints(net).distinct().withColumn("i", F.row_number().over(Window.partitionBy(*N.NET).orderBy("gene")) - 1)


def rewired(net: DataFrame, reps: int | None, p: float, seed: int, shuffle_each: bool = True, values: int = 10_000) -> DataFrame:
    """``reps`` null networks: each endpoint moves to a random node with probability ``p``, without
    loops, and weights are shuffled over edges (each time, or once per network).  Without ``reps`` there are as many for each network as give
    ``values`` null values, one a node."""
    nodes, by_net = numbered(net), Window.partitionBy(*N.NET)
    edges = net.withColumn("edge", F.row_number().over(by_net.orderBy("gene1", "gene2"))).withColumn("m", F.count(F.lit(1)).over(by_net))
    edges = edges.join(nodes.groupBy(*N.NET).agg(F.count(F.lit(1)).alias("n")), N.NET)
    for c in ("1", "2"):
        edges = edges.join(nodes.select(*N.NET, F.col("gene").alias(f"gene{c}"), F.col("i").alias(f"i{c}")), [*N.NET, f"gene{c}"])
    n_tasks = int(net.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not shuffle_each:  # one order of the weights, found before edges are repeated
        order = hashed(F.lit(seed), F.col("celltype"), F.col("condition"), F.col("edge"), F.lit("weight"))
        slots = edges.withColumn("slot", F.row_number().over(by_net.orderBy(order, "edge")))
        edges = slots.drop("lls").join(edges.select(*N.NET, F.col("edge").alias("slot"), "lls"), [*N.NET, "slot"])
    # a task gets a network's edges once for a block of null networks and repeats them there; a few small networks
    # grow to many null networks, so the partitions are dealt anew
    every, per = (F.ceil(F.lit(values) / F.col("n")).cast("int"), 1) if reps is None else (F.lit(reps), -(-reps // BLOCKS))
    dealt = edges.select(*N.NET, "edge", "lls", "n", "i1", "i2", F.explode(F.sequence(F.lit(0), F.floor((every - 1) / per).cast("int"))).alias("block"), every.alias("every"))
    dealt = dealt.repartition(n_tasks, *N.NET, "block")
    reps_of = dealt.select(*N.NET, "block", "edge", "lls", "n", "i1", "i2", F.explode(F.sequence(F.col("block") * per + 1, F.least(F.col("every"), F.col("block") * per + per))).alias("rep"))
    cols = [F.lit(seed), *map(F.col, ("celltype", "condition", "rep", "edge"))]

    def end(c: str):
        if p == 0:
            return F.col(f"i{c}")
        return F.when(uniform(*cols, F.lit(f"move{c}")) < p, F.floor(uniform(*cols, F.lit(f"to{c}")) * F.col("n"))).otherwise(F.col(f"i{c}"))

    def ends(rows: DataFrame) -> DataFrame:
        moved = rows.withColumn("a", end("1")).withColumn("b", end("2"))
        return moved.withColumn("b", F.when(F.col("a") == F.col("b"), (F.col("b") + 1) % F.col("n")).otherwise(F.col("b")))

    if not shuffle_each:
        return ends(reps_of).select(*N.NET, "block", "rep", "a", "b", "lls")
    null = [*N.NET, "block", "rep"]
    drawn = ends(reps_of).withColumn("slot", F.row_number().over(Window.partitionBy(*null).orderBy(hashed(*cols, F.lit("weight")), "edge")))
    # an edge's ends and the weight that it gets meet by number, where all rows of the null network are
    no_end = F.lit(None).cast("long")
    two = F.array(F.struct(F.col("slot").alias("at"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(None).cast(net.schema["lls"].dataType).alias("lls")), F.struct(F.col("edge").alias("at"), no_end.alias("a"), no_end.alias("b"), F.col("lls")))
    both = drawn.select(*null, F.explode(two).alias("t")).groupBy(*null, "t.at").agg(*[F.max(f"t.{c}").alias(c) for c in ("a", "b", "lls")])
    return both.select(*null, "a", "b", "lls")


def null_strengths(null: DataFrame) -> DataFrame:
    """NET, rep, i, value of the nodes that have edges; blocks of null networks stay where they are."""
    own = [c for c in (*N.NET, "block", "rep") if c in null.columns]
    return null.select(*own, "lls", F.explode(F.array("a", "b")).alias("i")).groupBy(*own, "i").agg(F.sum("lls").alias("value")).drop("block")


def null_centralities(null: DataFrame, method: str) -> DataFrame:
    """``null_strengths`` for any centrality: each null network is a condition of its own."""
    if method == "degree":
        return null_strengths(null)
    mark = F.concat_ws("#", "condition", "rep")
    nets = null.select("celltype", mark.alias("condition"), F.least("a", "b").alias("gene1"), F.greatest("a", "b").alias("gene2"), "lls")
    # edges that a rewiring laid on each other are one
    nets = nets.groupBy(*N.NET, "gene1", "gene2").agg(F.sum("lls").alias("lls"))
    found = CENTRALITIES[method](nets)
    rep = F.substring_index("condition", "#", -1).cast("int")
    own = F.expr("substring(condition, 1, length(condition) - length(substring_index(condition, '#', -1)) - 1)")
    return found.select("celltype", own.alias("own"), rep.alias("rep"), F.col("gene").alias("i"), "value").withColumnRenamed("own", "condition")


def with_zeros(null: DataFrame, net: DataFrame, reps: int | None, values: int) -> DataFrame:
    """NET, value, times: how often each null value came, 0 for each node that a rewiring left without edges."""
    seen = null.groupBy(*N.NET, "value").agg(F.count(F.lit(1)).alias("times"))
    n = N.endpoints(net).groupBy(*N.NET).agg(F.countDistinct("gene").alias("n"))
    every = F.col("n") * (F.ceil(F.lit(values) / F.col("n")) if reps is None else F.lit(reps))
    found = seen.groupBy(*N.NET).agg(F.sum("times").alias("found"))
    none = n.join(found, N.NET, "left").select(*N.NET, F.lit(0.0).alias("value"), (every - F.coalesce("found", F.lit(0))).cast("long").alias("times"))
    return seen.unionByName(none)


def exceed(observed: DataFrame, null: DataFrame, by: list[str], value: str) -> DataFrame:
    """p = (1 + number of null values above) / (null values + 1): one rank over both.  ``null`` may count
    equal values in a column times."""
    times = F.col("times") if "times" in null.columns else F.lit(1)
    rows = observed.withColumn("_null", F.lit(0)).unionByName(null.select(*by, value, times.alias("_null")), allowMissingColumns=True)
    # the null is first summed by value, so hot networks shrink to their distinct values
    above = rows.groupBy(*by, value).agg(F.sum("_null").alias("_k"))
    w = Window.partitionBy(*by)
    above = above.select(*by, value, F.coalesce(F.sum("_k").over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"), F.sum("_k").over(w).alias("_all"))
    return observed.join(above, [*by, value]).withColumn("p", (1 + F.col("_above")) / (F.col("_all") + 1)).drop("_above", "_all")


def find_all_hub(net: DataFrame, reps: int | None, seed: int, method: str = "bh", values: int = 10_000, symbol: Column | None = None, centrality: str = "degree") -> DataFrame:
    """Centrality of each gene (by default its strength) against networks rewired with probability 0.5,
    in which nodes without edges count as 0."""
    net = cut(net)  # read several times below
    observed = N.percent_rank(N.drop_ribosomal(CENTRALITIES[centrality](net), symbol))
    null = null_centralities(rewired(net, reps, 0.5, seed, values=values), centrality)
    tested = exceed(observed, with_zeros(null, net, reps, values), N.NET, "value")
    return N.p_adjust(tested, "p", N.NET, ["gene"], [method]).withColumnRenamed(f"p_{method}", "q")


def find_diff_hub(net: DataFrame, cells: DataFrame, control: str, disease: str, reps: int | None, seed: int, min_cells: int = 500, method: str = "bh", values: int = 1_000_000, symbol: Column | None = None, centrality: str = "degree") -> DataFrame:
    """Rank differences of genes against those between two rewirings (0.9) of the control, among genes
    that have edges in either; both ranks may be 0 there."""
    net = cut(net)  # read several times below
    n = cells.where(F.col("condition").isin(control, disease)).groupBy("celltype", "condition").agg(F.count(F.lit(1)).alias("n"))
    able = n.groupBy("celltype").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where((F.col("k") == 2) & (F.col("least") >= min_cells)).select("celltype")
    ranked = N.percent_rank(N.drop_ribosomal(CENTRALITIES[centrality](net), symbol))
    diff = N.diff_pr(ranked, control, disease).join(able, "celltype").withColumn("size", F.abs("diff"))
    base = net.where(F.col("condition") == control).join(able, "celltype").select(*net.columns)
    kept = N.drop_ribosomal(numbered(base), symbol).select("celltype", "i")
    sides = []
    for side in (0, 1):
        s = null_centralities(rewired(base, reps, 0.9, seed + side, shuffle_each=False, values=values), centrality).join(kept, ["celltype", "i"])
        sides.append(s.select("celltype", "rep", "i", F.percent_rank().over(Window.partitionBy("celltype", "rep").orderBy("value")).alias(f"pr{side}")))
    null = sides[0].join(sides[1], ["celltype", "rep", "i"], "full_outer").fillna(0.0, ["pr0", "pr1"])
    null = null.select("celltype", F.abs(F.col("pr1") - F.col("pr0")).alias("size"))
    tested = exceed(diff, null, ["celltype"], "size")
    return N.p_adjust(tested, "p", ["celltype"], ["gene"], [method]).withColumnRenamed(f"p_{method}", "q")
