"""Iterative graph operators as loops of joins and aggregations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .network import NET, endpoints


def both_ways(net: DataFrame, *values: str) -> DataFrame:
    pair = F.array(F.struct(F.col("gene1").alias("src"), F.col("gene2").alias("dst")), F.struct(F.col("gene2").alias("src"), F.col("gene1").alias("dst")))
    return net.select(*NET, *values, F.explode(pair).alias("e")).select(*NET, *values, "e.src", "e.dst")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, set up where the session has none yet."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cellweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Truncate lineage in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.  Unlike a checkpoint it brings
    nothing of its plan along: loops with many joins would infer ever more constraints from that."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a table of the warehouse in buckets of ``keys``, so that a loop's joins by these keys shuffle only what
    it makes anew."""
    spark = df.sparkSession
    name = f"cellweave_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).format("parquet").saveAsTable(name)
    return spark.table(name)


def components(net: DataFrame) -> DataFrame:
    """celltype, condition, gene, component (its smallest gene), by label spreading with jumps.

    Only labels that the last round lowered are sent again, as neighbours have seen the others.
    """
    edges = laid(both_ways(net), *NET, "src")
    buckets = int(net.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = laid(edges.select(*NET, F.col("src").alias("gene")).distinct().withColumns({"component": F.col("gene"), "changed": F.lit(True)}), *NET, "gene")
    while True:
        sent = labels.where("changed").select(*NET, F.col("gene").alias("src"), "component")
        near = edges.join(sent, [*NET, "src"]).groupBy(*NET, F.col("dst").alias("gene")).agg(F.min("component").alias("near"))
        step = labels.join(near, [*NET, "gene"], "left").select(*NET, "gene", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(*NET, F.col("gene").alias("c"), F.col("component").alias("far"))
        new = step.join(jump, [*NET, "c"]).select(*NET, "gene", F.least("c", "far").alias("component"), (F.least("c", "far") < F.col("old")).alias("changed"))
        labels = laid(new.repartition(buckets, *NET, "gene"), *NET, "gene")
        if labels.where("changed").isEmpty():
            return labels.drop("changed")


def component_sizes(net: DataFrame) -> DataFrame:
    sizes = components(net).groupBy(*NET, "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*NET).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


def core_numbers(net: DataFrame) -> DataFrame:
    """k-core numbers: each node takes the h-index of its neighbours' values until none changes."""
    edges = laid(both_ways(net), *NET, "dst")
    # an edge is there from both ends
    value = laid(edges.groupBy(*NET, F.col("dst").alias("gene")).agg(F.count(F.lit(1)).alias("core")), *NET, "gene")
    while True:
        sent = edges.join(value.withColumnRenamed("gene", "dst"), [*NET, "dst"])
        seen = sent.groupBy(*NET, F.col("src").alias("gene"), "core").agg(F.count(F.lit(1)).alias("n"))
        # neighbours by value: the largest h that as many neighbours reach
        reach = F.sum("n").over(Window.partitionBy(*NET, "gene").orderBy(F.desc("core")))
        h = seen.select(*NET, "gene", F.least("core", reach).alias("h")).groupBy(*NET, "gene").agg(F.max("h").alias("new"))
        new = laid(value.join(h, [*NET, "gene"]).select(*NET, "gene", F.least("new", "core").alias("core"), F.col("core").alias("old")), *NET, "gene")
        value = new.drop("old")
        if new.where("core <> old").isEmpty():
            return value


def diffuse(net: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 3) -> DataFrame:
    """Diffusion of seed scores (NET, gene, x0 summing to 1): x <- alpha P x + (1 - alpha) x0."""
    edges = both_ways(net, "lls")
    out = edges.groupBy(*NET, "src").agg(F.sum("lls").alias("total"))
    p = edges.join(out, [*NET, "src"]).select(*NET, "src", "dst", (F.col("lls") / F.col("total")).alias("p"))
    x = endpoints(net).distinct().join(seeds, [*NET, "gene"], "left").select(*NET, "gene", F.coalesce("x0", F.lit(0.0)).alias("x0"))
    x = x.withColumn("x", F.col("x0"))
    for _ in range(rounds):
        moved = p.join(x.select(*NET, F.col("gene").alias("src"), "x"), [*NET, "src"]).groupBy(*NET, F.col("dst").alias("gene")).agg(F.sum(F.col("p") * F.col("x")).alias("m"))
        x = x.drop("x").join(moved, [*NET, "gene"], "left").select(*NET, "gene", "x0", (alpha * F.coalesce("m", F.lit(0.0)) + (1 - alpha) * F.col("x0")).alias("x"))
    # off the ties, where sums in another order would round apart
    return x.select(*NET, "gene", F.round(F.col("x") + 3e-10, 6).alias("x"))


def diffusion_limit(net: DataFrame, seeds: DataFrame, alpha: float = 0.85, tolerance: float = 1e-10, rounds: int = 500) -> DataFrame:
    """NET, gene, x: where ``diffuse`` ends, x = alpha P x + (1 - alpha) x0, by conjugate gradients.

    With D the strengths and A the weights, y = D^-1/2 x solves (I - alpha D^-1/2 A D^-1/2) y =
    (1 - alpha) D^-1/2 x0, whose matrix is symmetric and positive.  All networks step together, each with
    its own scalars; it ends when every residual is at most ``tolerance`` of its right side, and raises
    after ``rounds`` steps.
    """
    edges = stored(both_ways(net, "lls").groupBy(*NET, "src", "dst").agg(F.sum("lls").alias("w")))
    root = laid(edges.groupBy(*NET, F.col("src").alias("gene")).agg(F.sqrt(F.sum("w")).alias("d")), *NET, "gene")
    side = lambda end, name: root.select(*NET, F.col("gene").alias(end), F.col("d").alias(name))
    weighted = edges.join(side("dst", "b"), [*NET, "dst"]).join(side("src", "a"), [*NET, "src"])
    edges = laid(weighted.select(*NET, "src", "dst", (alpha * F.col("w") / (F.col("a") * F.col("b"))).alias("w")), *NET, "src")
    b = (1 - alpha) * F.coalesce("x0", F.lit(0.0)) / F.col("d")
    rows = root.join(seeds.select(*NET, "gene", "x0"), [*NET, "gene"], "left").select(*NET, "gene", F.lit(0.0).alias("x"), b.alias("r"), b.alias("p"))
    rows = laid(rows, *NET, "gene")
    goal = stored(rows.groupBy(*NET).agg((tolerance * tolerance * F.sum(F.col("r") * F.col("r"))).alias("goal")))
    few = goal.count() <= 5000
    spread = F.broadcast if few else lambda df: df  # noqa: E731  # a row a network
    for _ in range(rounds):
        # a round writes its rows once, with the product; what it makes of them is left to the next round's reading
        near = edges.join(rows.select(*NET, F.col("gene").alias("src"), "p"), [*NET, "src"]).groupBy(*NET, F.col("dst").alias("gene")).agg(F.sum(F.col("w") * F.col("p")).alias("m"))
        made = laid(rows.join(near, [*NET, "gene"], "left").select(*NET, "gene", "x", "r", "p", (F.col("p") - F.coalesce("m", F.lit(0.0))).alias("q")), *NET, "gene")
        dot = lambda u, v: F.sum(F.col(u) * F.col(v))
        sums = made.groupBy(*NET).agg(dot("r", "r").alias("rr"), dot("p", "q").alias("pq"), dot("r", "q").alias("rq"), dot("q", "q").alias("qq"))
        a = F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(F.lit(0.0))
        sums = sums.select(*NET, "rr", a.alias("a"), F.greatest(F.col("rr") - 2 * a * F.col("rq") + a * a * F.col("qq"), F.lit(0.0)).alias("after"))
        sums = stored(sums.select(*NET, "rr", "a", F.when(F.col("rr") > 0, F.col("after") / F.col("rr")).otherwise(F.lit(0.0)).alias("b")))
        if sums.join(spread(goal), NET).where("rr > goal").isEmpty():
            return made.join(root, [*NET, "gene"]).select(*NET, "gene", (F.col("x") * F.col("d")).alias("x"))
        step = made.join(spread(sums), NET).withColumns({"x": F.expr("x + a * p"), "r": F.expr("r - a * q")})
        rows = step.select(*NET, "gene", "x", "r", F.expr("r + b * p").alias("p"))
    raise ArithmeticError(f"no residual within {tolerance} after {rounds} steps")


def enhanced(net: DataFrame, root: bool = False, most: int | None = None) -> DataFrame:
    """NET, gene1, gene2, weight: W W' without its diagonal, for steps P = A / row sums and W = P / the roots of P's
    column sums (``root``: times them); negative weights count as 0.

    Genes that share a neighbour meet at it, which is as many pairs as its degree squared, summed in part
    by each task.  ``most`` keeps only the heaviest steps into each neighbour (the rest of a hub's are small), which
    bounds that.
    """
    edges = both_ways(net.where("gene1 <> gene2"), "lls").where("lls > 0").groupBy(*NET, "src", "dst").agg(F.sum("lls").alias("lls"))
    out = edges.groupBy(*NET, "src").agg(F.sum("lls").alias("total"))
    p = edges.join(out, [*NET, "src"]).select(*NET, "src", "dst", (F.col("lls") / F.col("total")).alias("p"))
    into = p.groupBy(*NET, "dst").agg(F.sqrt(F.sum("p") + 1e-16).alias("d"))
    w = p.join(into, [*NET, "dst"]).select(*NET, "src", "dst", (F.col("p") * F.col("d") if root else F.col("p") / F.col("d")).alias("w"))
    if most is not None:
        w = w.withColumn("r", F.row_number().over(Window.partitionBy(*NET, "dst").orderBy(F.desc("w"), "src"))).where(F.col("r") <= most).drop("r")
    w = stored(w)
    side = lambda i: w.select(*NET, "dst", F.col("src").alias(f"gene{i}"), F.col("w").alias(f"w{i}"))
    return side(1).join(side(2), [*NET, "dst"]).where("gene1 < gene2").groupBy(*NET, "gene1", "gene2").agg(F.sum(F.col("w1") * F.col("w2")).alias("weight"))


def core_centrality(net: DataFrame, groups: DataFrame) -> DataFrame:
    """NET, gene, label, core, z: core numbers within the edges of a group (NET, gene, label), over
    their standard deviation in the group (1 where that is 0)."""
    side = lambda k: groups.select(*NET, F.col("gene").alias(f"gene{k}"), F.col("label").alias(f"l{k}"))
    inside = net.join(side(1), [*NET, "gene1"]).join(side(2), [*NET, "gene2"]).where("l1 = l2").select(*net.columns)
    rows = groups.join(core_numbers(inside), [*NET, "gene"], "left").select(*NET, "gene", "label", F.coalesce("core", F.lit(0)).alias("core"))
    sd = rows.groupBy(*NET, "label").agg(F.stddev_samp("core").alias("sd"))
    return rows.join(sd, [*NET, "label"]).select(*NET, "gene", "label", "core", (F.col("core") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))).alias("z"))
