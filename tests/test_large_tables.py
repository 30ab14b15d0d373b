"""Tables on which work that grows with the square of a group does not end in time."""

import math
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import benchmark, expression, graph, hubs, nulls, statistics
from cellweave.operators import network as N
from cellweave.plans.catalog import QUERIES


class within:
    """Ends the session's jobs, so that the test fails, after some seconds."""

    def __init__(self, spark, seconds):
        self.timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)

    def __enter__(self):
        self.timer.start()

    def __exit__(self, *_):
        self.timer.cancel()


@pytest.fixture(scope="module")
def one_brand(spark, tmp_path_factory):
    """120,000 parts of one type, all but two of one brand: 7.2e9 pairs, of which few are bought together."""
    d = str(tmp_path_factory.mktemp("brand"))
    spark.range(120_000).selectExpr("id AS p_partkey", "'p' AS p_name", "IF(id < 119998, 'Brand#11', 'Brand#12') AS p_brand", "'TIN' AS p_type", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(30).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "IF(id % 2 = 0, 'BUILDING', 'MACHINERY') AS c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(60).selectExpr("id AS o_orderkey", "id % 30 AS o_custkey", "'F' AS o_orderstatus").write.parquet(f"{d}/orders.parquet")
    spark.range(240).selectExpr("id % 60 AS l_orderkey", "id * 7 AS l_partkey", "CAST(1 + id % 9 AS DOUBLE) AS l_quantity").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_a_reference_of_large_blocks_is_looked_up(spark, one_brand):
    with within(spark, 90):
        got = QUERIES["align_lls"](spark, one_brand).collect()
    assert len(got) == 60 * 6 and all(r["lls"] == 51 - abs(r["gene1"] % 50 - r["gene2"] % 50) for r in got)


def test_pairs_of_large_blocks_are_counted(spark, one_brand):
    with within(spark, 90):
        got = QUERIES["geneset_reference"](spark, one_brand).collect()
    assert [tuple(r) for r in got] == [("TIN", 120_000, 120_000, 119_998 * 119_997 // 2 + 1)]


def test_counted_pairs_are_those_of_the_reference(spark):
    r = random.Random(2)
    nodes = [(i, f"b{r.randrange(40)}" if i % 11 else None) for i in range(60)]
    sets = spark.createDataFrame([(f"s{r.randrange(4)}", r.randrange(70)) for _ in range(120)], "set_name string, gene long")  # some genes twice, some unknown
    pairs = [(i, j) for i, a in nodes for j, b in nodes if i < j and a is not None and a == b]
    want = N.reference_connectivity(spark.createDataFrame(pairs, "gene1 long, gene2 long"), sets)
    got = N.block_connectivity(spark.createDataFrame(nodes, "gene long, block string"), sets)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gold_standard_of_large_blocks(spark, one_brand):
    with within(spark, 120):
        got = QUERIES["lls_benchmark"](spark, one_brand).collect()
    assert [(r["bin"], r["tp"], r["fp"], r["genes"]) for r in got] == [(0, 360, 0, 240)]


def test_gold_standard_by_blocks_is_that_of_its_pairs(spark):
    r = random.Random(3)
    nodes = [(i, r.randrange(20)) for i in range(60)]
    pairs = [(i, j) for i, a in nodes for j, b in nodes if i < j and a == b]
    scored = spark.createDataFrame([(i, j, float(r.randrange(50))) for i in range(70) for j in range(i + 1, 70) if r.random() < 0.3], "gene1 long, gene2 long, score double")
    want = benchmark.lls_benchmark(scored, spark.createDataFrame(pairs, "gene1 long, gene2 long"), bin_size=50)
    got = benchmark.lls_benchmark(scored, blocks=spark.createDataFrame(nodes, "gene long, block long"), bin_size=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hommel_of_many_genes(spark):
    """60,000 genes of one group; steps by their square take minutes."""
    rows = spark.range(60_000).select(F.lit("a").alias("net"), "id", ((F.col("id") + 1) / 60_000).alias("p"))
    with within(spark, 40):
        got = N.p_adjust(rows, "p", ["net"], ["id"], ["hommel"]).agg(F.min("p_hommel"), F.max("p_hommel")).first()
    assert tuple(got) == pytest.approx((1.0, 1.0))  # evenly spread p are what chance gives


def test_simes_values():
    r = np.random.default_rng(4)
    for t in range(120):
        n = int(r.integers(1, 90))
        x = np.sort([r.random(n), r.integers(0, 6, n) / 5, 1 - np.arange(n) / max(1, n - 1), r.random(n) ** 5][t % 4])
        want = [(m * x[n - m :] / np.arange(1, m + 1)).min() for m in range(1, n + 1)]
        assert N.simes_values(x).tolist() == pytest.approx(want, rel=1e-15)


def test_fisher_of_large_counts(spark):
    """Tables of 4e6; a term for each of 2e6 possible counts takes minutes."""
    rows = spark.createDataFrame([(1_000_000, 1_000_000, 1_000_000, 1_000_000), (1_000_900, 999_100, 999_100, 1_000_900)], "a long, b long, c long, d long")
    with within(spark, 60):
        got = [r["p_value"] for r in statistics.fisher_exact(rows, "a", "b", "c", "d").collect()]
    assert got == pytest.approx([1.0, math.erfc(899.5 / 500 / 2**0.5)], rel=1e-3)


def test_null_networks_do_not_travel_by_edge(spark):
    """100 null networks are made where their edges are: a shuffle of every edge of each would be 100 times the edges."""
    rows = spark.range(300).select(F.lit("c").alias("celltype"), F.lit("x").alias("condition"), F.col("id").alias("gene1"), (F.col("id") * 7 % 300 + 300).alias("gene2"), (1 + F.col("id") % 5).cast("double").alias("lls"))
    net = spark.createDataFrame(rows.collect(), rows.schema)
    assert shuffled_rows(spark, hubs.null_strengths(hubs.rewired(net, 100, 0.0, 1)).groupBy("i").agg(F.avg("value"))) < 50 * 300
    scores = net.select(*N.NET, F.col("gene1").alias("gene"), F.col("lls").alias("x"))
    assert shuffled_rows(spark, nulls.shuffled(scores, 100, 1)) < 50 * 300


def shuffled_rows(spark, df):
    """Rows written to shuffles by a query."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "ShuffleExchangeExec":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_imputing_holds_no_sums_of_cells(spark):
    # cells x features were keys of a sum, so a task held those of all its cells
    profiles = spark.createDataFrame([("f", "a", 1.0), ("f", "b", 10.0), ("g", "b", 3.0), ("h", "c", 5.0), ("n", "a", None)], "feature string, archetype string, value double")
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "b", 1.0), (3, "x", 1.0), (4, None, 1.0), (5, "a", None)], "cell_id int, archetype string, weight double")
    out = expression.impute_by_archetypes(profiles, weights)
    want = {(1, "f", 3.0), (1, "g", 0.75), (1, "n", None), (2, "f", 10.0), (2, "g", 3.0), (5, "f", None), (5, "n", None)}
    assert {tuple(r) for r in out.collect()} == want
    assert not re.search(r"Aggregate.*cell_id#\d+, feature#\d+", out._jdf.queryExecution().optimizedPlan().toString())


def test_loops_join_laid_tables_where_they_are(spark):
    # the edges of a loop were shuffled anew in each round
    rows = spark.range(500).select(F.lit("a").alias("celltype"), F.lit("b").alias("condition"), (F.col("id") % 50).alias("src"), "id")
    edges, value = graph.laid(rows, *N.NET, "src"), graph.laid(rows.select(*N.NET, F.col("id").alias("gene"), F.lit(1).alias("x")), *N.NET, "gene")
    sent = edges.join(value.withColumnRenamed("gene", "src").hint("merge"), [*N.NET, "src"])
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString() and sent.count() == 500
