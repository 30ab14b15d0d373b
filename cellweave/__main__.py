"""Command line: python -m cellweave find-hubs | diff-analysis | network-stats | convert.

Networks are CSV or Parquet files, one each, named <cell type>_<condition>; results are written as
folders of CSV, converted networks as Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, hubs
from .operators import network as N
from .sources import networks as S


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellweave")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("find-hubs", "diff-analysis", "network-stats", "convert"):
        c = commands.add_parser(name)
        c.add_argument("--networks", required=True, help="folder of network files")
        c.add_argument("--output", required=True, help="folder to write")
        c.add_argument("--format", default="csv", choices=["csv", "parquet"])
        c.add_argument("--reference", help="reference network; without one the networks' own lls count")
        if name == "find-hubs":
            c.add_argument("--method", default="degree", choices=["degree", "betweenness", "closeness", "eigenvector"], help="centrality that is ranked and tested")
            c.add_argument("--threshold", type=float, default=0.05)
        if name == "diff-analysis":
            for option in ("--metadata", "--celltype-col", "--condition-col", "--control", "--disease"):
                c.add_argument(option, required=True)
            c.add_argument("--min-cells", type=int, default=500)
    return p


def read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    nets = S.load_networks(spark, args.networks, args.format).withColumnRenamed("LLS", "lls")
    name = r"^(.*)_([^_]*)$"
    nets = nets.select(F.regexp_extract("net_id", name, 1).alias("celltype"), F.regexp_extract("net_id", name, 2).alias("condition"), "gene1", "gene2", "lls", "scinet_weight")
    nets = N.canonical(nets)
    return N.align(nets.drop("lls"), S.read_reference(spark, args.reference)) if args.reference else nets


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    net = read(spark, args)
    if args.command == "find-hubs":
        return hubs.find_all_hub(net, reps=None, seed=1, centrality=args.method).where(F.col("q") <= args.threshold)
    if args.command == "diff-analysis":
        cells = spark.read.option("header", True).csv(args.metadata).select(F.col(args.celltype_col).alias("celltype"), F.col(args.condition_col).alias("condition"))
        return hubs.find_diff_hub(net, cells, args.control, args.disease, reps=None, seed=1, min_cells=args.min_cells)
    if args.command == "network-stats":
        return N.network_stats(net).join(graph.component_sizes(net), N.NET)
    return net


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    result = run(spark, args)
    if args.command == "convert":
        result.write.partitionBy(*N.NET).parquet(args.output)
    else:
        result.write.option("header", True).csv(args.output)


if __name__ == "__main__":
    main()
