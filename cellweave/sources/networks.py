"""Reading and writing networks, reference and table bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import canonical

EDGES = "gene1 string, gene2 string, LLS double, scinet_weight double"


def load_networks(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    """One network per file; net_id is the file's stem."""
    reader = spark.read.option("header", True).schema(EDGES) if fmt == "csv" else spark.read
    edges = reader.format(fmt).load(f"{folder}/*.{fmt}")
    return edges.withColumn("net_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1))


def save_networks(networks: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """One folder per network."""
    networks.write.partitionBy("net_id").option("header", True).format(fmt).save(folder)


def save_graphml(networks: DataFrame, folder: str) -> None:
    """One folder per network with one GraphML file: header, nodes, edges with LLS and
    scinet_weight, end.  Lines are sorted by Spark within the file's task, so none is held whole."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    weights = [c for c in ("LLS", "scinet_weight") if c in networks.columns]
    keys = "".join(f'<key id="{c}" for="edge" attr.name="{c}" attr.type="double"/>' for c in weights)
    net = networks.select("net_id").distinct()
    head = net.select("net_id", F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">').alias("value"))
    foot = net.select("net_id", F.lit(3).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("</graph></graphml>").alias("value"))
    name = networks.select("net_id", F.explode(F.array(F.col("gene1").cast("string"), F.col("gene2").cast("string"))).alias("a")).distinct()
    nodes = name.select("net_id", F.lit(1).alias("part"), "a", F.lit("").alias("b"), F.concat(F.lit('<node id="'), text(F.col("a")), F.lit('"/>')).alias("value"))
    data = [F.coalesce(F.concat(F.lit(f'<data key="{c}">'), F.col(c).cast("string"), F.lit("</data>")), F.lit("")) for c in weights]
    edges = networks.select("net_id", F.lit(2).alias("part"), F.col("gene1").cast("string").alias("a"), F.col("gene2").cast("string").alias("b"), F.concat(F.lit('<edge source="'), text(F.col("gene1")), F.lit('" target="'), text(F.col("gene2")), F.lit('">'), *data, F.lit("</edge>")).alias("value"))
    lines = head.unionByName(nodes).unionByName(edges).unionByName(foot)
    lines.repartition("net_id").sortWithinPartitions("net_id", "part", "a", "b").select("net_id", "value").write.partitionBy("net_id").text(folder)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """gene1, gene2, lls with endpoints in order, no loops, the heaviest of repeated edges; fails
    where a column is missing."""
    df = spark.read.parquet(path) if path.endswith("parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = {c.lower(): c for c in df.columns}
    missing = {"gene1", "gene2"} - set(names)
    weight = names.get("lls") or names.get("weight")
    if missing or not weight:
        raise ValueError(f"reference network lacks {missing or 'a weight'}")
    return canonical(df.select(df[names["gene1"]].alias("gene1"), df[names["gene2"]].alias("gene2"), df[weight].cast("double").alias("lls")))


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Assays, features, cells, maps and nets of an experiment, a Parquet folder each."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
