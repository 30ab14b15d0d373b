"""Count matrices in text files: MatrixMarket triples, delimited tables, sparse export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXPRESSION = "Gene Expression"


def numbered(read: DataFrame, keep=None) -> DataFrame:
    """Rows of a text source with ``line``, their number from 0 over its files in order.

    ``keep`` filters rows before they are numbered.  Rows are counted by file block, and only the
    few block sums are put in order, so no task sees the whole file.
    """
    rows = read.select(*read.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    rows = (rows if keep is None else rows.where(keep)).withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("_file", "_block", (F.coalesce(ahead, F.lit(0)) - F.col("_least")).alias("_shift"))
    return rows.join(F.broadcast(starts), ["_file", "_block"]).select(*read.columns, (F.col("_id") + F.col("_shift")).alias("line"))


def read_triple(spark: SparkSession, folder: str, matrix: str = "matrix.mtx.gz", features: str = "features.tsv.gz", barcodes: str = "barcodes.tsv.gz", sep: str = "\t", use_names: bool = True) -> dict[str, DataFrame]:
    """features (number, id, name, kind), cells (number, cell_id), counts and maps.

    counts holds features of gene expression (or all, without kinds) by name, maps the others by
    kind and id.  A header line is recognised by one line more than the matrix has rows or columns.
    """
    body = numbered(spark.read.text(f"{folder}/{matrix}"), ~F.col("value").startswith("%"))
    field = F.split(F.trim("value"), r"\s+")
    n_rows, n_cols = body.where("line = 0").select(field[0].cast("long"), field[1].cast("long")).first()

    def table(name: str, expected: int) -> DataFrame:
        lines = numbered(spark.read.text(f"{folder}/{name}"), F.length("value") > 0)
        header = lines.count() == expected + 1
        return lines.where(F.col("line") >= int(header)).select((F.col("line") + 1 - int(header)).alias("number"), F.split("value", sep).alias("f"))

    f = table(features, n_rows)
    f = f.select("number", F.get("f", F.lit(0)).alias("id"), F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("name"), F.get("f", F.lit(2)).alias("kind"))
    cells = table(barcodes, n_cols).select("number", F.get("f", F.lit(0)).alias("cell_id"))
    entries = body.where("line > 0").select(field[0].cast("long").alias("i"), field[1].cast("long").alias("j"), F.coalesce(field[2].cast("double"), F.lit(1.0)).alias("value"))
    named = entries.where("value <> 0").join(f, F.col("i") == f.number).drop("number").join(cells, F.col("j") == cells.number).drop("number")
    expression = F.coalesce(F.col("kind"), F.lit(EXPRESSION)) == EXPRESSION
    return {
        "features": f,
        "cells": cells,
        "counts": named.where(expression).select("cell_id", F.col("name" if use_names else "id").alias("feature"), "value"),
        "maps": named.where(~expression).select("kind", "cell_id", F.col("id").alias("feature"), "value"),
    }


def read_10x(spark: SparkSession, folder: str, version: int = 3, **options) -> dict[str, DataFrame]:
    """``read_triple`` with the file names of version 2 (plain, genes.tsv) or 3 (gzip)."""
    names = {"matrix": "matrix.mtx", "features": "genes.tsv", "barcodes": "barcodes.tsv"} if version == 2 else {}
    return read_triple(spark, folder, **names | options)


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """cell_id, feature, value of a features x cells table; a first column of text names features,
    else their numbers from 1 do."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
    if dict(df.dtypes)[df.columns[0]] == "string":
        named, values = df.withColumnRenamed(df.columns[0], "feature"), df.columns[1:]
    else:
        named, values = numbered(df).withColumn("feature", (F.col("line") + 1).cast("string")), df.columns
    long = named.select("feature", *[F.col(f"`{c}`").cast("double").alias(c) for c in values]).unpivot("feature", list(values), "cell_id", "value")
    return long.where("value <> 0").select("cell_id", "feature", "value")


def write_sparse(counts: DataFrame, cells: DataFrame, folder: str) -> None:
    """features.txt, metadata.tsv and counts.mtx, each a folder of parts to be read in name order.

    ``cells`` has cell_id first.  Rows and columns are numbered by their lines in the two files.
    """
    spark = counts.sparkSession
    counts.select(F.col("feature").cast("string").alias("value")).distinct().write.text(f"{folder}/features.txt")
    cells.write.option("sep", "\t").csv(f"{folder}/metadata.tsv")
    f = numbered(spark.read.text(f"{folder}/features.txt")).select(F.col("value").alias("feature"), (F.col("line") + 1).alias("i"))
    c = numbered(spark.read.option("sep", "\t").schema(cells.schema).csv(f"{folder}/metadata.tsv")).select(F.col(cells.columns[0]).alias("cell_id"), (F.col("line") + 1).alias("j"))
    body = counts.withColumn("feature", F.col("feature").cast("string")).join(f, "feature").join(c, "cell_id")
    sizes = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{f.count()} {c.count()} {body.count()}",)], "value string").coalesce(1)
    sizes.union(body.select(F.concat_ws(" ", "i", "j", F.col("value").cast("string")).alias("value"))).write.text(f"{folder}/counts.mtx")
