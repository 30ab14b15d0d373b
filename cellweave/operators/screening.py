"""Selecting, translating and ranking the rows of counts, networks and their annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .network import top_hub

#: Names that are left out of top features.
BLACKLIST = r"\.|^RPL|^RPS|^MRP|^MT-|^MT|^RP|MALAT1|B2M|GAPDH"
#: Names of weight columns.
WEIGHTS = ("lls", "weight", "scinet_weight")


def qc_by_group(counts: DataFrame, cells: DataFrame, by: str, min_cells: int, min_features: int, min_umis: float) -> DataFrame:
    """Counts without the cells and features that the bounds drop within any group: groups are
    filtered apart, each until nothing changes, and what one of them drops goes everywhere."""
    groups = cells.select(by).distinct().count()
    whole = left = cut(counts.join(cells.select("cell_id", by), "cell_id"))
    size = left.count()
    while True:
        some = left.groupBy(by, "cell_id").agg(F.sum("value").alias("umis"), F.count_if(F.col("value") > 0).alias("features"))
        some = some.where((F.col("features") >= min_features) & (F.col("umis") >= min_umis)).select(by, "cell_id")
        features = left.groupBy(by, "feature").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_cells).select(by, "feature")
        left = cut(left.join(some, [by, "cell_id"], "left_semi").join(features, [by, "feature"], "left_semi"))
        now = left.count()
        if now == size:
            break
        size = now
    everywhere = left.groupBy("feature").agg(F.countDistinct(by).alias("k")).where(F.col("k") == groups)
    return whole.join(left.select("cell_id").distinct(), "cell_id", "left_semi").join(everywhere, "feature", "left_semi").select("cell_id", "feature", "value")


def subset(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` are all among the ids (one column), as both ends of an edge."""
    for c in columns:
        rows = rows.join(ids.select(F.col(ids.columns[0]).alias(c)), c, "left_semi")
    return rows


def groups(rows: DataFrame, by: str, use: list | None = None) -> DataFrame:
    """Rows of the groups ``use``, or those of any group."""
    return rows.where(F.col(by).isNotNull() if use is None else F.col(by).isin(use))


def top_features(scores: DataFrame, group: str, score: str, k: int, symbol: Column | None = None) -> DataFrame:
    """The k best features of each group whose names are not on the blacklist; ties by feature."""
    name = F.col("feature") if symbol is None else symbol
    w = Window.partitionBy(group).orderBy(F.desc(score), "feature")
    return scores.where(~name.rlike(BLACKLIST)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_union(ranked: DataFrame, n: int) -> DataFrame:
    """Genes among the n best of any network."""
    return top_hub(ranked, n).select("gene").distinct()


def by_magnitude(rows: DataFrame, score: str, *ties: str) -> DataFrame:
    """Rows in order of the absolute score, signs kept."""
    return rows.orderBy(F.desc(F.abs(score)), *ties)


def is_network(net: DataFrame) -> bool:
    """Whether the table has two ends and a weight."""
    return {"gene1", "gene2"} <= set(net.columns) and any(w in map(str.lower, net.columns) for w in WEIGHTS)


def translate(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` replaced by its first name in ``names`` (id, name, position), "" without one."""
    first = names.where("name IS NOT NULL").groupBy(F.col("id").alias(column)).agg(F.min_by("name", "position").alias("_name"))
    return rows.join(first, column, "left").withColumn(column, F.coalesce("_name", F.lit(""))).drop("_name")


def categorise(rows: DataFrame, below: int = 50) -> tuple[DataFrame, dict[str, list]]:
    """``rows`` with every column of fewer than ``below`` distinct values (null is none of the levels, but counts) as codes
    from 1, in order of the values, and those levels by column.  One pass counts, approximately where many; a second
    reads the levels of the columns that may have few, of which no more than ``below`` a column reach the driver."""
    names = [c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))]
    if not names:
        return rows, {}
    seen = rows.agg(*[F.approx_count_distinct(c, 0.05).alias(f"c{i}") for i, c in enumerate(names)]).first()
    maybe = [c for i, c in enumerate(names) if seen[f"c{i}"] < 2 * below]
    levels = {}
    for c in maybe:
        values = [r[0] for r in rows.select(c).distinct().limit(below).collect()]
        if len(values) < below:
            levels[c] = sorted(v for v in values if v is not None)
    codes = {c: F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(f"`{c}`")).cast("int") if vs else F.lit(None).cast("int") for c, vs in levels.items()}
    return rows.withColumns(codes) if codes else rows, levels


def drop_constant(rows: DataFrame) -> DataFrame:
    """Without the columns that hold a single value, null being a value, by one pass of bounds."""
    of = [F.struct(F.count(c).alias("n"), (F.min(c) == F.max(c)).alias("same")).alias(f"c{i}") for i, c in enumerate(rows.columns)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *of).first()
    single = [c for i, c in enumerate(rows.columns) if seen.n and (seen[f"c{i}"].n == 0 or seen[f"c{i}"].n == seen.n and seen[f"c{i}"].same)]
    return rows.drop(*single)


def shared_features(*tables: DataFrame) -> DataFrame:
    """Features that all tables have."""
    return reduce(lambda a, b: a.intersect(b), [t.select("feature") for t in tables])


def matched(a: DataFrame, b: DataFrame, on: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Both tables, each with the features that the other has too."""
    return a.join(b.select(on), on, "left_semi"), b.join(a.select(on), on, "left_semi")


def join_ranks(ranked: DataFrame, other: DataFrame, on: list[str], value: str) -> DataFrame:
    """Ranks with those of another ranking, 0 where it lacks the gene."""
    return ranked.join(other.select(*on, value), on, "left").fillna(0.0, [value])


#: Coefficients of Wichura's algorithm AS 241 (PPND16), numerators and denominators of
#: the centre, the near and the far tail, by rising power.
AS241 = (
    ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
     (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)),
    ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1)."""
    ratio = lambda part, x: reduce(lambda s, c: s * x + c, reversed(part[0]), F.lit(0.0)) / reduce(lambda s, c: s * x + c, reversed(part[1]), F.lit(0.0))
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(AS241[1], r - 1.6)).otherwise(ratio(AS241[2], r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(AS241[0], 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_ranks(rows: DataFrame, by: list[str], value: str, ties: str) -> DataFrame:
    """Adds "normal", the normal quantile of rank / (n + 1); ties rank in the order of ``ties``."""
    w = Window.partitionBy(*by)
    p = F.row_number().over(w.orderBy(value, ties)) / (F.count(F.lit(1)).over(w) + 1)
    return rows.withColumn("normal", inverse_normal(p))


def running_variance(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds "variance", the sample variance of the values so far; null for the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("variance", F.var_samp(value).over(w))
