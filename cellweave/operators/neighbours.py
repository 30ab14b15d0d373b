"""Neighbour graphs of cells: NN-descent as joins, and the network of adaptive mutual neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .profiles import adaptive_neighbours

GRAPH = "id long, other long, distance double"
#: Points of a leaf, about; points from which a tree's planes come; trees.
LEAF, SAMPLE, TREES = 2**13, 2**15, 6


def distances(x: np.ndarray, measure: str) -> np.ndarray:
    """Between all rows of x: 1 - cosine of unit rows, or the root of the Jensen-Shannon divergence (base 2) of rows that sum to 1."""
    if measure == "cosine":
        return np.clip(1 - x @ x.T, 0, 2)
    own = np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(1)
    out = np.empty((len(x), len(x)))
    for i, row in enumerate(x):
        mean = (row + x) / 2
        out[i] = (own[i] + own) / 2 - np.where(mean > 0, mean * np.log2(np.where(mean > 0, mean, 1)), 0).sum(1)
    return np.sqrt(np.clip(out, 0, 1))


def prepared(points: DataFrame, id_col: str, vector_col: str, measure: str) -> DataFrame:
    """id, x: scaled vectors, one an id; those that are null, zero, or hold null or negative (for jsd) parts are left out."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = points.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))")
    size = "aggregate(x, 0D, (a, v) -> a + v)" if measure == "jsd" else "sqrt(aggregate(x, 0D, (a, v) -> a + v * v))"
    if measure == "jsd":
        rows = rows.where("forall(x, v -> v >= 0)")
    rows = rows.groupBy("id").agg(F.min("x").alias("x")).withColumn("size", F.expr(size)).where("size > 0")
    return rows.select("id", F.expr("transform(x, v -> v / size)").alias("x"))


def first_of(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """Up to ``n`` rows of each key in an order; tasks cut their own rows first."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def between(x: np.ndarray, y: np.ndarray, measure: str, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, distance of the pairs of rows of x and y whose distance, as in ``distances``, may be below ``most``[i, j]."""
    if measure == "cosine":
        d = np.clip(1 - x @ y.T, 0, 2)
        i, j = np.nonzero(d < most)
        return i, j, d[i, j]
    # the divergence in bits is at least the squared Hellinger distance, which is one product of matrices
    i, j = np.nonzero(1 - np.sqrt(x) @ np.sqrt(y).T < most * most + 1e-12)
    log = lambda v: np.where(v > 0, v * np.log2(np.where(v > 0, v, 1)), 0).sum(1)
    return i, j, np.sqrt(np.clip((log(x)[i] + log(y)[j]) / 2 - log((x[i] + y[j]) / 2), 0, 1))


def joined_locally(lists: DataFrame, measure: str) -> DataFrame:
    """id, other, distance of pairs in a list (members: id, fresh, bound, x) with a fresh one, under either's bound."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            items, ends = lists.values, lists.offsets.to_numpy()
            ids, fresh, bound = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = items.field(3)
            flat, at = x.values.to_numpy(), x.offsets.to_numpy()
            rows = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                new = np.nonzero(fresh[a:b])[0]
                if b - a < 2 or not len(new):
                    continue
                own = flat[at[a] : at[b]].reshape(b - a, -1)
                i, j, d = between(own[new], own, measure, np.maximum(bound[a:b][new, None], bound[None, a:b]))
                i = new[i]
                there = (d < bound[a:b][i]) & (i != j)
                back = (d < bound[a:b][j]) & ~fresh[a:b][j]
                rows[0].append(ids[a:b][np.concatenate([i[there], j[back]])])
                rows[1].append(ids[a:b][np.concatenate([j[there], i[back]])])
                rows[2].append(np.concatenate([d[there], d[back]]))
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], names=["id", "other", "distance"])

    return lists.mapInArrow(measured, GRAPH)


def random_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level the planes of its nodes (a normal a row, and where they lie): between two random points of a node, at its median."""
    levels, groups = [], [np.arange(len(sample))]
    for _ in range(depth):
        planes, after = [], []
        for own in groups:
            a, b = sample[rng.choice(own, 2, replace=False)] if len(own) > 1 else sample[:1].repeat(2, 0)
            side = sample[own] @ (a - b)
            at = np.median(side) if len(own) else 0.0
            planes.append((a - b, at))
            after += [own[side < at], own[side >= at]]
        groups = after
        levels.append((np.array([p for p, _ in planes]), np.array([at for _, at in planes])))
    return levels


def leaf_of(y: np.ndarray, luck: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each row; those on a plane go by bits of ``luck``, so that no leaf takes all of them."""
    node = np.zeros(len(y), np.int64)
    for i, (normals, at) in enumerate(levels):
        side = np.einsum("ij,ij->i", y, normals[node]) - at[node]
        node = 2 * node + ((side > 0) | ((side == 0) & (luck >> i & 1 == 1)))
    return node


def nearest_within(ids: np.ndarray, x: np.ndarray, k: int, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """id, other, distance: about the k nearest of each row among the others (for jsd of the nearest by the Hellinger distance)."""
    y = (np.sqrt(x) if measure == "jsd" else x).astype(np.float32)
    own = np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(1)
    asked, high = min(len(ids) - 1, k + k // 2), max(1, 2**19 // len(ids))
    for top in range(0, len(ids) if asked else 0, high):
        rows = np.arange(top, min(len(ids), top + high))
        near = y[rows] @ y.T
        near[rows - top, rows] = -np.inf
        j = np.argpartition(near, len(ids) - asked, 1)[:, len(ids) - asked :] if asked < len(ids) - 1 else np.argsort(near, 1)[:, 1:]
        i = np.repeat(rows, asked)
        if measure == "cosine":
            d = np.clip(1 - np.einsum("ij,ij->i", x[i], x[j.ravel()]), 0, 2)
        else:
            mean = (x[i] + x[j.ravel()]) / 2
            d = np.sqrt(np.clip((own[i] + own[j.ravel()]) / 2 - (mean * np.log2(np.where(mean > 0, mean, 1))).sum(1), 0, 1))
        d = d.reshape(j.shape)
        best = np.argsort(d, 1)[:, :k]
        yield np.repeat(ids[rows], best.shape[1]), ids[np.take_along_axis(j, best, 1).ravel()], np.take_along_axis(d, best, 1).ravel()


def begun(cells: DataFrame, n: int, k: int, measure: str, seed: int) -> DataFrame:
    """id, other, distance: the nearest of each point among those of its leaves in ``TREES`` random trees.

    The planes come from about ``SAMPLE`` points (fewer of long vectors); each point goes to one leaf a tree, of about ``LEAF`` points, where all meet.
    """
    few = max(2**10, min(SAMPLE, 2**22 // max(1, cells.select(F.size("x")).first()[0])))
    drawn = cells.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(-(-n // few))) == 0).orderBy("id").limit(2 * few).toArrow()
    if not len(drawn):
        drawn = cells.orderBy("id").limit(1).toArrow()
    flat = drawn.column("x").combine_chunks()
    sample, rng = flat.values.to_numpy(zero_copy_only=False).reshape(len(flat), -1), np.random.default_rng(seed)
    sample = np.sqrt(sample) if measure == "jsd" else sample
    depth = max(0, math.ceil(math.log2(n / LEAF)))
    trees = [random_tree(sample, depth, rng) for _ in range(TREES if depth else 1)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, luck = np.sqrt(x) if measure == "jsd" else x, batch.column(2).to_numpy()
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of(y, luck >> t, tree) * len(trees) + t), batch.column(0), batch.column(1)], names=["leaf", "id", "x"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def result():
            for rows in nearest_within(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), k, measure):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["id", "other", "distance"])

        for batch in batches:
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            ends = [0, *np.nonzero(np.diff(leaf))[0] + 1, len(leaf)] if len(leaf) else []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if held and leaf[a] != last:
                    yield from result()
                    held = []
                last = leaf[a]
                held.append((ids[a:b], x[a:b]))
        if held:
            yield from result()

    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = cells.select("id", "x", F.xxhash64("id", F.lit(seed + 1)).alias("luck")).mapInArrow(dealt, "leaf long, id long, x array<double>")
    return leaves.repartition(tasks, "leaf").sortWithinPartitions("leaf", "id").mapInArrow(met, GRAPH)


def nn_descent(points: DataFrame, k: int = 20, measure: str = "jsd", sample: float = 0.8, least: float = 0.002, seed: int = 0, id_col: str = "id", vector_col: str = "x") -> DataFrame:
    """id, other, distance: about the ``k`` nearest of each point (id, vector), by NN-descent; ties to smaller ids among equal vectors.

    Equal vectors are one point of the search.  Where more than ``k`` are equal their nearest are one another;
    the others take their equals first and then the members of the nearest points found.
    """
    cells = stored(prepared(points, id_col, vector_col, measure))
    points = stored(cells.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")))
    if points.where("size > 1").isEmpty():
        return searched(cells, k, measure, sample, least, seed)
    named = stored(cells.join(points.withColumnRenamed("id", "point"), "x").select("id", "point", "size"))
    firsts = stored(named.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("id"))).where(F.col("rank") <= k + 1).select("point", F.col("id").alias("other"), "rank"))
    same = named.where("size > 1").join(firsts, "point").where((F.col("id") != F.col("other")) & ((F.col("rank") <= k) | (F.col("id") < F.col("other"))))
    same = same.select("id", "other", F.lit(0.0).alias("distance"))
    if points.where(F.col("size") <= k).isEmpty():
        return same
    near = searched(points.select("id", "x"), k, measure, sample, least, seed).withColumnsRenamed({"id": "point", "other": "next"})
    sizes = points.select(F.col("id").alias("point"), "size")
    near = near.join(sizes.where(F.col("size") <= k).withColumn("lacks", k + 1 - F.col("size")).drop("size"), "point").join(sizes.withColumnRenamed("point", "next"), "next")
    before = F.sum("size").over(Window.partitionBy("point").orderBy("distance", "next").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    near = near.withColumn("before", before).where("before < lacks").select("point", "next", "distance", "lacks")
    near = near.join(firsts.withColumnRenamed("point", "next"), "next").withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("distance", "other"))).where("rank <= lacks")
    return same.unionByName(named.join(near.select("point", "other", "distance"), "point").select("id", "other", "distance"))


def searched(cells: DataFrame, k: int, measure: str, sample: float, least: float, seed: int) -> DataFrame:
    """``nn_descent`` of stored points (id, x).

    Neighbours begin with the nearest of the leaves of random trees (``begun``).  In a round each point gathers a sample of its neighbours and of the
    points that have it as one (at most ``sample`` k of each kind, so a point that is everyone's neighbour
    holds no more than others), and these are compared with one another, if one of a pair is new since
    the last round.  Ends when fewer than ``least`` of all k n places change.  No step sees all pairs:
    a round makes at most (4 sample k)^2 comparisons a point.
    """
    n = cells.count()
    if n < 2:
        return cells.sparkSession.createDataFrame([], GRAPH)
    first = begun(cells, n, k, measure, seed).repartition("id").groupBy("id", "other").agg(F.min("distance").alias("distance"))
    graph = first_of(first, "id", k, "distance", "other").withColumn("fresh", F.lit(True))
    size, turn = max(1, round(sample * k)), 0
    while True:
        graph = stored(graph)
        changed = graph.where("fresh").count()
        if turn and changed <= least * k * n:
            return graph.where("distance < double('inf')").select("id", "other", "distance")
        turn += 1
        luck = F.xxhash64("id", "other", F.lit(turn))
        taken = stored(first_of(graph.where("fresh"), "id", size, luck).select("id", "other", F.lit(True).alias("taken")))
        graph = graph.join(taken, ["id", "other"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        used = graph.where("taken OR NOT fresh").select("id", "other", F.col("taken").alias("fresh"))
        kind = F.concat(F.col("id").cast("string"), F.when(F.col("fresh"), "+").otherwise("-"))
        back = first_of(used.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh").withColumn("kind", kind), "kind", size, luck).drop("kind")
        members = used.unionByName(back).repartition("id").groupBy("id", F.col("other").alias("member")).agg(F.max("fresh").alias("fresh"))
        # lists without a fresh member have been compared
        members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("id"))).where("any").drop("any")
        bounds = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
        known = cells.join(bounds, "id", "left").select(F.col("id").alias("member"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "x")
        lists = members.join(known, "member").groupBy("id").agg(F.collect_list(F.struct("member", "fresh", "bound", "x")).alias("members")).select("members")
        found = joined_locally(lists, measure).groupBy("id", "other").agg(F.min("distance").alias("distance")).withColumn("fresh", F.lit(True))
        stays = graph.select("id", "other", "distance", (F.col("fresh") & ~F.col("taken")).alias("fresh"))
        merged = stays.unionByName(found).groupBy("id", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
        graph = first_of(merged, "id", k, "distance", "other")


def neighbour_network(points: DataFrame, k: int = 30, density: float = 1.0, mutual: bool = True, measure: str = "jsd", **options) -> DataFrame:
    """a, b, weight: edges between cells that are among each other's adaptive neighbours.

    Of the ``k`` nearest each cell keeps those up to its own cut; an edge weighs 1 - distance, combined
    as the geometric mean of both directions (``mutual``) or as half their sum.
    """
    near = adaptive_neighbours(nn_descent(points, k, measure, **options), ["id"], "other", density)
    rows = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.greatest(1 - F.col("distance"), F.lit(0.0)).alias("w"))
    both = rows.groupBy("a", "b").agg(F.sum("w").alias("total"), F.max("w").alias("most"), F.count(F.lit(1)).alias("sides"))
    # the distance is the same from both sides, so the geometric mean is the weight itself
    edges = both.where("sides = 2").withColumn("weight", F.col("most")) if mutual else both.withColumn("weight", F.col("total") / 2)
    return edges.where("weight > 0").select("a", "b", "weight")
