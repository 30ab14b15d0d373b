"""Archetypal analysis over distributed points, and the pruning of archetypes of several analyses.

Points stay where they are: a round sums the normal equations of all weights over the tasks, and archetypes
are moved by passes that look for the point with the steepest slope.  The driver sees matrices of
archetypes x archetypes, archetypes x length of a point, and the few points that archetypes rest on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decomposition import block, gram, simplex_regression, simplex_weights, successive_projection
from .graph import stored
from .triangles import transitivity

#: Points that an archetype rests on: id -> (vector, weight).
Support = dict[object, tuple[np.ndarray, float]]


def normal_sums(points: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, tuple]:
    """H H', X' H, the squared residual and (id, x) of the farthest point, for the best weights H over ``w``."""
    d, k = w.shape
    kind = dict(points.dtypes)["id"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hh, xh, rss, far = np.zeros((k, k)), np.zeros((d, k)), 0.0, None
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(1))
                h = simplex_weights(w, x)
                left = ((x - h @ w.T) ** 2).sum(1)
                hh, xh, rss = hh + h.T @ h, xh + x.T @ h, rss + left.sum()
                at = int(left.argmax())
                if far is None or left[at] > far[0]:
                    far = (float(left[at]), batch.column(0)[at].as_py(), x[at])
        if far is not None:
            sums = np.concatenate([hh.ravel(), xh.ravel(), [rss]])
            yield pa.RecordBatch.from_pylist([{"sums": sums.tolist(), "far": far[0], "id": far[1], "x": far[2].tolist()}], schema=pa.schema([("sums", pa.list_(pa.float64())), ("far", pa.float64()), ("id", batch.schema.field("id").type), ("x", pa.list_(pa.float64()))]))

    found = points.mapInArrow(part, f"sums array<double>, far double, id {kind}, x array<double>")
    size = k * k + d * k + 1
    row = found.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"), F.max_by(F.struct("id", "x"), F.struct("far", "id")).alias("p")).first()
    sums = np.array(row["sums"])
    return sums[: k * k].reshape(k, k), sums[k * k : -1].reshape(d, k), float(sums[-1]), (row["p"]["id"], np.array(row["p"]["x"]))


def steepest(points: DataFrame, slopes: np.ndarray) -> dict[int, tuple]:
    """(id, x, x . slope) of the point with the least product with each column of ``slopes``; ties by id."""
    k, kind = slopes.shape[1], dict(points.dtypes)["id"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = block(batch.column(1)) @ slopes
                at = score.argmin(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(score.min(0)), batch.column(0).take(at), batch.column(1).take(at)], names=["i", "score", "id", "x"])

    found = points.mapInArrow(part, f"i long, score double, id {kind}, x array<double>").groupBy("i").agg(F.min_by(F.struct("id", "x", "score"), F.struct("score", "id")).alias("p"))
    return {r["i"]: (r["p"]["id"], np.array(r["p"]["x"]), r["p"]["score"]) for r in found.collect()}


def rest(supports: list[Support], w: np.ndarray, hh: np.ndarray, xh: np.ndarray, sweeps: int = 5, tolerance: float = 1e-6) -> np.ndarray:
    """Better weights of the supports' points, archetype by archetype, in ``sweeps`` or until none moves by more than
    ``tolerance`` of the largest part of any; changes ``supports``."""
    scale = max(np.abs(w).max(), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for i, own in enumerate(supports):
            if hh[i, i] < 1e-8:
                continue
            goal = w[:, i] + (xh[:, i] - w @ hh[:, i]) / hh[i, i]
            atoms = np.array([x for x, _ in own.values()]).T
            c = simplex_weights(atoms, goal[None], 1e-9 if sweeps < 100 else 1e-12)[0]
            new = atoms @ c
            moved = max(moved, np.abs(new - w[:, i]).max())
            w[:, i] = new
            supports[i] = {p: (x, float(v)) for (p, (x, _)), v in zip(own.items(), c, strict=True)}
        if moved <= tolerance * scale:
            break
    return w


def archetypal_analysis(points: DataFrame, k: int, tolerance: float = 1e-6, gap: float = 1e-7, rounds: int = 100) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(archetype, id, weight) of the points that archetypes rest on, the archetypes as columns, and the squared
    residual of each round, which never rises.

    Points X (id, x) are approximated by mixtures H of archetypes W, which are themselves mixtures C of points:
    least |X - X C H|^2.  Rounds alternate: H by simplex regression, C by conditional gradients in which every
    pass over the points adds the steepest one to each archetype's support and the weights over the supports are
    solved again, until the duality gap is a tenth of the round's first or at most ``gap`` of |X|^2.  It ends when the residual changes by less than
    ``tolerance`` of |X|, and raises after ``rounds``.  An archetype that no point uses moves to the farthest
    point.  Points with nulls take no part; where fewer than ``k`` points are independent there are fewer archetypes.
    """
    points = stored(points.where("x IS NOT NULL AND forall(x, v -> v IS NOT NULL)").select("id", F.expr("transform(x, v -> cast(v as double))").alias("x")))
    chosen = [i for i, _ in successive_projection(points, k)]
    at = {r["id"]: np.array(r["x"]) for r in points.where(F.col("id").isin(chosen)).collect()} if chosen else {}
    spark, kind = points.sparkSession, dict(points.dtypes)["id"]
    if not at:
        return spark.createDataFrame([], f"archetype int, id {kind}, weight double"), np.zeros((0, 0)), []
    supports: list[Support] = [{i: (at[i], 1.0)} for i in chosen]
    w = np.array([at[i] for i in chosen]).T
    size = points.agg(F.sum(F.expr("aggregate(x, 0D, (s, v) -> s + v * v)"))).first()[0]
    trace: list[float] = []
    for _ in range(rounds):
        hh, xh, rss, far = normal_sums(points, w)
        trace.append(rss)
        if len(trace) > 1 and abs(np.sqrt(trace[-2]) - np.sqrt(rss)) <= tolerance * np.sqrt(size):
            rows = [(i, p, c) for i, own in enumerate(supports) for p, (_, c) in own.items() if c > 0]
            return spark.createDataFrame(rows, f"archetype int, id {kind}, weight double"), w, trace
        idle = [i for i in range(w.shape[1]) if hh[i, i] < 1e-8]
        for i in idle[:1]:  # one at a time, as several would move to the same point
            supports[i], w[:, i] = {far[0]: (far[1], 1.0)}, far[1]
        supports = [{p: v for p, v in own.items() if v[1] > 1e-12} for own in supports]
        w = rest(supports, w, hh, xh)  # the sums are new, also for the points at hand
        enough = gap * size
        while True:
            slopes = w @ hh - xh
            best = steepest(points, slopes)
            left = sum(w[:, i] @ slopes[:, i] - best[i][2] for i in best)
            if left <= enough:
                break
            enough = max(enough, 0.1 * left)  # a tenth of the round's first gap will do, as H changes next
            fresh = [i for i in best if i not in idle and best[i][0] not in supports[i]]
            if not fresh:
                w = rest(supports, w, hh, xh, 1000, 1e-9)
                break
            for i in fresh:
                supports[i][best[i][0]] = (best[i][1], 0.0)
            w = rest(supports, w, hh, xh)
    raise ArithmeticError(f"the residual still moves after {rounds} rounds")


def archetype_levels(points: DataFrame, depths: list[int], **options) -> tuple[DataFrame, DataFrame]:
    """Analyses of several sizes stacked: (id, h), weights of all archetypes, and (archetype, id, weight), what they rest on."""
    columns, supports, start = [], None, 0
    for k in depths:
        own, w, _ = archetypal_analysis(points, k, **options)
        columns.append(stored(simplex_regression(points, w).withColumnRenamed("h", f"h{k}")))
        own = own.withColumn("archetype", (F.col("archetype") + start).cast("int"))
        supports, start = own if supports is None else supports.unionByName(own), start + w.shape[1]
    h = columns[0]
    for other in columns[1:]:
        h = h.join(other, "id")
    return stored(h.select("id", F.concat(*[f"h{k}" for k in depths]).alias("h"))), stored(supports)


def prune_archetypes(weights: DataFrame, supports: DataFrame, min_z: float = -1.0, min_cells: int = 3, near: float = 1e-3) -> DataFrame:
    """archetype, transitivity, z, landmark, cells, kept.

    ``weights`` (id, h) are all archetypes' weights, ``supports`` (archetype, id, weight) the points that they rest on.
    Archetypes correlate by their weights over the points (negative as 0); one is kept if the z-score of its
    weighted transitivity in that network is at least ``min_z`` (0 where it has none), a point it rests on is among those whose
    weight is within ``near`` of its largest (the heaviest of those is the landmark, ties by id), and it rests
    on ``min_cells`` points or more.
    """
    spark = weights.sparkSession
    first = weights.select(F.size("h")).first()
    k = first[0] if first else 0
    g = gram(weights.select("id", F.concat("h", F.array(F.lit(1.0))).alias("h")).select("h"), "h", k + 1)
    n = max(g[k, k], 1.0)
    cov = g[:k, :k] / n - np.outer(g[k, :k], g[k, :k]) / (n * n)
    sd = np.sqrt(np.maximum(cov.diagonal(), 0))
    corr = np.where(np.outer(sd, sd) > 1e-14, cov / np.where(np.outer(sd, sd) > 1e-14, np.outer(sd, sd), 1), 0)
    edges = [("", "", i, j, float(corr[i, j])) for i in range(k) for j in range(i + 1, k) if corr[i, j] > 1e-12]
    net = spark.createDataFrame(edges, "celltype string, condition string, gene1 int, gene2 int, lls double")
    ids = spark.range(k).select(F.col("id").cast("int").alias("archetype"))
    scored = ids.join(transitivity(net).select(F.col("gene").alias("archetype"), "transitivity"), "archetype", "left")
    moments = scored.agg(F.avg("transitivity").alias("m"), F.stddev_samp("transitivity").alias("s"))
    scored = scored.join(F.broadcast(moments), F.lit(True)).withColumn("z", F.when(F.col("s") > 0, (F.col("transitivity") - F.col("m")) / F.col("s"))).withColumn("z", F.coalesce("z", F.lit(0.0)))
    at = weights.select("id", F.posexplode("h").alias("archetype", "h"))
    top = at.groupBy("archetype").agg(F.max("h").alias("top"))
    marks = supports.where("weight > 0").join(at, ["archetype", "id"]).join(top, "archetype").where(F.col("top") - F.col("h") < near)
    marks = marks.groupBy("archetype").agg(F.min_by("id", F.struct(-F.col("weight"), "id")).alias("landmark"))
    cells = supports.where("weight > 1e-6").groupBy("archetype").agg(F.count(F.lit(1)).alias("cells"))
    out = scored.join(marks, "archetype", "left").join(cells, "archetype", "left").fillna(0, ["cells"])
    kept = (F.col("z") >= min_z) & F.col("landmark").isNotNull() & (F.col("cells") >= min_cells)
    return out.select("archetype", "transitivity", "z", "landmark", "cells", kept.alias("kept"))
