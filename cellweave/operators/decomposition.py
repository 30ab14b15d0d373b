"""Decompositions of sparse and dense tables: tall factors stay distributed, only matrices as small as
the number of factors (or one vector of a point's length) come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

ENTRIES = ("row", "col", "x")


def block(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gram(rows: DataFrame, name: str, size: int) -> np.ndarray:
    """X'X of a column of arrays, added up task by task, then entry by entry."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(0))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["i", "g"])

    out = np.zeros(size * size)
    for r in rows.select(name).mapInArrow(part, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[r["i"]] = r["g"]
    return out.reshape(size, size)


def times(rows: DataFrame, name: str, matrix: np.ndarray) -> DataFrame:
    """``rows`` (id, arrays) with the arrays multiplied by a small matrix from the right."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch.column(1)) @ matrix if batch.num_rows else np.zeros((0, matrix.shape[1]))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, matrix.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays], names=["id", name])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", name).mapInArrow(multiply, f"id {kind}, {name} array<double>")


def orthonormal(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Columns of the block made orthonormal by the inverse root of their Gram matrix, twice; directions
    without length become zeros."""
    for _ in range(2):
        length, axes = np.linalg.eigh(gram(rows, name, size))
        root = np.where(length > 1e-14 * max(length[-1], 1e-300), length, np.inf) ** -0.5
        rows = stored(times(rows, name, axes * root))
    return rows


def product(entries: DataFrame, key: str, to: str, vectors: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, v): the sparse table (row, col, x) times a block of vectors (id, v) along ``key``, for all ``ids``."""
    near = entries.join(vectors.select(F.col("id").alias(key), "v"), key).groupBy(F.col(to).alias("id")).agg(*[F.sum(F.col("x") * F.col("v")[i]).alias(f"v{i}") for i in range(size)])
    return ids.join(near, "id", "left").select("id", F.array(*[F.coalesce(f"v{i}", F.lit(0.0)) for i in range(size)]).alias("v"))


def normal(key: Column, i: int, seed: int) -> Column:
    """A standard normal number from hashes of a key: the same wherever a row lies."""
    u = lambda k: (F.pmod(F.xxhash64(key, F.lit(k), F.lit(i), F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))


def truncated_svd(entries: DataFrame, dim: int, oversample: int = 10, tolerance: float = 1e-10, rounds: int = 300, seed: int = 0, rows: DataFrame | None = None, cols: DataFrame | None = None) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(id, u) of rows, singular values, (id, v) of columns of the table (row, col, x); entries given twice add up.

    A block of hashed normal vectors is multiplied by the table and its transpose in turn and made
    orthonormal each time, until no wanted singular value moves by more than ``tolerance`` of the largest; else it
    raises.  ``rows`` and ``cols`` (id) name rows and columns that may lack entries.  Values past the table's rank are 0; there are no more than rows or columns.
    """
    entries = stored(entries.where("x <> 0").groupBy("row", "col").agg(F.sum(F.col("x").cast("double")).alias("x")))
    rows = stored((entries.select(F.col("row").alias("id")) if rows is None else rows.select("id")).distinct())
    cols = stored((entries.select(F.col("col").alias("id")) if cols is None else cols.select("id")).distinct())
    size = min(dim + oversample, rows.count(), cols.count())
    if not size:
        none = lambda df, name: df.select("id", F.array().cast("array<double>").alias(name))
        return none(rows, "u"), np.zeros(0), none(cols, "v")
    right = stored(cols.select("id", F.array(*[normal(F.col("id"), i, seed) for i in range(size)]).alias("v")))
    old = None
    for _ in range(rounds):
        left = orthonormal(product(entries, "col", "row", right, rows, size), "v", size)
        back = stored(product(entries, "row", "col", left, cols, size))
        square, axes = np.linalg.eigh(gram(back, "v", size))
        s, axes = np.sqrt(np.maximum(square, 0))[::-1], axes[:, ::-1]
        if old is not None and np.abs(s - old)[:dim].max() <= tolerance * s[0]:
            break
        old, right = s, orthonormal(back, "v", size)
    else:
        raise ArithmeticError(f"singular values still move after {rounds} rounds")
    s, axes = s[:dim], axes[:, :dim]
    inverse = np.where(s > 1e-12 * max(s[0], 1e-300), 1 / np.where(s > 0, s, 1), 0)
    return times(left, "v", axes).withColumnRenamed("v", "u"), s * (inverse > 0), times(back, "v", axes * inverse)


def reduced_kernel(entries: DataFrame, dim: int, **options) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(id, u), singular values, (id, v) after the mean direction of the rows was taken out of every column and
    the columns were centred.

    Both are changes of rank one, so the factors of the table itself are updated by a small problem of
    ``dim`` + 2: the table stays sparse.
    """
    entries = stored(entries.where("x <> 0").groupBy("row", "col").agg(F.sum(F.col("x").cast("double")).alias("x")))
    u, s, v = truncated_svd(entries, dim, **options)
    u, v = stored(u), stored(v)
    n, m = u.count(), v.count()
    sums = u.select("id").join(entries.groupBy(F.col("row").alias("id")).agg((F.sum("x") / m).alias("mu")), "id", "left").select("id", F.coalesce("mu", F.lit(0.0)).alias("mu"))
    length, mean = sums.agg(F.sqrt(F.sum(F.col("mu") * F.col("mu"))), F.avg("mu")).first()
    length = length or 1.0
    a = stored(sums.select("id", F.array(F.col("mu") / length, F.lit(1.0)).alias("a")))
    seen = entries.join(a.select(F.col("id").alias("row"), F.col("a")[0].alias("a1")), "row").groupBy(F.col("col").alias("id")).agg((-F.sum(F.col("x") * F.col("a1"))).alias("b1"), (F.sum("x") / n).alias("c"))
    b1, c = F.coalesce("b1", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    b = stored(v.select("id").join(seen, "id", "left").select("id", F.array(b1, -(mean / length * b1 + c)).alias("b")))
    size = len(s)

    def extended(factors: DataFrame, name: str, more: DataFrame, extra: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """[factors, more], the share of more within factors, and what makes the rest orthonormal."""
        both = stored(factors.join(more, "id").select("id", F.concat(name, extra).alias(name)))
        g = gram(both, name, size + 2)
        inside = g[:size, size:]
        square, axes = np.linalg.eigh(g[size:, size:] - inside.T @ inside)
        root = np.sqrt(np.where(square > 1e-12 * np.trace(g[size:, size:]), square, np.inf))
        return both, inside, axes / root

    both_u, m_in, p = extended(u, "u", a, "a")
    both_v, n_in, q = extended(v, "v", b, "b")
    # what stands outside the factors, in its own orthonormal axes: with root R of the rest's Gram, R = pinv(p)
    out_u, out_v = np.vstack([m_in, np.linalg.pinv(p)]), np.vstack([n_in, np.linalg.pinv(q)])
    left, values, right = np.linalg.svd(np.diag(np.concatenate([s, [0, 0]])) + out_u @ out_v.T)
    basis = lambda inside, axes: np.block([[np.eye(size), -inside @ axes], [np.zeros((2, size)), axes]])
    return times(both_u, "u", (basis(m_in, p) @ left)[:, :size]), values[:size], times(both_v, "v", (basis(n_in, q) @ right.T)[:, :size])


def simplex_weights(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9, rounds: int = 100_000) -> np.ndarray:
    """h of least |a h - b| for each row b, with h >= 0 and sum 1: accelerated projected gradients, row by row
    restarted, until the duality gap is at most ``tolerance`` times |b|^2 plus the largest |a_j|^2."""
    g, c = a.T @ a, b @ a
    k = len(g)
    step = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-300)
    enough = tolerance * ((b * b).sum(1) + g.diagonal().max())
    h = np.full((len(b), k), 1 / k)
    out, rest = h.copy(), np.arange(len(b))
    y, t = h.copy(), np.ones(len(b))
    for _ in range(rounds):
        slope = h @ g - c[rest]
        done = (slope * h).sum(1) - slope.min(1) <= enough[rest]
        out[rest[done]] = h[done]
        h, y, t, rest = h[~done], y[~done], t[~done], rest[~done]
        if not len(rest):
            return out
        new = on_simplex(y - step * (y @ g - c[rest]))
        back = ((y - new) * (new - h)).sum(1) > 0
        ahead = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * t * t)) / 2)
        y = np.where(back[:, None], new, new + ((t - 1) / ahead)[:, None] * (new - h))
        h, t = new, ahead
    raise ArithmeticError(f"no minimum within {tolerance} after {rounds} steps")


def on_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point with parts >= 0 and sum 1 of each row."""
    down = -np.sort(-x, axis=1)
    excess = (np.cumsum(down, axis=1) - 1) / np.arange(1, x.shape[1] + 1)
    last = (down > excess).sum(1) - 1
    return np.maximum(x - excess[np.arange(len(x)), last][:, None], 0)


def simplex_regression(points: DataFrame, a: np.ndarray, tolerance: float = 1e-9) -> DataFrame:
    """id, h of points (id, x): weights of the columns of ``a`` (length of x, k) that come nearest to x."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = simplex_weights(a, block(batch.column(1)), tolerance)
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1], dtype=np.int32)), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays], names=["id", "h"])

    whole = points.where("x IS NOT NULL AND forall(x, v -> v IS NOT NULL)")
    return whole.select("id", F.expr("transform(x, v -> cast(v as double))").alias("x")).mapInArrow(solve, f"id {dict(points.dtypes)['id']}, h array<double>")


def successive_projection(points: DataFrame, k: int) -> list[tuple]:
    """(id, squared residual) of ``k`` points (id, x), each the one with the largest part outside the span of those
    before (ties: the longest one, then the smallest id); fewer, if nothing is left outside."""
    points = points.select("id", F.expr("transform(x, v -> cast(v as double))").alias("x"))
    basis: list[np.ndarray] = []
    chosen: list[tuple] = []
    for _ in range(k):

        def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = block(batch.column(1))
                    size = (x * x).sum(1)
                    left = size - sum(((x @ u) ** 2 for u in basis), np.zeros(len(x)))  # noqa: B023
                    near = np.flatnonzero(left >= left.max() * (1 - 1e-12))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(near), pa.array(np.maximum(left[near], 0)), pa.array(size[near]), batch.column(1).take(near)], names=["id", "left", "size", "x"])

        found = points.mapInArrow(farthest, f"id {dict(points.dtypes)['id']}, left double, size double, x array<double>")
        best = found.orderBy(F.desc(F.round("left", 12)), F.desc("size"), "id").limit(1).collect()
        if not best or best[0]["left"] <= 1e-14 * best[0]["size"]:
            break
        u = np.array(best[0]["x"])
        for _ in range(2):
            for other in basis:
                u = u - (other @ u) * other
        basis.append(u / np.linalg.norm(u))
        chosen.append((best[0]["id"], best[0]["left"]))
    return chosen
