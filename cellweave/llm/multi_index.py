"""Operator 7: nearest neighbours by an inverted multi-index.

Vectors are normalised and cut into halves; each half is quantised by a codebook of ``centroids``
k-means centroids, fitted on a sample of ``fit_rows`` rows (the smallest hashes of the ids).  Their
number, unless given, grows with the square root of the entries, so cells stay alike in size, up to a
sixteenth of the sample.  An
entry lies in the cell of its two centroids.  A query visits cells in order of the summed distance
of its halves, by a heap over the two sorted lists, until the cells visited hold ``reach`` entries;
all entries of those cells are reranked by exact cosine in double precision.

``reach`` is measured, not guessed: for ``probe_rows`` sampled vectors the true neighbours are
found by brute force, and reach is the ``recall`` quantile of how many entries the traversal
passes until it gets to their cells.

Plan: one map assigns cells; queries and entries meet per block, (first centroid, part of its
entries, part of the queries that visit it), so a centroid with a third of all entries is many blocks,
and entries are copied as often as 4,096 queries come to their centroid, never to those that pass
it by; each block returns the best k per query and a last aggregation merges them.  To the driver come
the fit and probe samples, the number of entries per cell and of visits per centroid, all bounded by
parameters.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; rows with the query's own vec_id are not its candidates; rows
that repeat a vec_id are candidates of their own, and of their vectors the least is the query; ties
go to the smaller vec_id; with no more than ``reach`` entries the search is exact; further columns of
the input, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, input_rows, materialize

ENTRIES = "vec_id long, c1 int, c2 int, embedding array<double>"
FOUND = "query_id long, vec_id long, score double"


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = input_rows(embeddings, id_col, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good).where(F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("embedding") == (size["dim"] if size else 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def codebook(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centroids of a sample."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first centroid, second, entries passed so far) by growing d1 + d2: the multi-sequence walk."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, done, passed = [(s1[0] + s2[0], 0, 0)], [0] * len(o1), 0
    while heap:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        passed += int(counts[o1[i], o2[j]])
        yield o1[i], o2[j], passed
        if i + 1 < len(o1) and done[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < len(o2) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))


def cosines(query: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact measure, summed row by row so that equal vectors score equally; powers of two keep squares of very
    large and very small parts in range and change no other bit."""
    query, entries = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0.0))[1]) for x in (query, entries))
    return (entries * query).sum(axis=1) / (np.sqrt((entries * entries).sum(axis=1)) * np.sqrt((query * query).sum()))


def best_of(query_id: int, query: np.ndarray, rough: np.ndarray, ids: np.ndarray, entries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of entries whose rough score may be among them (-inf: no candidate)."""
    able = np.flatnonzero(np.isfinite(rough))
    if len(able) > k:
        able = able[rough[able] >= np.partition(rough[able], -k)[-k] - 1e-9]
    score = cosines(query, entries[able])
    order = np.lexsort((ids[able], -score))[:k]
    return [(query_id, int(ids[able[i]]), float(score[i])) for i in order]


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


class MultiIndex:
    def __init__(self, embeddings: DataFrame, centroids: int | None = None, fit_rows: int = 20_000, probe_rows: int = 200, recall: float = 0.97, k: int = 5, block: int = 4096, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.k, self.block = k, block
        rows = usable(embeddings, id_col, vec_col)
        sample = rows.orderBy(digest("vec_id", F.lit(seed)), "vec_id").limit(fit_rows).select("embedding").toPandas()
        self.books = None
        if not len(sample):
            self.entries, self.reach = rows.select("vec_id", F.lit(0).alias("c1"), F.lit(0).alias("c2"), "embedding"), 0
            return
        x = unit(np.stack(sample["embedding"].to_numpy()))
        h = (x.shape[1] + 1) // 2
        centroids = centroids or max(2, min(fit_rows // 16, round(rows.count() ** 0.5 / 4)))
        self.half, self.books = h, tuple(codebook(y, centroids, 12, seed) for y in (x[:, :h], x[:, h:]))
        self.entries = materialize(self.assign(rows), "multi_index")
        self.counts = np.zeros(tuple(map(len, self.books)), np.int64)
        for r in self.entries.groupBy("c1", "c2").count().collect():  # centroids squared at most
            self.counts[r["c1"], r["c2"]] = r["count"]
        self.reach = self.measure(probe_rows, recall, seed)

    def assign(self, rows: DataFrame) -> DataFrame:
        h, books = self.half, self.books

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1))
                if len(x):
                    x = unit(x)
                    c = [pa.array(distances(y, book).argmin(1).astype(np.int32)) for y, book in zip((x[:, :h], x[:, h:]), books, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), *c, b.column(1)], names=["vec_id", "c1", "c2", "embedding"])

        return rows.mapInArrow(cells, ENTRIES)

    def measure(self, probe_rows: int, recall: float, seed: int) -> int:
        """How many entries a traversal must pass, from true neighbours of sampled vectors."""
        k, n = self.k, int(self.counts.sum())
        probe = self.entries.orderBy(digest("vec_id", F.lit(seed + 1)), "vec_id").limit(probe_rows).toPandas()
        ids, q = probe["vec_id"].to_numpy(), np.stack(probe["embedding"].to_numpy())

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, x = b.column(0).to_numpy(), matrix(b.column(3))
                if len(x):
                    rough = unit(q) @ unit(x).T
                    rough[ids[:, None] == own[None, :]] = -np.inf
                    at = {int(v): i for i, v in enumerate(own)}
                    found = [(*r, at[r[1]]) for i in range(len(q)) for r in best_of(i, q[i], rough[i], own, x, k)]
                    c1, c2 = b.column(1).to_numpy(), b.column(2).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([c1[f[3]] for f in found], pa.int32()), pa.array([c2[f[3]] for f in found], pa.int32())], names=["query_id", "vec_id", "score", "c1", "c2"])

        near = top_k(self.entries.mapInArrow(brute, FOUND + ", c1 int, c2 int"), k).collect()  # probe_rows x k
        needs, x = [], unit(q)
        d = [distances(y, book) for y, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in near:
            wanted.setdefault(r["query_id"], []).append((r["c1"], r["c2"]))
        for i, cells in wanted.items():
            left = list(cells)
            for c1, c2, passed in traverse(d[0][i], d[1][i], self.counts):
                needs += [passed] * left.count((c1, c2))
                left = [c for c in left if c != (c1, c2)]
                if not left:
                    break
        return min(n, int(np.quantile(needs, recall)) + 1) if needs else n

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score.  ``queries``: rows of ``entries``."""
        if self.books is None:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        h, books, counts, reach, k, block = self.half, self.books, self.counts, self.reach, self.k, self.block
        parts = np.maximum(1, -(-counts.sum(1) // block))  # of the entries of a first centroid

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1))
                if not len(x):
                    continue
                u = unit(x)
                d = [distances(y, book) for y, book in zip((u[:, :h], u[:, h:]), books, strict=True)]
                out: list[tuple] = []
                for i, query in enumerate(b.column(0).to_pylist()):
                    cells: dict[int, list[int]] = {}
                    for c1, c2, passed in traverse(d[0][i], d[1][i], counts):
                        if counts[c1, c2]:
                            cells.setdefault(c1, []).append(c2)
                        if passed >= reach:
                            break
                    for c1, seconds in cells.items():
                        out.append((query, c1, seconds, i))
                    if len(out) >= 5000:
                        yield written(out, b)
                        out = []
                if out:
                    yield written(out, b)

        def written(out: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays([*columns, b.column(1).take(pa.array([o[3] for o in out]))], names=["query_id", "c1", "seconds", "vector"])

        visits = queries.select("vec_id", "embedding").mapInArrow(visit, "query_id long, c1 int, seconds array<int>, vector array<double>")
        visits = materialize(visits, "visits")
        groups = np.zeros(len(parts), np.int64)  # of the queries that visit a first centroid
        for r in visits.groupBy("c1").count().collect():
            groups[r["c1"]] = -(-r["count"] // block)
        of = lambda n: F.element_at(F.array(*[F.lit(int(x)) for x in n]), F.col("c1") + 1)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        probes = visits.withColumn("grp", F.pmod(digest("query_id", F.lit(4)), of(groups)).cast("int")).withColumn("part", numbers(of(parts).cast("int")))
        dealt = self.entries.where(of(groups) > 0).withColumn("part", F.pmod(digest("vec_id", F.lit(3)), of(parts)).cast("int")).withColumn("grp", numbers(of(groups).cast("int")))

        def meet(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[int, int, float]] = []
            if len(q) and len(e):
                x, ids, second = np.stack(e["embedding"].to_numpy()), e["vec_id"].to_numpy(), e["c2"].to_numpy()
                u = unit(x)
                for at in range(0, len(q), 256):
                    some = q.iloc[at : at + 256]
                    v = np.stack(some["vector"].to_numpy())
                    rough = unit(v) @ u.T
                    for i, (query, seconds) in enumerate(zip(some["query_id"], some["seconds"], strict=True)):
                        rough[i][~np.isin(second, seconds) | (ids == query)] = -np.inf
                        found += best_of(query, v[i], rough[i], ids, x, k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        keys = ["c1", "part", "grp"]
        return top_k(probes.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(meet, FOUND), k).select("query_id", "rank", "vec_id", "score")


def top_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_every(embeddings: DataFrame, step: int = 50, **options) -> DataFrame:
    """Rows whose vec_id is divisible by ``step`` as queries against all rows."""
    index = MultiIndex(embeddings, **options)
    return index.search(index.entries.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
