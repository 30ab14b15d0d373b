"""Draws of sets in tasks: the hash of Spark, one-by-one draws, and time that does not grow with the square of a set."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from cellweave.functions.random import hashed, hashed_rows
from cellweave.operators import profiles
from cellweave.operators.nulls import drawn_positions


def one_by_one(low, pool, row):
    taken = []
    for first, size, h in zip(low.tolist(), pool.tolist(), row.tolist(), strict=True):
        inside = sorted(x for x in taken if first <= x < first + size)
        if len(inside) == size:
            break
        at = first + int(h / 4294967296.0 * (size - len(inside)))
        for x in inside:
            at += x <= at
        taken.append(at)
    return taken + [-1] * (len(low) - len(taken))


def test_draws_are_those_made_one_by_one():
    rng = np.random.default_rng(1)
    for n, slots in [(5, 4), (70, 60), (40, 60), (5000, 300)]:
        low, pool = rng.integers(3, n + 3, slots), rng.integers(1, n, slots)
        if n == 40:  # more slots than places
            low[:], pool[:] = 3, n
        hashes = rng.integers(0, 2**32, (9, slots)).astype(np.uint32)
        assert drawn_positions(low, pool, hashes).tolist() == [one_by_one(low, pool, row) for row in hashes]


def test_hashes_are_those_of_spark(spark):
    keys = ["1|A|F|7", "1|B|F|12", "1|C|", "x" * 52]
    n = 1234
    got = hashed_rows([k.encode() for k in keys], n)
    assert got[:, [0, 8, 9, 98, 999, 1233]].tolist() == [[int(hashlib.md5(f"{k}|{i}".encode()).hexdigest()[:8], 16) for i in (1, 9, 10, 99, 1000, 1234)] for k in keys]
    (r,) = spark.range(1).select(hashed(F.lit(1), F.lit("B"), F.lit("F"), F.lit(12), F.lit(77)).alias("h")).collect()
    assert got[1, 76] == r.h


def test_large_sets_are_drawn_in_time():
    n = 20_000  # the square of which, times 500, one-by-one draws would look at
    start = time.monotonic()
    out = drawn_positions(np.zeros(n, np.int64), np.full(n, 10 * n), hashed_rows([b"1|%d" % i for i in range(500)], n))
    assert time.monotonic() - start < 90
    assert all(len(set(row)) == n for row in out.tolist()[:5]) and out.min() >= 0 and out.max() < 10 * n


def test_markers_of_many_labels_and_panels(spark):
    # more labels than a task draws at a time, and values that come to it apart from them
    rng = np.random.default_rng(2)
    x = {c: {int(g): float(v) for g, v in zip(rng.choice(200, 150, False), rng.integers(0, 9, 150), strict=True)} for c in "ab"}
    marked = [(f"l{k}", g, 1 if g % 2 else -1) for k in range(7) for g in range(k, 200, 5 + k)]
    scores = spark.createDataFrame([(c, g, v) for c in x for g, v in x[c].items()], "c string, gene long, x double")
    got = profiles.annotate_by_markers(scores, spark.createDataFrame(marked, "label string, gene long, sign int"), ["c"], reps=30).collect()
    assert len(got) == 14
    for r in got:
        genes, own = sorted(x[r.c]), sorted((g, s) for k, g, s in marked if k == r.label and g in x[r.c])
        hashes = hashed_rows([f"1|{r.label}|{rep}".encode() for rep in range(1, 31)], len(own))
        null = [sum(s * x[r.c][genes[at]] for (_, s), at in zip(own, one_by_one(np.zeros(len(own), int), np.full(len(own), len(genes)), row), strict=True)) for row in hashes]
        score = sum(s * x[r.c][g] for g, s in own)
        assert r.score == score and abs(r.z - (score - np.mean(null)) / np.std(null, ddof=1)) < 1e-9
