"""Exact medians, hommel and levels of columns against plain Python."""

import numpy as np
import pytest

from cellweave.operators import bins, screening
from cellweave.operators import network as N


def test_medians(spark):
    r = np.random.default_rng(9)
    for x in (r.normal(size=301), r.integers(0, 5, 200).astype(float), np.array([4.0]), np.array([1.0, 9.0])):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert bins.median(rows, "x").first()["median"] == pytest.approx(np.median(x), abs=1e-12)


def test_hommel_by_its_closed_tests(spark):
    # Hommel rejects at level a what every intersection's Simes test rejects: the largest Simes p over all sets with i
    p = [0.001, 0.01, 0.02, 0.022, 0.09, 0.3, 0.3, 0.9]
    simes = {}
    for s in range(1, 1 << len(p)):
        own = sorted(p[i] for i in range(len(p)) if s >> i & 1)
        simes[s] = min(len(own) * v / j for j, v in enumerate(own, 1))
    want = [max(v for s, v in simes.items() if s >> i & 1) for i in range(len(p))]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(p)] + [("b", 0, 0.5)], "net string, i int, p double")
    got = {(r["net"], r["i"]): r["p_hommel"] for r in N.p_adjust(rows, "p", ["net"], ["i"], ["hommel"]).collect()}
    assert [got["a", i] for i in range(len(p))] == pytest.approx(want) and got["b", 0] == 0.5


def test_levels(spark):
    rows = spark.createDataFrame([(i, "ba"[i % 2] if i else None, 7) for i in range(60)], "i int, s string, one int")
    out, levels = screening.categorise(rows)
    assert levels == {"s": ["a", "b"], "one": [7]}
    assert {(r["i"], r["s"], r["one"]) for r in out.collect()} == {(i, None if not i else 1 + (i % 2 == 0), 1) for i in range(60)}
