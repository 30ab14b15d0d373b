"""Small aggregates on fixtures with known answers."""

import math

import pytest

from cellweave.operators import aggregates


def test_welch_needs_enough_rows(spark):
    rows = [("f", "a", x) for x in (1.0, 2.0, 3.0)] + [("f", "b", x) for x in (4.0, 6.0, 8.0)] + [("g", "a", 1.0), ("g", "b", 2.0)]
    got = {(r["by"], r["label"]): r["t"] for r in aggregates.welch_t(spark.createDataFrame(rows, "by string, label string, value double"), "by", "label").collect()}
    assert got["f", "a"] == pytest.approx(-4 / math.sqrt(1 / 3 + 4 / 3)) and got["f", "b"] == -got["f", "a"] and got["g", "a"] == 0


def test_combined_log_p_and_entropy(spark):
    rows = spark.createDataFrame([("s", 3.0), ("s", 1.0), ("s", None), ("t", 2.0)], "k string, x double")
    got = {r["k"]: r["x"] for r in aggregates.combine_log_p(rows, ["k"], "x").collect()}
    assert got["s"] == pytest.approx(math.log((1000 + 10) / 2)) and got["t"] == pytest.approx(math.log(100))
    h = {r["k"]: r["entropy"] for r in aggregates.entropy(rows, ["k"], "x").collect()}
    assert h["s"] == pytest.approx(-0.75 * math.log(0.75) - 0.25 * math.log(0.25)) and h["t"] == pytest.approx(0)


def test_trimmed_mean_and_ranks(spark):
    rows = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate((100, 2, 3, -50))] + [("s", 9, None)], "k string, i long, x double")
    assert aggregates.trimmed_mean(rows, ["k"], "x").first()["x"] == 2.5
    got = aggregates.rank_matching(rows, rows, ["k"], "i", "x", 2.0, 99.0).collect()
    assert [(r["rank"], r["left_id"], r["right_id"]) for r in got] == [(1, 0, 0)]
