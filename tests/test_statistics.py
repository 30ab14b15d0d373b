"""Statistics operators on small fixtures."""

import pytest

from cellweave.operators import statistics


def bins(spark, scores):
    return spark.createDataFrame([(i, 1.0 - i / 100, x) for i, x in enumerate(scores)], "bin long, mean_score double, bin_lls double")


@pytest.mark.parametrize(("scores", "want"), [
    ([3.0, 2.5, 2.0, -0.6], (2, 0.98)),
    ([3.0, 2.5, 0.2], (1, 0.99)),
    ([1.0, 0.5, -0.1, -0.2, 0.3], (1, 0.99)),
    ([0.5, -0.1, 0.2, -0.6], (2, 0.98)),
    ([1.0, 0.8, 0.6], None),
    ([], None),
])
def test_threshold(spark, scores, want):
    got = statistics.lls_threshold(bins(spark, scores)).collect()
    assert [(r["bin"], r["mean_score"]) for r in got] == ([] if want is None else [want])


def test_kaplan_meier_ends_at_zero(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False)]
    got = {(r["group"], r["time"]): r["survival"] for r in statistics.kaplan_meier(spark.createDataFrame(rows, "group string, time long, event boolean")).collect()}
    assert got[("a", 1)] == pytest.approx(2 / 3) and got[("a", 2)] == pytest.approx(2 / 3)
    assert got[("a", 3)] == 0 and got[("b", 1)] == 1


def test_overlap_of_equal_sets(spark):
    sets = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2)], "set_name string, gene long")
    terms = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "term_name string, gene long")
    got = statistics.overlap_enrichment(sets, terms, 4).collect()
    assert [(r["term_name"], r["shared"]) for r in got] == [("t", 2)]
    assert got[0]["log_p"] == pytest.approx(1.3862943611)
