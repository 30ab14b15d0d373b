"""The command line on files of two small networks."""

import pytest

from cellweave import __main__ as cli


@pytest.fixture()
def folder(spark, tmp_path):
    for name, pairs in (("Tcell_F", [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]), ("Tcell_O", [("a", "b"), ("b", "d")])):
        (tmp_path / f"{name}.csv").write_text("gene1,gene2,LLS,scinet_weight\n" + "".join(f"{x},{y},2.0,1.0\n" for x, y in pairs))
    (tmp_path / "meta.txt").write_text("type,status\n" + "Tcell,F\n" * 5 + "Tcell,O\n" * 5)
    return tmp_path


def test_network_stats_and_convert(spark, folder):
    cli.main(["network-stats", "--networks", str(folder), "--output", f"{folder}/stats"])
    got = {r["condition"]: (r["nodes"], r["edges"], r["components"]) for r in spark.read.option("header", True).csv(f"{folder}/stats").collect()}
    assert got == {"F": ("4", "4", "1"), "O": ("3", "2", "1")}
    cli.main(["convert", "--networks", str(folder), "--output", f"{folder}/nets"])
    assert spark.read.parquet(f"{folder}/nets").count() == 6


@pytest.mark.parametrize("method", ["degree", "betweenness", "closeness", "eigenvector"])
def test_find_hubs_takes_each_centrality(spark, folder, method):
    args = cli.parser().parse_args(["find-hubs", "--networks", str(folder), "--output", "x", "--threshold", "1", "--method", method])
    assert "q" in cli.run(spark, args).columns


def test_differences_are_tested(spark, folder, monkeypatch):
    args = cli.parser().parse_args(["diff-analysis", "--networks", str(folder), "--output", "x", "--metadata", f"{folder}/meta.txt", "--celltype-col", "type", "--condition-col", "status", "--control", "F", "--disease", "O", "--min-cells", "5"])
    found = cli.hubs.find_diff_hub
    monkeypatch.setattr(cli.hubs, "find_diff_hub", lambda *a, **k: found(*a, **{**k, "values": 200}))
    rows = cli.run(spark, args).collect()
    assert {r["gene"] for r in rows} <= set("abcd") and rows and all(0 < r["p"] <= 1 for r in rows)
