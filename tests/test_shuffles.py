"""Shuffles made in arrays against those made by tables: the same hashes, orders and results."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.functions.random import by_length, hashed_items
from cellweave.operators import nulls, profiles

EDGE = "celltype string, condition string, gene1 string, gene2 string, lls double"


@pytest.fixture(scope="module")
def net(spark):
    r = np.random.default_rng(7)
    rows = [(c, k, f"g{a}", f"g{b}", float(r.integers(1, 9)) / 7) for c in "xyé" for k in ("F", "O") for a in range(40) for b in range(a, 40) if r.random() < 0.08]
    rows += [("z", "F", "a", "a", 2.0), ("w", "F", "a", "b", 2.0), ("w", "F", "b", "c", 2.0), (None, "F", "a", "b", 1.0)]
    return spark.createDataFrame(rows, EDGE).cache()


def test_hashes_of_items_are_md5():
    items = ["", "7", "12345", "gène", "x" * 30, "y" * 60, "12", "a"]
    for prefix in (b"", b"1|A|F|", b"1|BUILDING|F|100|"):
        want = [int(hashlib.md5(prefix + i.encode() + b"|weight").hexdigest()[:8], 16) for i in items]
        assert hashed_items(prefix, by_length(pa.array(items)), b"|weight", len(items)).tolist() == want
    many = [str(i) for i in range(1, 20_001)]
    got = hashed_items(b"1|A|F|3|", by_length(pa.array(many)), b"", len(many))
    assert got[::1999].tolist() == [int(hashlib.md5(b"1|A|F|3|" + i.encode()).hexdigest()[:8], 16) for i in many[::1999]]


def both_ways_made(monkeypatch, made, tables: list):
    """Rows made in arrays, where ``tables`` are not called, and by tables."""
    with monkeypatch.context() as m:
        for module, name in tables:
            m.setattr(module, name, None)
        arrays = made().toPandas()
    monkeypatch.setattr(nulls, "WHOLE", 0)
    keys = [c for c in arrays.columns if arrays[c].dtype.kind not in "fi"]
    order = lambda t: t.sort_values(keys).reset_index(drop=True)
    return order(arrays), order(made().toPandas())


def same(a, b):
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        assert a[c].tolist() == (pytest.approx(b[c].tolist(), rel=1e-9, abs=1e-9, nan_ok=True) if a[c].dtype.kind == "f" else b[c].tolist())


def test_weight_hubs_in_arrays(spark, net, monkeypatch):
    # a row a shuffle and edge was hashed, sorted and summed
    whole = net.withColumn("lls", F.round(F.col("lls") * 7))  # whole weights: sums in any order are equal
    a, b = both_ways_made(monkeypatch, lambda: nulls.weight_hubs(whole, 23), [(nulls, "rewired")])
    same(a, b)
    assert len(a) and (a.p < 1).any()


def test_specificity_in_arrays(spark, net, monkeypatch):
    # as F6
    a, b = both_ways_made(monkeypatch, lambda: profiles.topological_specificity(net, 23), [(profiles, "rewired")])
    same(a, b)
    assert a.z.abs().max() > 0.5 and (a[a.celltype == "w"].z == 0).all()


def test_autocorrelation_in_arrays(spark, net, monkeypatch):
    # a row a shuffle and node was hashed and sorted, and a row a shuffle and edge summed
    scores = net.select("celltype", "condition", F.explode(F.array("gene1", "gene2")).alias("gene")).distinct().where("gene <> 'g7'")
    scores = scores.withColumn("x", F.when(F.col("gene") != "g9", F.xxhash64("gene", "celltype") % 13).cast("double"))
    a, b = both_ways_made(monkeypatch, lambda: nulls.autocorrelation_z(net, scores, 23), [(nulls, "shuffled")])
    same(a, b)
    assert len(a) >= 6 and a.z.notna().sum() >= 6


def test_label_autocorrelation_in_arrays(spark, net, monkeypatch):
    # (F8) as F5
    labels = net.select("celltype", "condition", F.explode(F.array("gene1", "gene2")).alias("gene")).distinct()
    labels = labels.withColumn("label", F.when(F.col("gene") != "g9", F.concat(F.lit("l"), F.abs(F.xxhash64("gene")) % 4)))
    a, b = both_ways_made(monkeypatch, lambda: profiles.label_autocorrelation(net, labels, 23), [(profiles, "shuffled")])
    same(a, b)
    assert a.z.notna().sum() >= 6


def test_null_weights_go_by_tables(spark, net):
    some = net.withColumn("lls", F.when(F.col("gene1") != "g3", F.col("lls")))
    assert nulls.blocks_for(some, 10) is None and nulls.blocks_for(net, 10) == 2 and nulls.blocks_for(net.limit(0), 10) is None
    assert nulls.weight_hubs(some, 3).count() > 0 and profiles.topological_specificity(net.limit(0)).count() == 0
