"""Exact nearest neighbours by cells and angles against plain loops, and how much they spare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import nearest

ROW = "vec_id long, embedding array<double>"


def plain(rows, k):
    fine = [(i, np.array(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        near = sorted((-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 9), j) for j, w in fine if j != i)
        out[i] = [(j, rank + 1, -c) for rank, (c, j) in enumerate(near[:k])]
    return out


def clustered(n=900, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(30, 16))
    return [(i, [float(x) for x in middle[i % 30] + rng.normal(size=16) * 0.05]) for i in range(n)]


@pytest.mark.parametrize("k, centres, group", [(3, 40, 4096), (5, 8, 50), (1, 1, 4096)])
def test_equals_all_pairs(spark, monkeypatch, k, centres, group):
    monkeypatch.setattr(nearest, "GROUP", group)  # cells dealt over several groups
    rng = np.random.default_rng(3)
    rows = clustered(240) + [(1000 + i, [float(x) for x in rng.normal(size=16)]) for i in range(20)]
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [])]
    df = spark.createDataFrame(rows, ROW).withColumn("cell", F.lit("clash")).repartition(3)
    got = {}
    for r in nearest.top_k(df, None, k, centres=centres)[0].collect():
        got.setdefault(r["anchor"], []).append((r["id"], r["rank"], round(r["cosine"], 9)))
    expected = plain(rows, k)
    assert got.keys() == expected.keys()
    for i, near in expected.items():
        assert [(j, r) for j, r, _ in sorted(got[i], key=lambda x: x[1])] == [(j, r) for j, r, _ in near]


def test_some_anchors(spark):
    rows = clustered(120)
    df = spark.createDataFrame(rows, ROW)
    got = {(r["anchor"], r["id"]) for r in nearest.top_k(df, df.where("vec_id % 10 = 0"), 2)[0].collect()}
    expected = plain(rows, 2)
    assert got == {(i, j) for i in range(0, 120, 10) for j, _, _ in expected[i]}


def test_bounds_spare_pairs(spark):
    """On vectors that cluster, a small part of all pairs is compared."""
    rows = clustered()
    found, pairs = nearest.top_k(spark.createDataFrame(rows, ROW), None, 3, centres=120)
    assert found.count() == 2700 and pairs.first()["pairs"] < len(rows) ** 2 / 8


def test_nothing(spark):
    df = spark.createDataFrame([], ROW)
    assert nearest.top_k(df, None, 3)[0].collect() == []
    assert nearest.top_k(spark.createDataFrame([(1, [1.0, 0.0])], ROW), None, 3)[0].collect() == []


def test_anchors_go_to_bins_not_to_cells(spark, tmp_path):
    """Vectors that don't cluster: an anchor is sent once a bin, though it meets nearly every cell; many copies leave k rows an anchor."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)] + [(1000 + i, [1.0] * 16) for i in range(150)]
    found, pairs = nearest.top_k(spark.createDataFrame(rows, ROW), None, 3, centres=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["anchor"], []).append((r["id"], r["rank"]))
    expected = plain(rows, 3)
    assert {i: sorted(near, key=lambda x: x[1]) for i, near in got.items()} == {i: [(j, n) for j, n, _ in near] for i, near in expected.items()}
    assert pairs.first()["pairs"] > len(rows) ** 2 / 2 and "Generate" not in plan
    sent = []
    own = nearest._meet
    nearest._meet = lambda anchors, *more: sent.append(anchors.count()) or own(anchors, *more)
    try:
        nearest.top_k(spark.createDataFrame(rows, ROW), None, 3, centres=64)
    finally:
        nearest._meet = own
    assert sent[0] == len(rows) and len(rows) < sent[1] <= len(rows) * nearest.BINS
