"""Clustering and product codes on integers against plain loops, with ties, duplicates and hostile rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import centroids, vector_codes


def fine(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def table(seed, n, dims, spread):
    """(id, vector, label): few distinct values make many exact ties; unusable rows between."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-spread, spread + 1, dims) / 256 + rng.choice([0, 0.001])], int(rng.integers(0, 3))) for i in rng.permutation(10 * n)[:n]]
    rows += [(rows[0][0], rows[1][1], 1), (rows[3][0], rows[3][1], None), (None, rows[2][1], None), (7_000_001, None, 1), (7_000_002, [float("nan")] * dims, 1),
             (7_000_003, [None] + [0.0] * (dims - 1), 0), (7_000_004, [0.0] * (dims - 1), 2), (7_000_005, [float("-inf")] + [0.0] * (dims - 1), 0), (7_000_006, [], 0)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "vector", "ints", "cluster", "was", "part", "entry", "code", "of", "h", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if fine(v, dims)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order + [r for r in kept if r[0] is None]][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], at


@pytest.mark.parametrize("seed,n,dims,spread,k", [(1, 300, 3, 6, 12), (2, 60, 64, 90, 40), (3, 9, 4, 2, 40), (4, 200, 2, 1, 6)])
def test_clusters(spark, seed, n, dims, spread, k):
    rows = table(seed, n, dims, spread)
    expected, at = plain_clusters(rows, k, 5, dims)
    got = centroids.cluster(frame(spark, rows), k=k, dims=dims).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(expected, key=key)
    whole = sum(d for _, _, d in expected)
    for r in got:
        assert r["inertia"] == whole and r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert list(r["centroid"]) == at[r["cluster"]]
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()


def test_bounds_spare_scans(spark):
    """Vectors in clear groups are scanned once or twice, not once a round."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16)) * 3
    rows = [(i, [float(x) for x in middle[i % 12] + rng.normal(size=16) * 0.05], 0) for i in range(600)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), k=12, dims=16).collect()
    assert len(got) == 600 and sum(r["n_scans"] for r in got) < 3 * 600  # of 6 passes


def test_bounds_never_decide_ties():
    """Assignments through bounds equal full scans while centroids wander on a small grid."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (500, 2))
    at = rng.integers(-3, 4, (8, 2))
    own, first, second = centroids.scan(x, at)
    upper, lower = centroids.at_most(first), centroids.at_least(second)
    for _ in range(30):
        before, at = at, at + rng.integers(-1, 2, at.shape) * (rng.random(len(at)) < 0.3)[:, None]
        own, upper, lower, _ = centroids.assign(x, own, upper, lower, centroids.Centroids.moved(at, before))
        assert (own == centroids.scan(x, at)[0]).all()


def test_empty_and_large_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.quantise(spark.createDataFrame([], schema))[0].collect() == []
    with pytest.raises(Exception, match="exceed 63 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0], 0)], schema), dims=2).collect()


def plain_codes(rows, parts, entries, rounds, dims):
    kept = sorted([(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if fine(v, dims)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dims // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), o in zip(kept, own) if o[p] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, y, bytes(near(v, p)[1] for p in range(parts)).hex(), sum(near(v, p)[0] for p in range(parts))) for i, v, y in kept]
    return out, books


@pytest.mark.parametrize("seed,n,dims,spread,parts,entries,most", [(1, 250, 8, 3, 4, 16, 100_000), (2, 90, 64, 120, 16, 64, 1), (3, 5, 6, 2, 3, 64, 100_000)])
def test_codes(spark, monkeypatch, seed, n, dims, spread, parts, entries, most):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", most)  # both ways to join the labels' sums
    rows = table(seed, n, dims, spread)
    expected, books = plain_codes(rows, parts, entries, 2, dims)
    coded, got_books = vector_codes.quantise(frame(spark, rows), parts=parts, entries=entries, dims=dims)
    got = coded.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, *r[2:])
    assert sorted([(r["vec_id"], r["label"], r["code"].hex(), r["error"]) for r in got], key=key) == sorted(expected, key=key)
    assert got_books.tolist() == books
    for r in got:
        assert r["label_error"] == sum(e for _, y, _, e in expected if y == r["label"])
    ints = vector_codes.decode([bytes(r["code"]) for r in got[:5]], got_books)
    assert ints.shape == (5, dims)


@pytest.mark.parametrize("size", [1, 50, 5_000, 1 << 26])
def test_screening_is_rigorous(size):
    """True values lie in the intervals of the float32 values, and the winner is the integers' winner, ties included."""
    rng = np.random.default_rng(size)
    x, book = rng.integers(-size, size + 1, (3000, 4)), rng.integers(-size, size + 1, (64, 4))
    book[40:] = book[:24]  # exact ties
    x[:500] = book[rng.integers(0, 64, 500)]
    x[500:900] = (book[rng.integers(0, 64, 400)] + book[rng.integers(0, 64, 400)]) // 2
    value, error = vector_codes.screen(x, book)
    true = np.array([[int(c @ c) - 2 * int(r @ c) for c in book.astype(object)] for r in x[:300].astype(object)])
    assert (np.abs(value[:300].astype(float) - true.astype(float)) <= error[:300, None]).all()
    best, d2, again = vector_codes.nearest(x, book)
    every = np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)
    assert (best == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all() and again
