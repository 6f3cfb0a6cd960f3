"""The quality classifier: held-out accuracy, descent against its optimum, and hostile rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidewell.llm import quality


def junk(rng, text):
    words = text.split() or ["a"]
    kind = rng.randrange(3)
    if kind == 0:
        return " | ".join(words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for x in words for w in [x] * rng.randint(4, 9))


def documents(seed, n):
    rng = random.Random(seed)
    pool = H.vocabulary(rng, 200)
    rows = []
    for i in range(n):
        text = ". ".join(" ".join(rng.choice(pool) for _ in range(rng.randint(4, 12))).capitalize() for _ in range(rng.randint(2, 8))) + "."
        rows.append((i, junk(rng, text) if i % 5 == 0 else text, int(i % 5 != 0)))
    return rows


def test_learns_and_generalises(spark):
    rows = documents(3, 500)
    docs, labels = H.frame(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y, "x") for i, _, y in rows if i % 2], "doc_id long, quality int, score string")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if not i % 2]
    assert sum((got[i] >= quality.THRESHOLD) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(7), quality.train(docs.repartition(5), labels)).collect()}
    assert max(abs(again[i] - got[i]) for i in got) < 1e-6


def test_descent_reaches_the_optimum():
    """No step along a coordinate of the dual improves, which for hinge losses is the optimum."""
    rng = np.random.default_rng(2)
    ratio, y = rng.normal(size=30), rng.integers(0, 2, 80)
    rows = [np.sort(rng.permutation(30)[: rng.integers(1, 12)]) for _ in y]
    w, bias = quality.descend(rows, y, ratio, cost=0.1)
    margin, sign = quality.margins(rows, ratio, w, bias), 2 * y - 1

    def loss(w, bias):
        cost = 0.1 * np.where(y == 1, 40 / (y == 1).sum(), 40 / (y == 0).sum())
        return 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - sign * quality.margins(rows, ratio, w, bias))).sum()

    best = loss(w, bias)
    assert np.isfinite(margin).all()
    for _ in range(200):
        assert loss(w + rng.normal(size=30) * 0.02, bias + rng.normal() * 0.02) >= best - 1e-2


def test_grams_of_a_row_stay_inside_it():
    offsets, data = np.array([0, 2, 2, 5, 6]), np.frombuffer(b"abcdez", np.uint8)
    found = [sorted({int(k) for keys, b, n in quality.grams(offsets, data)[:3] for k in keys[b[r] : max(b[r], b[r + 1] - n)]}) for r in range(4)]
    key = lambda s: quality._BYTES[len(s) - 1] + int.from_bytes(s, "big")
    assert found == [sorted(map(key, x)) for x in ([b"a", b"b", b"ab"], [], [b"c", b"d", b"e", b"cd", b"de", b"cde"], [b"z"])]
    shapes = quality.grams(np.array([0, 11]), np.frombuffer(b"Ab ab ab 1!", np.uint8))[3][0] - quality._SHAPES[0]
    assert shapes.tolist() == [3, 1, 1 | quality._AGAIN, 4 | 8 | quality._AT_END]


def test_edges(spark):
    schema = "doc_id long, quality int"
    docs = H.frame(spark, [(1, None), (2, ""), (3, "word " * 40_000), (None, "x"), (4, "a b"), (4, "a b"), (5, "ß" * 70_000)])
    for labels, expected in (([], 0.5), ([(4, 1)], 2 / 3), ([(4, 0), (5, 0)], 1 / 4), ([(None, 1), (4, None), (99, 1)], 0.5)):
        model = quality.train(docs, spark.createDataFrame(labels, schema))
        got = [r["score"] for r in quality.score(docs, model).collect()]
        assert len(got) == 7 and all(abs(s - expected) < 1e-9 for s in got)
    model = quality.train(docs, spark.createDataFrame([(4, 1), (4, 0), (3, 0)], schema))
    got = quality.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs.where(F.lit(False)), model).collect() == []


def test_lookup_equals_sorted_search():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, quality.KEYS, 5000))
    text = pa.array(["".join(chr(c) for c in rng.integers(32, 500, 300)), "", "zz zz !!"], pa.large_string())
    from tidewell.llm.textscan import chunks

    for _, _, offsets, data in chunks(text):
        known = np.unique(np.concatenate([known, *[keys[::3] for keys, _, _ in quality.grams(offsets, data)]]))
        finder = quality.Finder(known)
        for r, at in enumerate(finder.held(offsets, data)):
            own = np.unique(np.concatenate([k[b[r] : max(b[r], b[r + 1] - n)] for k, b, n in quality.grams(offsets, data)]))
            assert known[at].tolist() == np.intersect1d(own, known).tolist()
