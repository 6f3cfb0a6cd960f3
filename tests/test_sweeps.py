"""Sliding distinct counts, many filters, and set reconciliation against plain loops."""

import random

from pyspark.sql import functions as F

from tidewell.operators import moderation, reconcile, sweeps

DAY = 86400


def test_distinct_before(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["g", "h", "hot", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *[rng.randrange(5 * DAY) for _ in range(9)], 7 * DAY, 8 * DAY, -DAY])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, m string, t long").repartition(3)
    for span in (DAY, 100, 0):
        got = {r["k"]: r["n_distinct"] for r in sweeps.distinct_before(df.withColumnsRenamed({"g": "grp", "m": "who", "t": "at"}), "grp", "who", "at", span).collect()}
        for k, g, m, t in rows:
            known = None if g is None or t is None else len({b for _, a, b, s in rows if a == g and b is not None and s is not None and t - span <= s <= t})
            assert got[k] == known or (m is None and got[k] in (known, None)), (k, g, m, t, span)
    assert sweeps.distinct_before(df.where("false"), "g", "m", "t").collect() == []


def test_both_ends_count(spark):
    rows = [("x", "a", 0), ("y", "b", DAY), ("z", "b", DAY + 1), ("w", "a", 3 * DAY)]
    df = spark.createDataFrame([(k, "g", m, t) for k, m, t in rows], "k string, g string, m string, t long")
    assert {r["k"]: r["n_distinct"] for r in sweeps.distinct_before(df, "g", "m", "t").collect()} == {"x": 1, "y": 2, "z": 1, "w": 1}


FILTER = "filter long, ids array<string>, authors array<string>, kinds array<long>, since long, until long"


def filters_of(rng, n):
    pick = lambda values: rng.choice([None, None, [], rng.sample(values, 1), rng.sample(values, 2) + values[:1]])
    return [(k, pick([f"e{i}" for i in range(60)]), pick([f"u{i}" for i in range(6)]), pick([0, 1, 3]), rng.choice([None, 40]), rng.choice([None, 70])) for k in range(n)]


def test_many_filters_equal_one_by_one(spark):
    rng = random.Random(2)
    events = spark.createDataFrame([(f"e{i}", f"u{i % 6}", i % 4, i) for i in range(100)], "id string, pubkey string, kind long, created_at long")
    rows = filters_of(rng, 80)
    got = {(r["id"], r["filter"]) for r in sweeps.matching(events, spark.createDataFrame(rows, FILTER)).collect()}
    expected = set()
    for n, *f in rows:
        named = {k: v for k, v in zip(("ids", "authors", "kinds", "since", "until"), f) if v is not None}
        expected |= {(r["id"], n) for r in events.where(moderation.matches_filters([named])).collect()}
    assert got == expected and len(got) > 300
    assert {r["id"] for r in sweeps.taken(events, spark.createDataFrame(rows, FILTER)).collect()} == {i for i, _ in expected}


def test_plan_of_many_filters_is_constant(spark):
    """Ten filters and a hundred thousand make the same plan, but for numbers."""
    events = spark.createDataFrame([("e", "u", 1, 5)], "id string, pubkey string, kind long, created_at long")
    many = lambda n: spark.range(n).select(F.col("id").alias("filter"), F.array(F.concat(F.lit("e"), F.col("id"))).alias("ids"), F.array(F.lit("u")).alias("authors"), F.lit(None).cast("array<long>").alias("kinds"), F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    size = lambda n: len(sweeps.matching(events, many(n))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(100_000) - size(10)) < 200
    assert sweeps.matching(events.withColumn("id", F.lit("e77777")), many(100_000)).count() == 1


def test_reconcile(spark):
    rng = random.Random(3)
    mine = [(f"i{k}", rng.randrange(4 * DAY)) for k in range(3000)] + [("late", None), (None, 5), ("twice", 1), ("twice", 2)]
    other = [r for r in mine if r not in mine[:3]] + [("new", 7), ("twice", 1), (mine[9][0], -5)]
    other.remove(mine[9])
    other.remove(("late", None))
    df = lambda rows: spark.createDataFrame(rows, "id string, created_at long").repartition(3)
    rows, counts = reconcile.difference(df(mine), df(other))
    a, b = {r for r in mine if r[0] is not None}, {r for r in other if r[0] is not None}
    assert {tuple(r) for r in rows.collect()} == {(*r, "mine") for r in a - b} | {(*r, "other") for r in b - a}
    assert len(counts) == 1 + reconcile.LEVELS and counts[-1] <= 7 and counts[0] <= 6  # ranges that differ, from days to the deepest
    same, counts = reconcile.difference(df(mine), df(list(reversed(mine)) + mine[:50]))
    assert same.collect() == [] and counts == [0]
    empty, counts = reconcile.difference(df(mine).where("false"), df(mine).where("false"))
    assert empty.collect() == [] and counts == [0]


def test_stored_fingerprints_spare_the_rows(spark):
    """With kept fingerprints a comparison takes in only the rows of ranges that differ."""
    rows = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("id"), (F.col("id") * 7).alias("created_at"))
    prints = [[f.cache() for f in reconcile.fingerprints(side)] for side in (rows, rows.where("id <> 'e77'"))]
    ranges, counts = reconcile.differing(*prints)
    deep = reconcile.keyed(rows, "id", "created_at").withColumn("cell", reconcile._cell(reconcile.LEVELS))
    assert counts == [1] * (1 + reconcile.LEVELS) and deep.join(ranges, ["day", "cell"], "left_semi").count() < 20
    found, _ = reconcile.difference(rows, rows.where("id <> 'e77'"), stored=tuple(prints))
    assert [tuple(r) for r in found.collect()] == [("e77", 539, "mine")]
