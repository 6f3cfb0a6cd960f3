"""First sightings beyond a watermark, and counters inside a stream."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import commits
from tidewell.streaming import counters, ingest, seen

DAY = 86400
ROW = "id string, at long, v long"


def test_first_sightings(spark, tmp_path):
    """What comes again after weeks is dropped; only days that a filter lets through are read."""
    folder, df = str(tmp_path / "s"), lambda rows: spark.createDataFrame(rows, ROW)
    one = [(f"e{k}", k * DAY // 10, k) for k in range(400)]
    first = seen.first_sightings(spark, df([*one, one[3], (None, 5, 0), ("untimed", None, 1)]), folder, "id", "at")
    assert {r["id"] for r in first.collect()} == {i for i, _, _ in one} | {"untimed"}
    store = seen.Seen.stored(spark, folder)
    assert set(store.days()) == {*range(40), seen.NO_DAY}
    two = df([("new", 3 * DAY, 0), one[7], one[350], ("e5", 39 * DAY, 0), ("untimed", None, 2)])  # e5 on another day is another event
    fresh, maybe = store.fresh(two, "id", "at")
    assert {(r["id"], r["day"]) for r in fresh.collect()} == {("new", 3), ("e5", 39)}
    assert {r["id"] for r in maybe.collect()} >= {"e7", "e350", "untimed"} and maybe.count() <= 4
    assert {r["id"] for r in seen.first_sightings(spark, two, folder, "id", "at").collect()} == {"new", "e5"}
    assert seen.first_sightings(spark, two, folder, "id", "at").collect() == []  # replayed
    before, last = store.base, commits.snapshot(spark, folder)
    assert before.parts("ids").items() <= last.parts("ids").items()  # nothing is written again
    seen.Seen(last).forget(30 * DAY)
    kept = seen.Seen.stored(spark, folder)
    assert set(kept.days()) == {*range(30, 40), seen.NO_DAY}
    assert kept.fresh(df([one[7]]), "id", "at")[0].count() == 1


def test_filters_let_little_through(spark, tmp_path):
    folder, at = str(tmp_path / "s"), F.lit(5).cast("long").alias("at")
    seen.first_sightings(spark, spark.range(20_000).select(F.concat(F.lit("a"), "id").alias("id"), at), folder, "id", "at")
    others = spark.range(20_000).select(F.concat(F.lit("b"), "id").alias("id"), at)
    fresh, maybe = seen.Seen.stored(spark, folder).fresh(others, "id", "at")
    assert fresh.count() == 20_000 and maybe.count() < 400  # about one in two hundred


JUDGED = "id string, json string, verdict string, labels array<string>, kind long, created_at long"


@pytest.fixture
def batches(spark, tmp_path):
    rows = [
        [("a", "1", "accept", ["spam"], 1, 100), ("a", "1", "accept", ["spam"], 1, 100), ("b", "2", "invalid", [], 1, 120), (None, "3", "invalid", [], 1, 110)],
        [("a", "1", "accept", ["spam"], 1, 100), ("c", "4", "accept", ["spam", "explicit"], 1, 130), ("d", "5", "accept", ["spam"], 0, 140), (None, "6", "invalid", [], 1, 110)],
        [("e", "7", "secret:aws access key", [], 1, 900), ("f", "8", "some new rule", [], 1, 901)],
    ]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, JUDGED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), [r for b in rows for r in b]


def test_counts_inside_a_stream(spark, batches, tmp_path):
    folder, rows = batches
    whole = spark.createDataFrame(rows, JUDGED)
    expected = {r["verdict"]: r["n"] for r in ingest.report(whole).collect()}
    schema = spark.createDataFrame([], JUDGED).schema
    found = counters.run(counters.told_apart(ingest.files_of(spark, folder, schema, 1)), str(tmp_path / "out"))
    assert {**found.verdicts, "some new rule": found.verdicts["other"]} == {**expected, "other": 1}
    assert found.labels == {r["label"]: r["n"] for r in ingest.label_report(whole).collect()}
    assert sum(b["rows"] for b in found.batches) == sum(expected.values()) and len(found.batches) >= 3
    assert {r["verdict"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out" / "counts")).groupBy("verdict").agg(F.sum("n").alias("n")).collect()} == found.verdicts


def test_counts_beside_a_write(spark, batches):
    whole = counters.told_apart(spark.createDataFrame(batches[1], JUDGED))
    verdicts, labels = counters.counted(whole, lambda rows: rows.write.format("noop").mode("overwrite").save())
    assert verdicts == {"accept": 3, "invalid": 3, "secret:aws access key": 1, "other": 1} and labels == {"spam": 2, "explicit": 1}


def test_gaps():
    told = lambda low, high: {"rows": 0, "oldest": low, "youngest": high} | {f"v{i}": 0 for i in range(len(counters.VERDICTS))} | {f"l{i}": 0 for i in range(len(counters.LABELS))}
    found = counters.Counters(allowed=60)
    for n, (low, high) in enumerate([(0, 100), (50, 160), (None, None), (221, 300), (200, 250), (360, 361)]):
        found.add(n, told(low, high))
    assert found.gaps == [(160, 221)] and found.youngest == 361
