"""Keyed streaming state: what wins, what a batch writes, edges that differ, and timers."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import ingest, keyed

ROW = "k string, at timestamp, id string, v long"
LIST = "k string, at timestamp, id string, members array<string>"
A, B, C = ("ab" * 32, "cd" * 32, "ef" * 32)


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes a batch of rows, runs the stream over what is new, and returns all changes so far."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a stream keeps the number that it began with
    yield lambda rows, schema, plan: (
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")),
        keyed.run(plan(ingest.files_of(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)), str(tmp_path / "s")),
    )[1]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_latest(feed):
    plan = lambda s: keyed.latest_changes(s, ["k"], "at", "id")
    log = feed([("a", at(5), "f", 1), ("a", at(5), "e", 2), ("b", at(1), "x", 3), (None, at(1), "x", 4), ("c", None, "x", 5)], ROW, plan)
    assert {(r["k"], r["v"], r["change"]) for r in log.collect()} == {("a", 2, 1), ("b", 3, 1)}
    log = feed([("a", at(5), "f", 1), ("a", at(4), "a", 9), ("b", at(1), "w", 7)], ROW, plan)
    assert {(r["k"], r["v"], r["change"]) for r in log.collect()} == {("a", 2, 1), ("b", 3, 1), ("b", 7, 2)}
    assert {(r["k"], r["v"]) for r in keyed.present(log, ["k"], "at").collect()} == {("a", 2), ("b", 7)}


def test_a_batch_of_one_writes_one_key(feed, tmp_path):
    """The second batch emits one row and one state change, whatever the first one has stored."""
    plan = lambda s: keyed.latest_changes(s, ["k"], "at", "id")
    feed([(f"k{n}", at(0), "x", n) for n in range(300)], ROW, plan)
    told = set(glob.glob(str(tmp_path / "s" / "log" / "*.parquet")))
    log = feed([("k7", at(9), "x", -7)], ROW, plan)
    fresh = set(glob.glob(str(tmp_path / "s" / "log" / "*.parquet"))) - told
    assert log.sparkSession.read.parquet(*fresh).count() == 1 and log.count() == 301
    delta = [open(p, "rb").read() for p in glob.glob(str(tmp_path / "s" / "mark" / "state" / "0" / "*" / "**" / "*.changelog"), recursive=True)]
    assert not delta or sum(map(len, delta)) < 20_000  # where change logs are kept
    assert {r["v"] for r in keyed.present(log, ["k"], "at").where("k in ('k7', 'k8')").collect()} == {-7, 8}


def test_edges(feed):
    plan = lambda s: keyed.edge_changes(s, "k", "at", "id", "members")
    log = feed([("a", at(1), "x", [A, B, A, "bad", None]), ("b", at(1), "x", [A])], LIST, plan)
    assert {(r["follower"], r["followee"]) for r in keyed.present(log, ["follower", "followee"]).collect()} == {("a", A), ("a", B), ("b", A)}
    log = feed([("a", at(2), "x", [B, C]), ("a", at(0), "x", [A]), ("b", at(1), "y", [C])], LIST, plan)  # one wins, one is late, one loses its tie
    assert {(r["follower"], r["followee"], r["op"]) for r in log.where("change = 2").collect()} == {("a", A, "gone"), ("a", C, "put")}  # B isn't touched
    log = feed([("a", at(3), "x", []), ("b", at(4), "z", None)], LIST, plan)
    assert keyed.present(log, ["follower", "followee"]).collect() == []
    log = feed([("b", at(5), "z", [A])], LIST, plan)
    assert {(r["follower"], r["followee"]) for r in keyed.present(log, ["follower", "followee"]).collect()} == {("b", A)}


def test_timers(feed):
    """Keys leave when the watermark passes their time and the horizon; a newer row postpones it; rows that are too old never enter."""
    plan = lambda s: keyed.latest_changes(s, ["k"], "at", "id", horizon_ms=60_000)
    feed([("a", at(0), "x", 1), ("b", at(0), "x", 2), ("c", at(50), "x", 3)], ROW, plan)
    log = feed([("b", at(55), "y", 4)], ROW, plan)
    assert {r["k"] for r in keyed.present(log, ["k"], "at").collect()} == {"a", "b", "c"}
    log = feed([("d", at(111), "x", 5)], ROW, plan)  # the watermark passes 60 and 110
    assert {r["k"] for r in keyed.present(log, ["k"], "at").collect()} == {"b", "d"}
    log = feed([("a", at(115), "z", 6), ("e", at(40), "z", 7)], ROW, plan)
    assert {(r["k"], r["v"]) for r in keyed.present(log, ["k"], "at").collect()} == {("d", 5), ("a", 6)}
    assert [(r["op"], r["change"]) for r in log.where(F.col("k") == "b").orderBy("change").collect()] == [("put", 1), ("put", 2), ("gone", 3)]
