"""Counters inside a stream: verdicts, labels and gaps of every batch, observed while its rows pass; no second pass over the events.

``observed`` attaches the counts to a plan: they are sums that Spark's tasks keep beside the rows and report with the batch. ``Counters``
listens to a stream's progress and adds the batches up; ``counted`` does the same for one write of a batch.

An id counts once a verdict if the rows are distinct by (id, verdict) before they are observed, as ``told_apart`` makes them. A *gap* is a
batch whose oldest event is younger than the youngest of all before it by more than is allowed.
Edge cases: a batch without rows reports zeros and opens no gap; a verdict that isn't one of VERDICTS counts as 'other'.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.moderation import SECRETS

VERDICTS = ("accept", "invalid", "mismatched", "blocklist", "curated-nsfw", "outside", *[f"secret:{name}" for name, _ in SECRETS])
LABELS = ("author-cw", "explicit", "spam")
NAME = "verdicts"


def told_apart(events: DataFrame) -> DataFrame:
    """Judged events, each id once a verdict, broken copies each; in a stream the ids are kept as state."""
    return events.withColumn("__id", F.coalesce("id", F.xxhash64("json").cast("string"))).dropDuplicates(["__id", "verdict"]).drop("__id")


def _measures() -> list[Column]:
    known = [F.count_if(F.col("verdict") == v).alias(f"v{i}") for i, v in enumerate(VERDICTS)]
    posts = (F.col("verdict") == "accept") & (F.col("kind") == 1)
    labels = [F.count_if(posts & F.array_contains("labels", name)).alias(f"l{i}") for i, name in enumerate(LABELS)]
    return [F.count(F.lit(1)).alias("rows"), F.min("created_at").alias("oldest"), F.max("created_at").alias("youngest"), *known, *labels]


def _read(row: Row | dict) -> tuple[Counter, Counter, int | None, int | None]:
    row = row.asDict() if isinstance(row, Row) else row
    verdicts = Counter({v: row[f"v{i}"] for i, v in enumerate(VERDICTS) if row[f"v{i}"]})
    if other := row["rows"] - sum(verdicts.values()):
        verdicts["other"] = other
    return verdicts, Counter({name: row[f"l{i}"] for i, name in enumerate(LABELS) if row[f"l{i}"]}), row["oldest"], row["youngest"]


def observed(events: DataFrame, name: str = NAME) -> DataFrame:
    """A stream of judged events that reports its counts with each batch, under ``name``."""
    return events.observe(name, *_measures())


class Counters(StreamingQueryListener):
    """Adds up what ``observed`` streams of a session report: ``verdicts``, ``labels``, a record for each batch, and ``gaps`` (from, to)."""

    def __init__(self, allowed: int | None = None, name: str = NAME):
        self.allowed, self.name = allowed, name
        self.verdicts, self.labels, self.batches, self.gaps = Counter(), Counter(), [], []
        self.youngest: int | None = None
        self.over = threading.Event()

    def add(self, batch: int, row: Row | dict) -> None:
        verdicts, labels, oldest, youngest = _read(row)
        self.verdicts.update(verdicts)
        self.labels.update(labels)
        if oldest is not None:
            if self.allowed is not None and self.youngest is not None and oldest - self.youngest > self.allowed:
                self.gaps.append((self.youngest, oldest))
            self.youngest = youngest if self.youngest is None else max(self.youngest, youngest)
        self.batches.append({"batch": batch, "rows": sum(verdicts.values()), "verdicts": dict(verdicts), "labels": dict(labels)})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(event.progress.batchId, row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.over.set()


def run(stream: DataFrame, folder: str, allowed: int | None = None, seconds: float = 60.0) -> Counters:
    """Run a stream of judged events to its end, written under ``folder``/rows, and return its counters; their table is ``folder``/counts."""
    spark = stream.sparkSession
    counters = Counters(allowed)
    spark.streams.addListener(counters)
    try:
        writer = observed(stream).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/mark")
        writer.trigger(availableNow=True).start().awaitTermination()
        counters.over.wait(seconds)  # the listener hears of it a little later
    finally:
        spark.streams.removeListener(counters)
    rows = [(b["batch"], v, n) for b in counters.batches for v, n in b["verdicts"].items()]
    spark.createDataFrame(rows, "batch long, verdict string, n long").write.mode("append").parquet(f"{folder}/counts")  # some rows a batch
    return counters


def counted(events: DataFrame, write) -> tuple[Counter, Counter]:
    """(verdicts, labels) of judged events, observed while ``write(events)`` runs its one action."""
    told = Observation()
    write(events.observe(told, *_measures()))
    return _read(told.get)[:2]
