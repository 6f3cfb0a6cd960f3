"""Keyed state inside a stream: latest-wins rows, follow lists and their edges, and retention by event-time timers.

The state of a key lives in the stream's state store (RocksDB), not in a table that every batch rewrites: a batch reads and
writes the keys of its own rows, and emits only what changed for them. What is emitted is a log of changes, numbered per key as long as it is there;
``present`` folds it into the rows that are there now, and ``commits`` can keep its result.

Replays are harmless: rows that don't win change nothing and emit nothing, and the file sink takes a batch once.
Edge cases: rows whose time or key is null are skipped; of equal times the smallest tie wins; a list that is empty or has no
well-formed member removes all edges; a key that a timer has removed begins anew with its next row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PUT, GONE = "put", "gone"
MICROS = "__micros"
#: Rows that are compared in a task before they go to their keys.
AT_ONCE = 500_000
MEMBER = re.compile(r"[0-9a-f]{64}")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, while a stream starts and runs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def newer(time, tie, than) -> bool:
    return than is None or time > than[0] or (time == than[0] and tie < than[1])


class Latest(StatefulProcessor):
    """Keeps each key's winning row; emits (row, change, op) when another wins, and when its time is up. Times are microseconds."""

    def __init__(self, schema: T.StructType, tie: str, horizon: int | None):
        self.schema, self.time, self.tie, self.horizon = schema, MICROS, tie, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([*self.schema.fields, T.StructField("change", T.LongType())]))

    def told(self, values: Sequence, change: int, op: str) -> Row:
        return Row(**dict(zip(self.schema.fieldNames(), values)), change=change, op=op)

    def until(self, time: int) -> int:
        return time // 1000 + self.horizon

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = None
        for row in rows:
            if row[self.time] is not None and newer(row[self.time], row[self.tie], best and (best[self.time], best[self.tie])):
                best = row
        if best is None:
            return
        old = self.held.get()
        if old is not None:
            old = dict(zip([*self.schema.fieldNames(), "change"], old))
            if not newer(best[self.time], best[self.tie], (old[self.time], old[self.tie])):
                return
        if self.horizon is not None:
            now = timerValues.getCurrentWatermarkInMs()
            if self.until(best[self.time]) <= now:
                return  # too old to be kept
            if old is not None:
                self.handle.deleteTimer(self.until(old[self.time]))
            self.handle.registerTimer(self.until(best[self.time]))
        change = 1 + (old["change"] if old else 0)
        values = tuple(best[c] for c in self.schema.fieldNames())
        self.held.update((*values, change))
        yield self.told(values, change, PUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.held.get()
        if old is not None:
            *values, change = old
            self.held.clear()
            yield self.told(values, change + 1, GONE)

    def close(self) -> None:
        pass


class Edges(StatefulProcessor):
    """Keeps each follower's winning list and its members; emits (follower, followee, change, op) for the members that differ."""

    def __init__(self, tie: str, members: str):
        self.time, self.tie, self.members = MICROS, tie, members

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getValueState("list", "micros long, tie string, change long")
        self.edge = handle.getMapState("edge", "followee string", "since long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = None
        for row in rows:
            if row[self.time] is not None and newer(row[self.time], row[self.tie], best and (best[self.time], best[self.tie])):
                best = row
        if best is None:
            return
        time, tie, change = self.list.get() if self.list.exists() else (None, None, 0)
        if change and not newer(best[self.time], best[self.tie], (time, tie)):
            return
        self.list.update((best[self.time], best[self.tie], change + 1))
        wanted = {m for m in best[self.members] or () if m is not None and MEMBER.fullmatch(m)}
        held = {k[0] for k in self.edge.keys()} if change else set()
        for followee in sorted(held - wanted):
            self.edge.removeKey((followee,))
            yield Row(follower=key[0], followee=followee, change=change + 1, op=GONE)
        for followee in sorted(wanted - held):
            self.edge.updateValue((followee,), (change + 1,))
            yield Row(follower=key[0], followee=followee, change=change + 1, op=PUT)

    def close(self) -> None:
        pass


def leading(keys: Sequence[str], tie: str):
    """Of each key's rows the winning one, among AT_ONCE rows of a task: what can't win isn't sent to where its key's state is."""

    def best(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        rows = rows.filter(pc.is_valid(rows.column(MICROS)))
        rows = rows.take(pc.sort_indices(rows, [*[(k, "ascending") for k in keys], (MICROS, "descending"), (tie, "ascending")])).combine_chunks()
        if rows.num_rows:
            other = reduce(pc.or_, [pc.not_equal(rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1)) for k in keys])
            yield from rows.filter(pa.chunked_array([pa.array([True]), *other.chunks])).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield from best(held)
                held, n = [], 0
        if held:
            yield from best(held)

    return run


def latest_changes(stream: DataFrame, keys: Sequence[str], time: str, tie: str, delay: str = "0 seconds", horizon_ms: int | None = None) -> DataFrame:
    """The log of latest-wins rows of a stream: its columns, ``change`` and ``op``. With ``horizon_ms`` keys leave that long after their time."""
    fields = stream.schema.fieldNames()
    kept = [f for f in stream.schema.fields if f.name != time]
    schema = T.StructType([*kept, T.StructField(MICROS, T.LongType())])
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).where(" and ".join(f"{k} is not null" for k in keys))
    if horizon_ms is not None:
        rows = rows.withWatermark(time, delay)
    rows = rows.withColumn(MICROS, F.unix_micros(time)).select(*schema.fieldNames()).mapInArrow(leading(keys, tie), schema)
    out = T.StructType([*schema.fields, T.StructField("change", T.LongType()), T.StructField("op", T.StringType())])
    mode = "None" if horizon_ms is None else "EventTime"
    changes = rows.groupBy(*keys).transformWithState(Latest(schema, tie, horizon_ms), out, "Append", mode)
    return changes.withColumn(time, F.timestamp_micros(MICROS)).select(*fields, "change", "op")


def edge_changes(lists: DataFrame, follower: str, time: str, tie: str, members: str) -> DataFrame:
    """The log of edges of a stream of follow lists (members: array of strings): (follower, followee, change, op)."""
    kind = lists.schema[follower].dataType
    rows = lists.where(F.col(follower).isNotNull()).select(follower, F.unix_micros(F.col(time).cast("timestamp")).alias(MICROS), F.col(tie).cast("string").alias(tie), members)
    out = T.StructType([T.StructField("follower", kind), T.StructField("followee", T.StringType()), T.StructField("change", T.LongType()), T.StructField("op", T.StringType())])
    return rows.groupBy(follower).transformWithState(Edges(tie, members), out, "Append", "None")


def run(changes: DataFrame, folder: str, then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a log of changes to its end into ``folder``; returns all that was ever emitted there. ``then`` also sees each batch."""
    spark = changes.sparkSession
    with rocks(spark):
        writer = changes.writeStream.option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True)
        if then is None:
            writer = writer.format("parquet").option("path", f"{folder}/log")
        else:
            writer = writer.foreachBatch(then)
        writer.start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{folder}/log") if then is None else changes.sparkSession.createDataFrame([], changes.schema)


def present(log: DataFrame, keys: Sequence[str], time: str | None = None) -> DataFrame:
    """The rows that are there after all changes: of each key's last change, unless it went. Partial maxima, no key in one place.

    ``time`` is the time column of a log of latest rows: a key that has left and come back counts its changes anew, with a later time.
    """
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*([time] if time else []), "change")).alias("last"))
    return last.where(F.col("last.op") == PUT).select(*keys, *[f"last.{c}" for c in rest if c not in ("change", "op")])
