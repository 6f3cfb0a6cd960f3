"""De-duplication beyond any watermark: ids that have been seen, by day, behind Bloom filters.

A store holds, for every day of event time, the ids seen and a Bloom filter of them. A batch is first reduced to distinct ids; an id whose
bits aren't all set in its day's filters is new for certain; only ids that may have been seen are compared exactly, with the ids of
their own days, of which nothing else is read. New ids are added as further parts of their days: nothing that is stored is written again.

A filter has BITS bits for each part, as rows of 32,768 (Spark's bitmap functions), of which HASHES are set for an id. Days are kept as long
as wanted (``forget``), not as long as a watermark lasts. Ids count with their day: an event's id fixes its time.

Edge cases: null ids are dropped, null times are a day of their own; what comes twice in one batch is one; a batch that is replayed finds all its ids seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits
from ..operators.commits import PART, Snapshot, Write
from ..operators.reconcile import NO_DAY
from ..operators.window import DAY

ROW_BITS, HASHES = 1 << 15, 3
#: Bits for each id that a batch adds.
BITS_AN_ID = 16
#: Parts of one day: its number times this, plus the number of the commit.
EVERY = 1_000_000


def day_of(time: str) -> Column:
    return F.coalesce(F.floor(F.col(time).cast("long") / DAY), F.lit(NO_DAY)).cast("long")


def _bits(rows: DataFrame, size: Column) -> DataFrame:
    """Rows with each of their HASHES bits, among ``size`` of them: ``bucket`` and ``bit``."""
    spots = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), size) for k in range(HASHES)])
    return rows.withColumn("spot", F.explode(spots)).withColumn("bucket", F.floor(F.col("spot") / ROW_BITS)).withColumn("bit", (F.col("spot") % ROW_BITS).cast("int"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1


class Seen:
    """One commit of the ids that have been seen."""

    def __init__(self, base: Snapshot):
        self.base, self.spark = base, base.spark

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> Seen:
        return cls(commits.snapshot(spark, folder))

    def days(self) -> dict[int, list[int]]:
        """Parts of each day."""
        out: dict[int, list[int]] = {}
        for p in self.base.parts("ids"):
            out.setdefault(int(p) // EVERY, []).append(int(p))
        return out

    def maybe(self, rows: DataFrame) -> DataFrame:
        """The rows (id, day) that a filter of their day doesn't rule out."""
        if not self.base.number:
            return rows.limit(0)
        sizes = self.base.read("sizes").select("day", "filter", "size")  # a row a part
        asked = _bits(rows.join(sizes, "day"), F.col("size"))
        filters = self.base.read("filters").select("day", "filter", "bucket", "bitmap")
        hits = asked.join(filters, ["day", "filter", "bucket"]).where(_is_set(F.col("bitmap"), F.col("bit")))
        return hits.groupBy("id", "day", "filter").agg(F.count(F.lit(1)).alias("n")).where(f"n = {HASHES}").select("id", "day").distinct()

    def fresh(self, events: DataFrame, id_col: str, time: str) -> tuple[DataFrame, DataFrame]:
        """((id, day) that haven't been seen, those that a filter let through)."""
        rows = events.select(F.col(id_col).cast("string").alias("id"), day_of(time).alias("day")).where("id is not null").distinct()
        maybe = self.maybe(rows)
        known = self.days()
        hit = [r[0] for r in maybe.select("day").distinct().collect()]  # days of one batch
        parts = [p for d in hit for p in known.get(d, [])]
        if not parts:
            return rows, maybe
        exact = self.base.read("ids", parts).select("id", "day").join(maybe, ["id", "day"], "left_semi")
        return rows.join(exact, ["id", "day"], "left_anti"), maybe

    def added(self, fresh: DataFrame) -> Snapshot:
        """The next commit, with (id, day) added."""
        number = self.base.number + 1
        part = (F.col("day") * EVERY + number).cast("long")
        counts = {r["day"]: r["n"] for r in fresh.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
        size = {d: max(ROW_BITS, -(-n * BITS_AN_ID // ROW_BITS) * ROW_BITS) for d, n in counts.items()}
        sizes = self.spark.createDataFrame([(d * EVERY + number, d, number, s) for d, s in size.items()], f"{PART} long, day long, filter long, size long")
        bits = _bits(fresh.join(F.broadcast(sizes.drop(PART)), "day"), F.col("size"))  # a row a day
        filters = bits.groupBy("day", "filter", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
        own = [d * EVERY + number for d in counts]
        writes = {
            "ids": Write(fresh.select(part.alias(PART), "id", "day"), own, order=("id",)), "sizes": Write(sizes, own),
            "filters": Write(filters.select(part.alias(PART), "day", "filter", "bucket", "bitmap"), own, order=("bucket",)),
        }
        return commits.publish(self.base, writes)

    def forget(self, before: int) -> Snapshot:
        """The next commit, without the days before that of the time ``before``; no row is read or written."""
        gone = [p for d, parts in self.days().items() for p in parts if d < before // DAY and d != NO_DAY]
        return commits.publish(self.base, {n: Write(None, gone) for n in ("ids", "sizes", "filters")})


def first_sightings(spark: SparkSession, batch: DataFrame, folder: str, id_col: str, time: str) -> DataFrame:
    """The rows of a batch whose ids haven't been seen before, one a id; they are seen from then on."""
    from ..operators.state import checkpoint_dir

    checkpoint_dir(spark)
    store = Seen.stored(spark, folder)
    fresh = store.fresh(batch, id_col, time)[0].checkpoint()
    if fresh.take(1):
        store.added(fresh)
    named = batch.withColumn("__id", F.col(id_col).cast("string")).dropDuplicates(["__id"])
    return named.join(fresh.select(F.col("id").alias("__id")), "__id", "left_semi").drop("__id")


def stream(events: DataFrame, folder: str, id_col: str, time: str) -> DataFrame:
    """Runs a stream of events to its end; returns the first sightings of all ids, which lie under ``folder``/out."""
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        first_sightings(spark, batch, f"{folder}/seen", id_col, time).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out")
