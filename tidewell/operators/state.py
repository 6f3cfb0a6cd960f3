"""State tables: latest-wins, change-detecting upserts, edge replacement, deletes, and published snapshots.

Plain parquet has no MERGE, so an update is a plan from the old snapshot and the new rows to the next
snapshot, which the commit log (``commits``) publishes if nobody else has been faster.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import commits
from .window import WINDOW, eligible


def latest(rows: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the smallest ``tie``. Pruned before the shuffle (WindowGroupLimit)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.asc(tie))
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    return latest(old.unionByName(new), keys, time, tie)


def edges(state: DataFrame, tag: str = "p") -> DataFrame:
    """(follower, followee) from winning follow lists: distinct, well-formed tags only; a new list replaces all edges."""
    return state.select(F.col("pubkey").alias("follower"), F.explode("tags").alias("t")).where(
        (F.get("t", F.lit(0)) == tag) & F.get("t", F.lit(1)).rlike(r"^[0-9a-f]{64}\z")
    ).select("follower", F.col("t")[1].alias("followee")).distinct()


def upsert_actions(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, action): insert, update if any compared column differs null-safely, unchanged, or keep (not in the new rows)."""
    o, n = old.select(key, *compared).alias("o"), new.select(key, *compared).alias("n")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = (
        F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "keep").when(same, "unchanged").otherwise("update")
    )
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The next snapshot: new rows, and old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def admissible(rows: DataFrame, now: int, source: str) -> DataFrame:
    """Rows an upsert takes: inside the window first, then of the accepted source (others raise)."""
    inside = eligible(rows, now)
    foreign = F.concat(F.lit("unsupported source: "), F.coalesce("source", F.lit("null")))
    return inside.withColumn("source", F.when(F.col("source") == source, F.col("source")).otherwise(F.raise_error(foreign).cast("string")))


def expire(posts: DataFrame, warnings: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Posts not older than the window, and the warnings that still have a post."""
    kept = posts.where(F.col("created_at") >= now - WINDOW)
    return kept, warnings.join(kept.select("canonical_id"), "canonical_id", "left_semi")


def warnings_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(canonical_id, category, reason, created_at): the last reason (by ``seq``) wins, the first time stays."""
    rows = old.unionByName(new)
    return rows.groupBy("canonical_id", "category").agg(F.max_by("reason", "seq").alias("reason"), F.min_by("created_at", "seq").alias("created_at"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where it is unset one of our own is used, but only if driver and executors are one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir():
        return context._jsc.sc().getCheckpointDir().get()  # set by setCheckpointDir
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidewell-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def _storage(spark: SparkSession, folder: str):
    """(path class, file system) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def publish_all(tables: dict[str, DataFrame], folder: str, base: commits.Snapshot | None = None, keep: int = 10) -> int:
    """Publish whole tables as the next commit of the store ``folder`` and return its number; all appear together or not at all.

    ``base`` is the commit that the tables were planned from, by default the latest one now. Raises ``commits.Conflict`` where another writer
    has published since. The last ``keep`` commits stay for readers that began earlier.
    """
    spark = next(iter(tables.values())).sparkSession
    number = commits.publish(base or commits.snapshot(spark, folder), {n: commits.Write(t) for n, t in tables.items()}).number
    if number > keep:
        commits.sweep(spark, folder, keep)
    return number


def current_all(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame] | None:
    """The tables of the latest commit, or None."""
    last = commits.snapshot(spark, folder)
    return {n: last.read(n) for n in names} if last.number else None


def publish(df: DataFrame, folder: str, base: commits.Snapshot | None = None) -> int:
    """``publish_all`` of one table."""
    return publish_all({"rows": df}, folder, base)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The published rows of one table, or None."""
    found = current_all(spark, folder, ("rows",))
    return found and found["rows"]
