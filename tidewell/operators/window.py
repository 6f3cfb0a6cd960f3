"""The rolling window that every read applies, clamps of its upper end, and stable pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
WINDOW = 30 * DAY
PAGE = 50


def upper(now: int, before: int | None = None) -> int:
    """``before`` can only lower the end of the window; absent means ``now``."""
    return now if before is None else min(before, now)


def eligible(posts: DataFrame, now: int, before: int | None = None) -> DataFrame:
    """Rows created within the 30 days up to ``now``, both ends included, and not after ``before``.

    Of posts stored by day (column ``part``) only the window's days are read.
    """
    low, high = now - WINDOW, upper(now, before)
    if "part" in posts.columns:
        posts = posts.where(F.col("part").between(low // DAY, high // DAY))
    return posts.where(F.col("created_at").between(low, high))


def page(rows: DataFrame, order: list[Column], number: int = 0, size: int = PAGE) -> DataFrame:
    """One page in a total order; Spark plans a single top-k."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def lookup(posts: DataFrame, canonical_id: str, now: int) -> DataFrame:
    """One row by key, only while it is eligible."""
    return eligible(posts, now).where(F.col("canonical_id") == canonical_id).limit(1)


def numbered(rows: DataFrame, buckets: list[tuple[Column, bool]], order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their number from 1 in a total order, without one task that holds all of them.

    ``buckets``: (column, descending) pairs that the order begins with, coarse enough that their combinations are few and fine enough that each
    holds few rows; ``order`` goes on inside a bucket. Buckets are counted, the counts summed in order, and rows numbered inside each. Null buckets
    come first, last where descending.
    """
    keys = [f"__b{i}" for i in range(len(buckets))]
    told = rows.withColumns(dict(zip(keys, (c for c, _ in buckets))))
    ahead = Window.orderBy(*[F.desc(k) if down else F.asc(k) for k, (_, down) in zip(keys, buckets)]).rowsBetween(Window.unboundedPreceding, -1)
    counts = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return told.join(counts, same).withColumn(name, (inside + F.col("__ahead")).cast("long")).drop(*keys, *[f"{k}_" for k in keys], "__ahead")
