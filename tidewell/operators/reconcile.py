"""Set reconciliation: what two tables of (time, id) differ in, by fingerprints of ranges that are entered only where they differ.

Ids hash into a tree of FANOUT ways within each day. A level's fingerprint is the sum of the hashes below (and their number), so that
one aggregation gives the deepest level and sums of sums the others. Two sides compare from the top: ranges with equal
fingerprints are left, the others are entered. Where both sides keep their fingerprints (``stored``), a comparison reads a handful of
rows a level and in the end only the rows of ranges that differ: the rows read follow the difference, not the tables.

Edge cases: rows without an id are ignored, a null time is a day of its own; an id that repeats with one time is one; an id with two times is two.
Fingerprints are sums of two 64-bit hashes and a count: sets that differ and agree in all three are missed, once in 2**128.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import checkpoint_dir
from .window import DAY

#: Ways that a range divides into, levels below the day, and ranges whose rows are compared at once.
FANOUT_BITS, LEVELS = 4, 4
NO_DAY = -(1 << 40)


def keyed(rows: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """(day, h, id, at): one row an id and time."""
    at = F.col(time_col).cast("long")
    out = rows.where(F.col(id_col).isNotNull()).select(F.coalesce(F.floor(at / DAY), F.lit(NO_DAY)).alias("day"), F.col(id_col).cast("string").alias("id"), at.alias("at")).distinct()
    return out.withColumn("h", F.xxhash64("id", "at")).withColumn("g", F.xxhash64(F.lit("second"), "id", "at"))


def _cell(level: int):
    """The number of the range of a level below the day; 0 ways above."""
    return F.shiftrightunsigned("h", 64 - FANOUT_BITS * level) if level else F.lit(0).cast("long")


def fingerprints(rows: DataFrame, id_col: str = "id", time_col: str = "created_at", levels: int = LEVELS) -> list[DataFrame]:
    """(day, cell, n, a, b) of every level from the whole day down. Sums wrap round, as hashes may."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    deep = keyed(rows, id_col, time_col).withColumn("cell", _cell(levels)).groupBy("day", "cell").agg(
        F.count(F.lit(1)).alias("n"), wide("h").alias("a"), wide("g").alias("b")
    )
    out = [deep]
    for _ in range(levels):
        up = out[0].withColumn("cell", F.shiftrightunsigned("cell", FANOUT_BITS)).groupBy("day", "cell").agg(F.sum("n").alias("n"), wide("a").alias("a"), wide("b").alias("b"))
        out.insert(0, up)
    return out


def differing(mine: list[DataFrame], other: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """(day, cell) of the deepest ranges that differ, and how many differed at each level."""
    checkpoint_dir(mine[0].sparkSession)
    inside, counts = None, []
    for level, (a, b) in enumerate(zip(mine, other)):
        if inside is not None:
            here = F.shiftrightunsigned("cell", FANOUT_BITS)
            enter = lambda side: side.withColumn("above", here).join(inside.withColumnRenamed("cell", "above"), ["day", "above"], "left_semi").drop("above")
            a, b = enter(a), enter(b)
        same = a.withColumnRenamed("n", "n1").join(b.withColumnRenamed("n", "n2").withColumnRenamed("a", "a2").withColumnRenamed("b", "b2"), ["day", "cell"], "full_outer")
        inside = same.where("not (n1 <=> n2 and a <=> a2 and b <=> b2)").select("day", "cell").checkpoint()
        counts.append(inside.count())
        if not counts[-1]:
            break
    return inside, counts


def difference(mine: DataFrame, other: DataFrame, id_col: str = "id", time_col: str = "created_at", stored: tuple[list[DataFrame], list[DataFrame]] | None = None) -> tuple[DataFrame, list[int]]:
    """((id, at, side): rows of one side only, 'mine' or 'other'; ranges that differed at each level).

    ``stored``: both sides' fingerprints, if they are kept.
    """
    a, b = stored or (fingerprints(mine, id_col, time_col), fingerprints(other, id_col, time_col))
    ranges, counts = differing(a, b)
    level = len(a) - 1
    inside = lambda rows: keyed(rows, id_col, time_col).withColumn("cell", _cell(level)).join(ranges, ["day", "cell"], "left_semi").select("id", "at")
    sides = inside(mine).withColumn("s", F.lit(1)).unionByName(inside(other).withColumn("s", F.lit(-1)))
    rows = sides.groupBy("id", "at").agg(F.sum("s").alias("s")).where("s <> 0")
    return rows.select("id", "at", F.when(F.col("s") > 0, "mine").otherwise("other").alias("side")), counts
