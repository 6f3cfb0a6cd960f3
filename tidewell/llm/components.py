"""Connected components of an edge table by alternating large and small stars.

Every round joins each vertex's neighbours to its smallest one; the number of rounds grows with the
logarithm of the longest chain.  Edges stay distributed throughout and each round is kept in the
checkpoint folder.  A vertex with very many neighbours is a skewed join key, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(u: str, v: str) -> list:
    return [F.col(u).alias("u"), F.col(v).alias("v")]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each vertex of ``edges`` (two long columns) reaches.

    Loops, repeated edges and null ends are ignored; vertices without an edge don't appear.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(mark).first()
    while before[0][0]:
        both = now.union(now.select(*_star("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(*_star("v", "m")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(*_star("v", "m")).union(least.select(*_star("u", "m"))).distinct()
        now = cut(small)
        after = now.agg(mark).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
