"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words.  Its documents stand in a line, longest first, those of one
size in the order of a hash; each expects as many copies as the words still wanted are of the words still to come
(between 0 and ``most``).  The expected copies are prefix sums along the line, shifted by one random offset
a source, and a document is emitted once for each integer boundary that its interval crosses.  What
rounding has given to long documents too much or too little is so made up by the shorter ones behind them: a
source misses its target by about its shortest documents, not by its longest.

The line is a line of (source, size) *classes* with their numbers of documents: one source's classes are
walked in one task, as rows of two numbers.  Inside a class a document's place is a count of cells
(ranges of the hash) before its own, plus its row number in the cell; a class that holds more than CELL_ROWS
documents, or a 20,000th of all, is many cells, and there are fewer than 20,000 such classes.  Sources and classes stay distributed;
targets come from a few sums.  Words are counted in one scan, without shuffling text, and nothing
random is drawn at run time, so reruns agree.

Edge cases: a null or empty text has size 0 and is taken 0 words (it still has copies); a null source
is a source of its own, last in order; null ids are ordered like the empty id; repeated rows are sampled separately, and rows
that share an id and a size are told apart by their texts; a text of any length is counted whole; an empty
table gives an empty result; other columns pass untouched in ``mix`` and are ignored in ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Documents of a class that a cell holds at most, and the share of all documents if that is more.
CELL_ROWS, CELL_SHARE = 100, 20_000
SEED = "mix"

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(text: Column) -> Column:
    """A number from 0 to 1 by the first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): by weights that repeat in the order of code points, null last.

    A target above ``most`` times its source's size stops there, and the excess is shared again by weight until none is above.
    Each round is one sum over the sources. Only the numbering of the sources goes through one task, by a sort that can spill.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    own = cut(totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1)))
    all_words = own.agg(F.sum("source_size")).first()[0] or 0
    if not all_words:
        return own.withColumn("target", F.lit(0.0)).drop("weight")
    limit = F.lit(float(most)) * F.col("source_size")
    capped, rest, weight = F.lit(False), share * all_words, None
    while True:
        held = own.agg(F.sum(F.when(capped, F.col("source_size"))).alias("s"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        rest, weight = share * all_words - most * (held["s"] or 0), held["w"]
        target = F.lit(rest) * F.col("weight") / F.lit(weight)
        above = ~capped & (target > limit)
        found = own.agg(F.count_if(above).alias("above"), F.count_if(~capped).alias("free")).first()
        if not found["above"] or found["above"] == found["free"]:
            return own.withColumn("target", F.least(F.when(capped, limit).otherwise(target), limit)).drop("weight")
        capped = capped | above


def walk(size: np.ndarray, n: np.ndarray, target: float, offset: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(expected copies a document, place in the line before the class, whole copies left out) of one source's classes, longest first."""
    rate, start = np.zeros(len(size)), np.zeros(len(size))
    words = int((size * n).sum())
    even = min(target / words, most) if words else 0.0
    wanted, left, place = target, words, offset
    for k, (s, m) in enumerate(zip(size.tolist(), n.tolist())):
        each = min(max(wanted / left, 0.0), most) if s and left else even
        rate[k], start[k] = each, place
        upto = place + each * m
        wanted -= (np.floor(upto) - np.floor(place)) * s
        left -= s * m
        place = upto - np.floor(upto)
    return rate, start


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Returns (id, source, size, source_size, target, copies, taken) and the columns in ``carry``."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), word_count(text).alias("size"),
        F.md5(F.concat(F.lit(SEED), name).cast("binary")).alias("at"), F.xxhash64(text).alias("tie"), *carry,
    )
    sized = cut(rows.drop(*carry))
    totals = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    aims = cut(targets(totals, weights, share, most))
    classes = cut(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    documents = classes.agg(F.sum("n")).first()[0] or 0
    cell_rows = max(CELL_ROWS, documents // CELL_SHARE)

    def walked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        first = {c: table.column(c)[0].as_py() for c in ("target", "offset")}
        rate, start = walk(table.column("size").to_numpy(), table.column("n").to_numpy(), first["target"], first["offset"], most)
        return table.select(["key", "size", "source_size", "target"]).append_column("rate", pa.array(rate)).append_column("start", pa.array(start))

    lines = classes.join(aims.select("key", "source_size", "target", fraction(F.concat(F.lit(SEED), "key")).alias("offset")), "key").groupBy("key").applyInArrow(
        walked, "key string, size long, source_size long, target double, rate double, start double"
    )
    large = classes.where(F.col("n") > cell_rows).select("key", "size", F.ceil(F.col("n") / cell_rows).alias("slices"))  # fewer than CELL_SHARE rows
    slice_of = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.coalesce("slices", F.lit(1)))
    placed = lambda frame: frame.join(F.broadcast(large), ["key", "size"], "left").withColumn("slice", slice_of).drop("slices")
    cell = ["key", "size", "slice"]
    counts = placed(sized).groupBy(*cell).agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    cells = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(lines, ["key", "size"]).drop("held")
    inside = Window.partitionBy(*cell).orderBy("at", id_col, "tie")
    joined = placed(rows if carry else sized).withColumn("place", F.row_number().over(inside)).join(cells, cell)
    upto = F.col("before") + F.col("place")
    copies = F.least(F.floor(F.col("start") + F.col("rate") * upto) - F.floor(F.col("start") + F.col("rate") * (upto - 1)), F.floor(F.lit(most))).cast("long")
    return joined.withColumn("copies", copies).select(
        id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as its copies say."""
    whole = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    drawn = plan(whole, id_col, text_col, source_col, carry=["__row"], **options)
    copies = F.array_repeat("__row", F.col("copies").cast("int"))
    return drawn.where("copies > 0").select(F.explode(copies).alias("r")).select("r.*")
