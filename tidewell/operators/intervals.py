"""Threads as intervals: every post's place on entering and leaving its tree, kept with the posts.

A post's replies are the posts whose entry lies inside its interval, its ancestors those whose interval holds its entry: one
range comparison within a thread, whatever the depth; no recursion and no cap. The numbers come from a tour
that enters and leaves every post, counted by pointer doubling in as many rounds as the logarithm of the largest thread. Posts on a cycle have no
place in a tree; for them ``cycles`` tells the cycle that they are on or below.

Stored intervals are split by the hash of the root, so that one thread's questions read one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import commits
from .commits import PART, Snapshot, Write
from .state import checkpoint_dir
from .tree import SHOWN_DEPTH
from .window import eligible

PARTS = 64


def tour(nodes: DataFrame, order: tuple[str, ...] = ("created_at", "canonical_id")) -> DataFrame:
    """(root_id, canonical_id, entry, leave, depth, missing_parent_id) of all nodes that hang below a root.

    ``nodes``: (canonical_id, parent_id and the columns of ``order``, which orders siblings). A root is a node without a parent
    among them. Entries count a tree's posts in display order from 0, ``leave`` is the last entry below the post.
    """
    checkpoint_dir(nodes.sparkSession)
    rows = nodes.select("canonical_id", "parent_id", *[c for c in order if c not in ("canonical_id", "parent_id")])
    known = rows.select(F.col("canonical_id").alias("parent_id"), F.lit(True).alias("known"))
    placed = rows.join(known, "parent_id", "left").withColumn("parent", F.when(F.col("known"), F.col("parent_id")))
    below = _siblings(placed.where("parent is not null").drop("parent_id", "known"), order)
    first = below.where("eldest").select(F.col("parent").alias("canonical_id"), F.col("canonical_id").alias("child"))
    at = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    linked = placed.select("canonical_id").join(below, "canonical_id", "left").join(first, "canonical_id", "left")
    # What follows each step to the tour's end: posts entered, and levels gone up.
    enter = linked.select(at("+", "canonical_id").alias("at"), F.coalesce(at("+", "child"), at("-", "canonical_id")).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("up"))
    leave = linked.select(at("-", "canonical_id"), F.coalesce(at("+", "sibling"), at("-", "parent")), F.lit(0).cast("long"), F.lit(-1).cast("long"))
    few = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = enter.union(leave).withColumn("last", F.col("at")).coalesce(few).checkpoint()
    going = steps.where("next is not null").count()
    while going:
        ahead = steps.select(F.col("at").alias("next"), F.col("next").alias("n2"), F.col("entered").alias("e2"), F.col("up").alias("u2"), F.col("last").alias("l2"))
        moved = steps.where("next is not null").join(ahead, "next").select(
            "at", F.col("n2").alias("next"), (F.col("entered") + F.col("e2")).alias("entered"), (F.col("up") + F.col("u2")).alias("up"), F.col("l2").alias("last")
        )
        steps = steps.where("next is null").unionByName(moved).coalesce(few).checkpoint()
        left = steps.where("next is not null").count()
        if left == going:
            break  # what is left goes round in cycles
        going = left
    ended = steps.where("next is null").select(F.substring("at", 1, 1).alias("kind"), F.expr("substring(at, 2)").alias("canonical_id"), F.expr("substring(last, 2)").alias("root_id"), "entered", "up")
    both = ended.groupBy("canonical_id", "root_id").agg(
        F.max(F.when(F.col("kind") == "+", F.col("entered"))).alias("in"), F.max(F.when(F.col("kind") == "-", F.col("entered"))).alias("out"), F.max(F.when(F.col("kind") == "+", -F.col("up"))).alias("depth")
    )
    whole = both.where("canonical_id = root_id").select("root_id", F.col("in").alias("whole"))
    lost = placed.where("parent_id is not null and parent is null").select(F.col("canonical_id").alias("root_id"), F.col("parent_id").alias("missing_parent_id"))
    return both.join(whole, "root_id").join(lost, "root_id", "left").select(
        "root_id", "canonical_id", (F.col("whole") - F.col("in")).alias("entry"), (F.col("whole") - F.col("out") - 1).alias("leave"), "depth", "missing_parent_id"
    )


def _siblings(children: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(canonical_id, parent, sibling, eldest): the next child of the parent, and whether it is the first.

    Children are sorted in ranges of (parent, order), so that a parent of very many has several; a range's last child is followed by the first one of
    the parent's next range.
    """
    few = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = children.repartitionByRange(few, "parent", *order).withColumn("range", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("parent", "range").orderBy(*order)
    edges = ranged.groupBy("parent", "range").agg(F.min_by("canonical_id", F.struct(*order)).alias("head"))
    across = Window.partitionBy("parent").orderBy("range")  # a row a range
    edges = edges.withColumn("onward", F.lead("head").over(across)).withColumn("foremost", F.row_number().over(across) == 1)
    rows = ranged.withColumn("sibling", F.lead("canonical_id").over(inside)).join(edges, ["parent", "range"])
    return rows.select("canonical_id", "parent", F.coalesce("sibling", "onward").alias("sibling"), (F.col("foremost") & (F.col("canonical_id") == F.col("head"))).alias("eldest"))


def cycles(nodes: DataFrame) -> DataFrame:
    """(canonical_id, cycle_id, on_cycle): posts that no root is above, with the smallest id of the cycle that they are on or below.

    Doubling again: after as many rounds as the logarithm of their number every pointer has arrived on the cycle and gone all round it.
    """
    checkpoint_dir(nodes.sparkSession)
    ids = nodes.select(F.col("canonical_id").alias("parent_id"))
    edges = nodes.where("parent_id is not null").join(ids, "parent_id", "left_semi").select("canonical_id", F.col("parent_id").alias("to"), F.col("parent_id").alias("least"))
    edges, size = edges.checkpoint(), -1
    while (now := edges.count()) != size:  # posts that reach a root leave, layer by layer of twice the length
        size = now
        ahead = edges.select(F.col("canonical_id").alias("to"), F.col("to").alias("t2"), F.col("least").alias("l2"))
        edges = edges.join(ahead, "to").select("canonical_id", F.col("t2").alias("to"), F.least("least", "l2").alias("least")).checkpoint()
    if not size:
        return edges.select("canonical_id", F.col("least").alias("cycle_id"), F.lit(True).alias("on_cycle"))
    for _ in range(size.bit_length()):
        ahead = edges.select(F.col("canonical_id").alias("to"), F.col("to").alias("t2"), F.col("least").alias("l2"))
        edges = edges.join(ahead, "to").select("canonical_id", F.col("t2").alias("to"), F.least("least", "l2").alias("least")).checkpoint()
    reached = edges.select(F.col("to").alias("canonical_id")).distinct().withColumn("on_cycle", F.lit(True))  # all have arrived
    arrived = edges.select(F.col("canonical_id").alias("to"), F.col("least").alias("cycle_id"))  # where they are now they see nothing but the cycle
    return edges.join(arrived, "to").join(reached, "canonical_id", "left").select("canonical_id", "cycle_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def forest_preorder(posts: DataFrame, now: int) -> DataFrame:
    """(root_id, position, canonical_id, depth) of all threads at once; depth is cut at SHOWN_DEPTH, posts on or below a cycle have no place."""
    return tour(eligible(posts, now)).select(
        "root_id", (F.col("entry") + 1).alias("position"), "canonical_id", F.least("depth", F.lit(SHOWN_DEPTH)).alias("depth")
    )


# ---------------------------------------------------------------- stored


def split(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn(PART, F.pmod(F.xxhash64("root_id"), F.lit(PARTS)).cast("int"))


def store(nodes: DataFrame, folder: str, name: str = "threads") -> Snapshot:
    """The intervals of all nodes as a table of the store ``folder``, sorted by thread and entry."""
    base = commits.snapshot(nodes.sparkSession, folder)
    return commits.publish(base, {name: Write(split(tour(nodes)), order=("root_id", "entry"))})


def grown(base: Snapshot, nodes: DataFrame, fresh: DataFrame, name: str = "threads") -> dict[str, Write]:
    """The table after ``fresh`` nodes have come to ``nodes`` (all nodes, fresh ones too): threads that they touch are numbered again, in their parts only."""
    stored = base.read(name)
    waiting = stored.where("missing_parent_id is not null").join(fresh.select(F.col("canonical_id").alias("missing_parent_id")), "missing_parent_id", "left_semi").select("root_id")
    parents = stored.join(fresh.where("parent_id is not null").select(F.col("parent_id").alias("canonical_id")), "canonical_id", "left_semi").select("root_id")
    touched = waiting.union(parents).union(stored.join(fresh.select("canonical_id"), "canonical_id", "left_semi").select("root_id")).distinct()
    checkpoint_dir(base.spark)
    touched = touched.checkpoint()
    members = stored.join(touched, "root_id", "left_semi").select("canonical_id").union(fresh.select("canonical_id")).distinct()
    renewed = split(tour(nodes.join(members, "canonical_id", "left_semi")))
    parts = [r[0] for r in split(touched).select(PART).union(renewed.select(PART)).distinct().collect()]  # PARTS at most
    if not parts:
        return {}
    kept = base.read(name, parts).join(touched, "root_id", "left_anti").select(*stored.columns)
    return {name: Write(kept.unionByName(renewed.select(*stored.columns)), parts, order=("root_id", "entry"))}


def _here(intervals: DataFrame, canonical_id: str) -> DataFrame:
    """The post's own row, one at most."""
    return intervals.where(F.col("canonical_id") == canonical_id).limit(1)


def ancestors(intervals: DataFrame, canonical_id: str) -> DataFrame:
    """(canonical_id, distance, missing_parent_id): the post and all above it, in one range join inside its thread."""
    own = _here(intervals, canonical_id).select("root_id", F.col("entry").alias("here"), F.col("depth").alias("deep"))
    rows = intervals.join(F.broadcast(own), "root_id").where("entry <= here and leave >= here")  # one row
    return rows.select("canonical_id", (F.col("deep") - F.col("depth")).alias("distance"), F.when(F.col("canonical_id") == F.col("root_id"), F.col("missing_parent_id")).alias("missing_parent_id"))


def replies(intervals: DataFrame, canonical_id: str) -> DataFrame:
    """(position, canonical_id, depth): all below the post in display order from 1; depth is cut at SHOWN_DEPTH. The numbers are stored: nothing is sorted."""
    own = _here(intervals, canonical_id).select("root_id", F.col("entry").alias("from"), F.col("leave").alias("to"), F.col("depth").alias("top"))
    rows = intervals.join(F.broadcast(own), "root_id").where("entry > from and entry <= to")
    return rows.select((F.col("entry") - F.col("from")).alias("position"), "canonical_id", F.least(F.col("depth") - F.col("top"), F.lit(SHOWN_DEPTH)).cast("long").alias("depth"))


def pairs(intervals: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of all posts: a range join inside each thread, by its result's size."""
    a = intervals.select("root_id", F.col("canonical_id").alias("ancestor"), F.col("entry").alias("from"), F.col("leave").alias("to"), F.col("depth").alias("top"))
    rows = intervals.join(a, "root_id").where("entry > from and entry <= to")
    return rows.select(F.col("canonical_id").alias("id"), "ancestor", (F.col("depth") - F.col("top")).alias("distance"))
