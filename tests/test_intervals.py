"""Threads as intervals: depth without a cap, order, cycles, missing parents, and growth."""

import random
import time

from pyspark.sql import functions as F

from tidewell.operators import commits, feeds, intervals

NODE = "canonical_id string, parent_id string, created_at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, NODE).repartition(3)


def plain(rows):
    """{id: (root, entry, leave, depth, missing)} by recursion over sorted children."""
    held, below, out = {i: (p, t) for i, p, t in rows}, {}, {}
    for i, p, t in rows:
        below.setdefault(p if p in held else None, []).append((t, i))

    for _, top in sorted(below.get(None, [])):
        stack, n, missing = [(top, 0)], 0, held[top][0]
        order = []
        while stack:
            i, d = stack.pop()
            order.append((i, d))
            stack += [(c, d + 1) for _, c in sorted(below.get(i, []), reverse=True)]
        for n, (i, d) in enumerate(order):
            last = n
            while last + 1 < len(order) and order[last + 1][1] > d:
                last += 1
            out[i] = (top, n, last, d, missing if i == top else None)
    return out


def forest(n=150, seed=2):
    rng = random.Random(seed)
    rows = [(f"n{k}", None if k % 17 == 0 else f"n{rng.randrange(k)}", rng.randrange(9)) for k in range(n)]
    rows += [("lost", "gone", 5), ("child", "lost", 6), ("c1", "c3", 1), ("c2", "c1", 2), ("c3", "c2", 3), ("tail", "c2", 4), ("tail2", "tail", 5), ("self", "self", 1)]
    return rows


def test_tour(spark):
    rows = forest()
    got = {r["canonical_id"]: (r["root_id"], r["entry"], r["leave"], r["depth"], r["missing_parent_id"] if r["canonical_id"] == r["root_id"] else None) for r in intervals.tour(frame(spark, rows)).collect()}
    assert got == plain(rows)


def test_cycles(spark):
    got = {r["canonical_id"]: (r["cycle_id"], r["on_cycle"]) for r in intervals.cycles(frame(spark, forest())).collect()}
    assert got == {"c1": ("c1", True), "c2": ("c1", True), "c3": ("c1", True), "tail": ("c1", False), "tail2": ("c1", False), "self": ("self", True)}
    assert intervals.cycles(frame(spark, [("a", None, 0), ("b", "a", 1)])).collect() == []


def test_a_chain_of_five_thousand(spark):
    """No recursion and no cap: ancestors and replies of a post in the middle of a very deep thread."""
    rows = [(f"n{k}", f"n{k - 1}" if k else "gone", k) for k in range(5000)]
    began = time.time()
    threads = intervals.tour(frame(spark, rows)).cache()
    above = {r["canonical_id"]: r for r in intervals.ancestors(threads, "n4321").collect()}
    assert len(above) == 4322 and above["n0"]["distance"] == 4321 and above["n0"]["missing_parent_id"] == "gone" and above["n4321"]["distance"] == 0
    below = intervals.replies(threads, "n4321").orderBy("position").collect()
    assert [r["canonical_id"] for r in below] == [f"n{k}" for k in range(4322, 5000)] and [r["depth"] for r in below[:8]] == [1, 2, 3, 4, 5, 6, 6, 6]
    assert time.time() - began < 120  # seconds; some twenty on a free machine


def test_a_parent_of_very_many(spark):
    """Its children lie in several ranges, and follow each other all the same."""
    rows = [("top", None, 0)] + [(f"c{k:05d}", "top", k // 3) for k in range(6000)]
    children = intervals._siblings(frame(spark, rows).where("parent_id is not null").select("canonical_id", F.col("parent_id").alias("parent"), "created_at"), ("created_at", "canonical_id"))
    got = {r["canonical_id"]: r for r in children.collect()}
    assert [i for i in sorted(got) if got[i]["eldest"]] == ["c00000"] and all(got[f"c{k:05d}"]["sibling"] == (f"c{k + 1:05d}" if k < 5999 else None) for k in range(6000))


def test_growth_renumbers_touched_threads_only(spark, tmp_path):
    old = [("a", None, 1), ("b", "a", 2), ("x", None, 1), ("y", "x", 2), ("w", "later", 3), ("v", "w", 4)]
    fresh = [("c", "a", 1), ("later", None, 0), ("d", "c", 9), ("new", None, 5)]
    base = intervals.store(frame(spark, old), str(tmp_path / "s"))
    last = commits.publish(base, intervals.grown(base, frame(spark, old + fresh), frame(spark, fresh)))
    got = {r["canonical_id"]: (r["root_id"], r["entry"], r["leave"], r["depth"]) for r in last.read("threads").collect()}
    assert got == {i: v[:4] for i, v in plain(old + fresh).items()}
    mine = {str(r["part"]) for r in last.read("threads").where("root_id in ('a', 'later', 'w', 'new')").select("part").distinct().collect()}
    changed = {k for k in {*base.parts("threads"), *last.parts("threads")} if base.parts("threads").get(k) != last.parts("threads").get(k)}
    assert changed <= mine | {str(r["part"]) for r in base.read("threads").where("root_id = 'w'").collect()}
    assert intervals.grown(last, frame(spark, old + fresh), frame(spark, [])) == {}


def test_context_by_intervals(spark):
    now = 1_800_000_000
    rows = [("r", None, now - 50), ("m", "r", now - 40), ("p", "m", now - 30), ("q", "p", now - 20), ("o", "p", now - 25), ("z", "q", now - 10)]
    posts = frame(spark, rows).withColumn("text", F.lit("x"))
    by = [[[r["canonical_id"] for r in part.collect()] for part in feeds.context(posts, "p", now, threads)] for threads in (None, intervals.tour(posts))]
    assert by[0] == by[1] == [["r", "m"], ["p"], ["o", "q", "z"]]
