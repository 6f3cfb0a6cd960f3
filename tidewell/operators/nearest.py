"""Exact nearest neighbours of very many anchors: cells around centres, and the triangle inequality on angles.

Angles between vectors are a metric. Vectors lie in the cell of the nearest of some centres, each with its angle to it. An anchor first
meets its own cell, which gives an upper bound t of the angle to its k-th neighbour; a cell whose centre lies further than
t + radius can't hold a nearer one, and of the cells that may, only vectors in the ring |angle to the centre - anchor's angle| <= t are compared.
All results are exact; how much is spared depends on how the vectors cluster, and is counted (``pairs``).

Cells lie in bins of about GROUP vectors. An anchor goes to each bin that has a cell for it once, and there meets the cells. Bins of many vectors, and many anchors
for one bin, are dealt over groups of GROUP rows a side: n vectors are sent n / GROUP times at most as anchors, and as often as members. What is broadcast are the centres,
CENTRES at most.

Edge cases: vectors that are null, zero, or hold null or non-finite components have no neighbours and are nobody's; all vectors must have one length;
ids that repeat are neighbours of each other; fewer than k others give as many; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import checkpoint_dir

CENTRES = 256
#: Rows of a group, and bins of cells at least where groups would be few.
GROUP, BINS = 65_536, 12
#: Anchors that meet a cell at a time.
ANCHORS = 128
#: Room for the rounding of angles: that of arc cosines near zero.
ROOM = 1e-7
FOUND = "anchor {id}, id {id}, cosine double, pairs long"


def _fine(vector: str):
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def celled(vectors: DataFrame, id_col: str, vector_col: str, centres: int = CENTRES) -> tuple[DataFrame, np.ndarray]:
    """((id, unit, cell, angle) of the usable vectors, kept in the checkpoint folder; the centres)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(_fine("v"))
    picked = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(centres).collect()], dtype=np.float64)
    kind = rows.schema["id"].dataType.simpleString()
    if len(picked):
        picked /= np.linalg.norm(picked, axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), batch.num_rows)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            angle = _angles(x, picked)
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(x)), cell])], ["id", "unit", "cell", "angle"])

    checkpoint_dir(vectors.sparkSession)
    return rows.mapInArrow(run, f"id {kind}, unit array<double>, cell int, angle double").checkpoint(), picked


def _dealt(rows: DataFrame, key: str, groups: Column, own: str, other: Column) -> DataFrame:
    """Rows in one group of their own side, a copy for each group of the other side."""
    return rows.withColumn("own", F.pmod(F.xxhash64(key), groups).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1))).withColumnsRenamed(
        {"own": own, "other": "pm" if own == "pa" else "pa"}
    )


def _best(who: np.ndarray, cosine: np.ndarray, whom: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k best of their anchor: by rounded cosine, ties by the member's number."""
    order = np.lexsort((whom, -np.round(cosine, 9), who))
    own = who[order]
    starts = np.flatnonzero(np.r_[True, np.diff(own) != 0]) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)])) < k]


def _meet(anchors: DataFrame, members: DataFrame, k: int, kind: str, at: np.ndarray, radii: np.ndarray, home: bool) -> DataFrame:
    """The k best members that each anchor (anchor, unit, cell, reach) finds in a bin of cells: its own cell (``home``), or all others.

    ``reach`` is the angle that a neighbour may have at most. Both sides have ``bin``. In a task some anchors of near cells meet one cell after
    the other, as a product of matrices, if one of them may find a nearer one there, and of the cell the members in their rings.
    """
    sizes = members.groupBy("bin").agg(F.count(F.lit(1)).alias("m")).join(anchors.groupBy("bin").agg(F.count(F.lit(1)).alias("a")), "bin")
    sizes = F.broadcast(sizes.select("bin", *[F.ceil(F.col(c) / GROUP).cast("int").alias(f"n{c}") for c in "ma"]))  # a row a bin, CENTRES at most
    left = _dealt(anchors.join(sizes, "bin"), "anchor", F.col("na"), "pa", F.col("nm")).select("bin", "pa", "pm", "anchor", "unit", "cell", "reach")
    right = _dealt(members.join(sizes, "bin"), "id", F.col("nm"), "pm", F.col("na")).select("bin", "pa", "pm", "id", "unit", "cell", "angle")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from the same rows

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds, names, pairs, out = b.schema.field("id").type, ["anchor", "id", "cosine", "pairs"], 0, []
        if a.num_rows and b.num_rows:
            a, b = a.sort_by([("cell", "ascending"), ("reach", "ascending")]), b.sort_by([("cell", "ascending"), ("angle", "ascending")])
            x, y = _matrix(a.column("unit"), a.num_rows), _matrix(b.column("unit"), b.num_rows)
            ids = b.column("id").combine_chunks()
            known = ids.unique().sort()
            number = lambda v: pc.fill_null(pc.index_in(v, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731  in the order of ids
            whom, self_ = number(ids), number(a.column("anchor").combine_chunks())
            by_number = np.argsort(whom, kind="stable")
            cells, starts = np.unique(b.column("cell").to_numpy(), return_index=True)
            ends, ring = np.r_[starts[1:], len(y)], b.column("angle").to_numpy()
            cell, reach = a.column("cell").to_numpy(), a.column("reach").to_numpy()
            for first in range(0, len(x), ANCHORS):
                own = slice(first, first + ANCHORS)
                to = _angles(x[own], at[cells])
                same = cell[own, None] == cells[None]
                near = same if home else ~same & (to - radii[cells][None] <= reach[own, None] + ROOM)
                least = np.where(reach[own] < np.pi, np.cos(np.minimum(reach[own], np.pi) + ROOM) - 1e-9, -2.0)
                none = np.zeros(0, np.int64)
                held = (none, np.zeros(0), none)
                lows, highs = np.searchsorted(whom[by_number], self_[own]), np.searchsorted(whom[by_number], self_[own], "right")
                lows = np.where(self_[own] < 0, highs, lows)
                selves = np.stack([np.repeat(np.arange(len(lows)), highs - lows), by_number[np.concatenate([np.arange(p, q) for p, q in zip(lows, highs)]).astype(np.int64)]])
                for c in np.flatnonzero(near.any(axis=0)).tolist():
                    some = np.flatnonzero(near[:, c])
                    part = ring[starts[c] : ends[c]]
                    low = int(starts[c] + np.searchsorted(part, (to[some, c] - reach[own][some]).min() - ROOM))
                    high = int(starts[c] + np.searchsorted(part, (to[some, c] + reach[own][some]).max() + ROOM, "right"))
                    for low in range(low, high, GROUP // 4):
                        to_ = min(low + GROUP // 4, high)
                        cosine = x[own][some] @ y[low:to_].T
                        pairs += cosine.size
                        place = np.full(len(near), -1)
                        place[some] = np.arange(len(some))
                        mine = selves[:, (place[selves[0]] >= 0) & (selves[1] >= low) & (selves[1] < to_)]
                        cosine[place[mine[0]], mine[1] - low] = -3.0
                        if to_ - low >= k and (least[some] == -2.0).any():
                            least[some] = np.maximum(least[some], np.partition(cosine, to_ - low - k, axis=1)[:, to_ - low - k] - 1e-9)
                        i, j = np.nonzero(cosine >= np.maximum(least[some], -2.0)[:, None])
                        if len(i):
                            held = tuple(np.concatenate(h) for h in zip(held, (some[i], cosine[i, j], low + j)))
                            kept = _best(held[0], held[1], whom[held[2]], k)
                            held = tuple(h[kept] for h in held)
                            full = np.flatnonzero(np.bincount(held[0], minlength=len(near)) == k)
                            worst = np.full(len(near), 3.0)
                            np.minimum.at(worst, held[0], held[1])
                            least[full] = np.maximum(least[full], worst[full] - 1e-9)
                out.append((first + held[0], held[2], held[1]))
        who, found, cosine = (np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in range(3))
        take = lambda t, c, n: t.column(c).combine_chunks().take(pa.array(n.astype(np.int64)))
        rows = [pa.concat_arrays([take(a, "anchor", who), pa.nulls(1, kinds)]), pa.concat_arrays([take(b, "id", found), pa.nulls(1, kinds)])]
        return pa.table([*rows, pa.array(np.r_[cosine, np.nan]), pa.array(np.r_[np.zeros(len(who), np.int64), pairs])], names)  # the last row has the pairs

    key = ["bin", "pa", "pm"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND.format(id=kind))


def top_k(vectors: DataFrame, anchors: DataFrame | None, k: int, id_col: str = "vec_id", vector_col: str = "embedding", centres: int = CENTRES) -> tuple[DataFrame, DataFrame]:
    """((anchor, id, rank, cosine): the k nearest of every anchor but itself; (pairs): how many pairs were compared).

    ``anchors`` (id): the rows of ``vectors`` to ask for; None: all of them.
    """
    rows, at = celled(vectors, id_col, vector_col, centres)
    kind = rows.schema["id"].dataType.simpleString()
    cells = {r["cell"]: r for r in rows.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    radii = np.array([cells[c]["r"] if c in cells else -10.0 for c in range(len(at))])
    # Bins of cells, so that an anchor is sent to each bin at most, not to each cell.
    total, before, bins = sum(r["n"] for r in cells.values()), 0, []
    for c in range(len(at)):
        bins.append(min(BINS - 1, before * BINS // max(1, total)) if total < GROUP * BINS else before // GROUP)
        before += cells[c]["n"] if c in cells else 0
    spot = np.array(bins, dtype=np.int32)
    binned = F.element_at(F.array(*map(F.lit, bins)), F.col("cell") + 1) if bins else F.lit(0)
    asked = rows if anchors is None else rows.join(anchors.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    asked = asked.withColumnRenamed("id", "anchor")
    members = rows.select("id", "unit", "cell", "angle")
    first = asked.select("anchor", "unit", "cell", F.lit(4.0).alias("reach"), F.col("cell").alias("bin"))
    home = _meet(first, members.withColumn("bin", F.col("cell")), k, kind, at, radii, True).checkpoint()
    order = Window.partitionBy("anchor").orderBy(F.desc(F.round("cosine", 9)), F.asc("id"))
    best = home.where("id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("anchor", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))).alias("reach"))
    asked = asked.join(best, "anchor", "left").select("anchor", "unit", "cell", F.coalesce("reach", F.lit(4.0)).alias("reach"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(start, ANCHORS)
                x, cell, reach = _matrix(batch.column(1), batch.num_rows), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                near = (_angles(x, at) - radii[None] <= reach[:, None] + ROOM) & (radii >= 0)[None]
                near[np.arange(len(x)), cell] = False
                i, b = np.nonzero(np.stack([near[:, spot == n].any(axis=1) for n in range(spot.max() + 1)], axis=1))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(i)) for c in batch.columns], pa.array(b.astype(np.int32))], ["anchor", "unit", "cell", "reach", "bin"])

    away = asked.mapInArrow(others, f"anchor {kind}, unit array<double>, cell int, reach double, bin int") if len(at) else first
    found = home.unionByName(_meet(away, members.withColumn("bin", binned), k, kind, at, radii, False)).checkpoint()
    ranked = found.where("id is not null").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("anchor", "id", "rank", "cosine"), found.agg(F.sum("pairs").alias("pairs"))
