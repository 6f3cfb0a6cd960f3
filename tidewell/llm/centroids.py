"""Centroid clustering on exact integers, with Hamerly's bounds.

Each vector keeps two numbers beside its cluster: an upper bound of the distance to its centroid and a
lower bound of the distance to the second nearest one.  A round loosens them by how far centroids drifted
(the upper one by the own centroid's drift, the lower one by the largest drift among the others).  While
the upper bound stays strictly below the lower one, or below half the distance from the centroid to its
nearest neighbour, the assignment can't have changed, not even by a tie.  Else the upper bound is made
exact, and where that isn't enough the vector gets a full scan of all centroids in integers, ties to the
smaller number.  Bounds are doubles rounded outwards, so that they only ever decide what is certain.

The state is a table in the shared folder, written once a round; the one before is removed.  Centroids
move by exact integer sums, to which a round only adds what changed its cluster: a task shuffles, and the
driver holds, k * (dims + 1) numbers at most, whatever the input.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out;
a null id can only start as a centroid where fewer than k others are kept; rows that share an id each
count, and the smaller vector comes first among them; fewer than k vectors give as many centroids;
components of 2**27 or more after scaling raise an OverflowError; an empty table gives an empty result;
columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import matrix, rounded, usable
from .shared import discard, settle, stored

CENTROIDS, ROUNDS, SCALE, DIMS = 40, 5, 256, 64
#: Rows that a full scan takes at once.
SCAN_ROWS = 2048
#: Relative room for the rounding of a few operations on doubles.
ROOM = 2.0**-48


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``y``, or to one vector."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def at_most(d2: np.ndarray) -> np.ndarray:
    """Doubles not below the roots of exact integers."""
    return np.sqrt(d2.astype(np.float64)) * (1 + ROOM)


def at_least(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - ROOM)


@dataclass
class Centroids:
    """Positions, how far each may have drifted, the largest drift of the others, and half the distance to the nearest other one."""

    at: np.ndarray
    drift: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def moved(cls, at: np.ndarray, before: np.ndarray) -> Centroids:
        drift = at_most(squared(at, before))
        others = np.array([max([0.0, *drift[:j], *drift[j + 1 :]]) for j in range(len(at))])
        half = np.full(len(at), np.inf)
        for j in range(len(at)):
            gaps = np.delete(squared(at, at[j]), j)
            if len(gaps):
                half[j] = 0.5 * at_least(gaps.min())
        return cls(at, drift, others, half)


def scan(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance, that of the second nearest) by integers; one centroid has no second."""
    best, first, second = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for i in range(0, len(x), SCAN_ROWS):
        own = slice(i, i + SCAN_ROWS)
        d2 = np.stack([squared(x[own], c) for c in at], axis=1)
        best[own] = d2.argmin(axis=1)  # the first of equals
        first[own] = d2[np.arange(len(d2)), best[own]]
        if len(at) > 1:
            d2[np.arange(len(d2)), best[own]] = np.iinfo(np.int64).max
            second[own] = d2.min(axis=1)
    return best, first, second


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, whether scanned) after the centroids moved."""
    cluster = cluster.copy()
    upper = (upper + c.drift[cluster]) * (1 + ROOM)
    lower = lower - c.others[cluster] - ROOM * (lower + c.others[cluster])
    safe = np.maximum(lower, c.half[cluster])
    unsure = np.flatnonzero(upper >= safe)
    upper[unsure] = at_most(squared(x[unsure], c.at[cluster[unsure]]))
    unsure = unsure[upper[unsure] >= safe[unsure]]
    best, first, second = scan(x[unsure], c.at)
    cluster[unsure], upper[unsure], lower[unsure] = best, at_most(first), at_least(second)
    scanned = np.zeros(len(x), dtype=bool)
    scanned[unsure] = True
    return cluster, upper, lower, scanned


def start(vectors: DataFrame, k: int, scale: int, dims: int, salt: str) -> np.ndarray:
    """The first ``k`` kept vectors by the hash of their ids."""
    ints = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.select(by_hash.alias("h"), ints.alias("ints")).orderBy(F.col("h").asc_nulls_last(), "ints").limit(k).collect()
    return np.array([r["ints"] for r in rows], dtype=np.int64).reshape(-1, dims)


def sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of what came to each cluster less what left it, exactly: tasks add up their rows, Spark the tasks' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for side, sign in ((1, 1), (2, -1)):
                to = batch.column(side).fill_null(-1).to_numpy()
                for c in np.unique(to[to >= 0]).tolist():
                    own = to == c
                    total[c, 0] += sign * int(own.sum())
                    total[c, 1:] += sign * x[own].sum(axis=0)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(total[c, i])], ["c", "i", "v"])
        settle()

    moved = state.where("was is null or was <> cluster").select("ints", "cluster", "was")
    out = np.zeros((k, dims + 1), np.int64)
    for r in moved.mapInArrow(run, "c long, i long, v long").groupBy("c", "i").agg(F.sum("v")).collect():  # k * (dims + 1) at most
        out[r[0], r[1]] = r[2]
    return out[:, 0], out[:, 1:]


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    scale: int = SCALE, dims: int = DIMS, salt: str = "2:",
) -> DataFrame:
    """Returns (id, cluster, distance, n_scans, cluster_inertia, inertia, centroid array<long>, centroid_sha256)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where(usable("vector", dims))
    at = start(rows, k, scale, dims, salt)
    k, kind = len(at), rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, ints array<int>, cluster int, was int, upper double, lower double, n_scans int"
    names = ["id", "ints", "cluster", "was", "upper", "lower", "n_scans"]

    def ints(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.reshape(-1).astype(np.int32)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rounded(batch.column(1), dims, scale)
            best, near, second = scan(x, at)
            none = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ints(x), pa.array(best.astype(np.int32)), none, pa.array(at_most(near)), pa.array(at_least(second)), pa.array(np.ones(len(x), np.int32))], names
            )
        settle()

    def following(c: Centroids, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, was = matrix(batch.column(1), dims), batch.column(2).to_numpy().astype(np.int64)
                now, upper, lower, scanned = assign(x, was, batch.column(4).to_numpy(), batch.column(5).to_numpy(), c)
                scans = batch.column(6).to_numpy() + scanned.astype(np.int32)
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(now.astype(np.int32)), pa.array(squared(x, c.at[now])), pa.array(scans)], ["id", "cluster", "distance", "n_scans"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now.astype(np.int32)), batch.column(2), pa.array(upper), pa.array(lower), pa.array(scans)], names)
            settle()

        return run

    if not k:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, n_scans int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    folder = f"clusters-{uuid.uuid4().hex}"
    state = stored(rows.mapInArrow(first, columns), f"{folder}/0.parquet")
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in range(1, rounds + 1):
        more, added = sums(state, k, dims)
        count, total = count + more, total + added
        before, at = at, at.copy()
        full = count > 0
        at[full] = total[full] // count[full, None]
        run = following(Centroids.moved(at, before), r == rounds)
        schema = f"id {kind}, cluster int, distance long, n_scans int" if r == rounds else columns
        state = stored(state.mapInArrow(run, schema), f"{folder}/{r}.parquet")
        discard(spark, f"{folder}/{r - 1}.parquet")

    wide = F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")
    by = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(wide.alias("s")).collect()}
    facts = [(j, by.get(j, 0), sum(by.values()), at[j].tolist(), hashlib.sha256(",".join(map(str, at[j].tolist())).encode()).hexdigest()) for j in range(k)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")  # k rows
    return state.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "n_scans", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
