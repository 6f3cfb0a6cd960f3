"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A table rotates every unit vector by ROUNDS of random signs and a fast Hadamard transform and hashes
it to the nearest vertex of the cross-polytope: the coordinate of the largest magnitude and its sign,
one after another for as many rotations as the largest label needs.  Multiprobe adds the buckets
reached by taking the second best vertex in one place.  Vectors that share a bucket are verified by
their cosine in double precision; a pair that meets in several buckets counts in the one with the
smallest code only, so counts add up without a list of pairs.

Equal vectors are one vertex with a weight.  Buckets too large for a task are cut into parts that
meet pairwise; nothing is capped.  A bucket returns its vectors' weighted counts and a forest of its
links, not pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label or id, link with nothing; vectors of different lengths don't link; repeated ids are
separate vertices only if their vectors differ; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut

COSINE = 0.98
TABLES, ROUNDS, SEED = 5, 3, 7
#: Vectors of a label in a bucket that one more rotation a table is meant for.
BUCKET_ROWS = 64
#: Vectors of one bucket compared in one task; larger buckets are cut into parts of half of it.
TOGETHER = 2000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    width = 1
    while width < d:
        x = x.reshape(n, d // (2 * width), 2, width)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        width *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def vertices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest vertex of the cross-polytope: 2 * coordinate + (1 if negative)."""
    two = np.argpartition(-np.abs(x), 1, axis=1)[:, :2] if x.shape[1] > 2 else np.argsort(-np.abs(x), axis=1)[:, :2]
    rows = np.arange(len(x))
    swap = np.abs(x[rows, two[:, 0]]) < np.abs(x[rows, two[:, -1]])
    best, second = np.where(swap, two[:, -1], two[:, 0]), np.where(swap, two[:, 0], two[:, -1])
    return tuple(2 * c + (x[rows, c] < 0) for c in (best, second))


def codes(unit: np.ndarray, depth: int) -> np.ndarray:
    """Bucket numbers of each row: TABLES * (1 + depth) of them, the probes beside the main bucket."""
    n, d = unit.shape
    padded = np.zeros((n, max(2, 1 << (d - 1).bit_length())))
    padded[:, :d] = unit
    out = []
    for t in range(TABLES):
        found = [vertices(rotate(padded, SEED + 1000 * t + k)) for k in range(depth)]
        for swapped in range(-1, depth):
            code = np.full(n, t, dtype=np.int64)
            for k, (best, second) in enumerate(found):
                code = code * (2 * padded.shape[1]) + (second if k == swapped else best)
            out.append(code)
    return np.stack(out, axis=1)


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of each of n vertices' component, for the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(table: pa.Table, cosine: float, kind: str, depth: int) -> pa.Table:
    """Rows (code, pair, side, rep, label, weight, vector) of some buckets -> (a, b, n): links, and counts where b is null.

    Codes don't travel with the vectors: those of linked vectors are computed again.
    """
    a, b, n = [], [], []
    pair = table.column("pair").to_numpy()
    rep = table.column("rep").to_numpy()
    order = np.lexsort((rep, pair))
    table = table.take(pa.array(order))
    pair, rep = pair[order], rep[order]
    code, side, weight = (table.column(c).to_numpy() for c in ("code", "side", "weight"))
    label, size = table.column("label").to_numpy(), np.array([len(v) for v in table.column("vector").to_pylist()])
    vectors = table.column("vector").to_pylist()
    bounds = np.flatnonzero(np.append(True, (np.diff(pair) != 0))).tolist() + [len(pair)]
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i < 2:
            continue
        for dim in np.unique(size[i:j]).tolist():  # one, but for clashes of codes
            at = np.flatnonzero(size[i:j] == dim) + i
            x = _unit([vectors[k] for k in at.tolist()], kind)
            two = side[at].any()
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start in range(0, len(at), 256):
                near = x[start : start + 256] @ x.T >= cosine
                p, q = np.nonzero(near)
                p = p + start
                keep = (p < q) & (label[at[p]] == label[at[q]])
                if two:
                    keep &= side[at[p]] != side[at[q]]
                left.append(p[keep])
                right.append(q[keep])
            p, q = np.concatenate(left), np.concatenate(right)
            if not len(p):
                continue
            root = forest(p, q, len(at))
            moved = np.flatnonzero(root != np.arange(len(at)))
            a.append(rep[at[moved]])
            b.append(rep[at[root[moved]]])
            n.append(np.zeros(len(moved), np.int64))
            linked, place = np.unique(np.concatenate([p, q]), return_inverse=True)
            own, short = codes(x[linked], depth), np.split(place, 2)
            here = np.zeros(len(p), dtype=bool)
            for s in range(0, len(p), 1 << 16):
                cp, cq = own[short[0][s : s + (1 << 16)]], own[short[1][s : s + (1 << 16)]]
                common = np.zeros(cp.shape, dtype=bool)
                for c in range(cq.shape[1]):
                    common |= cp == cq[:, c : c + 1]
                here[s : s + (1 << 16)] = np.where(common, cp, np.iinfo(np.int64).max).min(axis=1) == code[at[p[s : s + (1 << 16)]]]
            p, q = p[here], q[here]
            count = np.bincount(p, weights=weight[at[q]], minlength=len(at)) + np.bincount(q, weights=weight[at[p]], minlength=len(at))
            some = np.flatnonzero(count)
            a.append(rep[at[some]])
            b.append(np.full(len(some), -1))
            n.append(count[some].astype(np.int64))
    none = np.zeros(0, np.int64)
    a, b, n = (np.concatenate([none, *v]) for v in (a, b, n))
    linked = np.concatenate([none == 0, n == 0])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=~linked), "n": pa.array(n, pa.int64())})


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Returns (id, n_links, component_id, kept)."""
    v = F.col("v")
    wide = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    kind, array = ("<f8", "array<double>") if wide else ("<f4", "array<float>")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(array).alias("v"), F.col(label_col).cast("long").alias("label")).withColumn("fine", fine)
    same = ["label", "h1", "h2"]
    valid = rows.where("fine").select("id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), F.reverse("v")).alias("h2"))
    alike = valid.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    largest = alike.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    width = valid.select(F.max(F.size("v"))).first()[0] or 1
    depth = 1
    while largest / float(2 * width) ** depth > BUCKET_ROWS:
        depth += 1
    distinct = alike.join(valid.withColumnRenamed("id", "rep"), [*same, "rep"]).dropDuplicates([*same, "rep"]).select("rep", "label", "weight", "v")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x, dtype=kind).tobytes() for x in batch.column("v").to_pylist()]
            found: list[list[int]] = [[]] * len(packed)
            for dim in {len(p) for p in packed}:
                at = [k for k, p in enumerate(packed) if len(p) == dim]
                own = codes(_unit([packed[k] for k in at], kind), depth)
                for k, c in zip(at, own.tolist()):
                    found[k] = c
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("label"), batch.column("weight"), pa.array(found, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["rep", "label", "weight", "bare", "vector"],
            )

    coded = cut(distinct.mapInArrow(hashed, "rep long, label long, weight long, bare array<long>, vector binary"))
    bucket = F.xxhash64("label", F.octet_length("vector"), "code").alias("bucket")
    placed = coded.withColumn("code", F.explode(F.array_distinct("bare"))).select("*", bucket).drop("bare")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    parts = F.when(F.col("many") > TOGETHER, F.ceil(F.col("many") / (TOGETHER // 2))).otherwise(1).cast("int")
    met = placed.join(sizes, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("low"), F.greatest("part", o).alias("high")))
    dealt = met.withColumn("cell", F.explode(others)).select(
        "code", F.xxhash64("bucket", "cell.low", "cell.high").alias("pair"),
        ((F.col("cell.low") != F.col("cell.high")) & (F.col("part") == F.col("cell.high"))).cast("int").alias("side"),
        "rep", "label", "weight", "vector",
    )
    buckets = max(1, int((sizes.agg(F.sum("many")).first()[0] or 0) / 4000))
    found = cut(dealt.withColumn("bucket", F.pmod("pair", F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(lambda t: verify(t, cosine, kind, depth), "a long, b long, n long"))
    reached = components(found.where("b is not null").select("a", "b"))
    counted = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    final = alike.join(counted, "rep", "left").join(reached.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        *same, "rep", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    linked = valid.select("id", *same).join(final, same).select("id", "n_links", "component")
    loose = rows.where(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(loose).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )
