"""Vectors: norms, mean pooling, exact cosine top-k, token-budget chunks, and incremental generations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .window import eligible

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / (norm(a) + EPSILON))


#: Texts that are Python objects at a time.
SLICE = 256
#: Anchors and vectors that meet in one task; anchors whose products are there at a time.
ANCHORS, MEMBERS, AT_ONCE = 4096, 16_384, 64


def top_k(vectors: DataFrame, anchors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor, id, rank, cosine): the k nearest of every anchor but itself; ties by id.

    The anchors are the stated query set. Both sides are dealt over groups of about ANCHORS and MEMBERS rows, each pair of which is one
    task's product of matrices that hands on k rows an anchor: bounded in memory, and no row of one side meets another in the JVM.
    All vectors must have one length, without nulls.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = anchors.select(F.col(id_col).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v")).where("anchor is not null and v is not null")
    pa_, pm = (-(-side.count() // most) or 1 for side, most in ((anchors, ANCHORS), (vectors, MEMBERS)))
    dealt = lambda side, key, own, n, other, m: side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = dealt(asked, "anchor", "pa", pa_, "pm", pm), dealt(rows, "id", "pm", pm, "pa", pa_)
    kind, at_once = rows.schema["id"].dataType.simpleString(), AT_ONCE

    def matrix(table: pa.Table) -> np.ndarray:
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        own, other, kinds = a.column("anchor"), b.sort_by("id").column("id"), [a.schema.field("anchor").type, b.schema.field("id").type]
        who, whom, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            x, y = matrix(a), matrix(b.sort_by("id"))  # of ties the first ones have the smallest ids
            names, others = own.to_numpy(), other.to_numpy()
            for start in range(0, a.num_rows, at_once):
                for i, c in enumerate(x[start : start + at_once] @ y.T, start):
                    c[(others == names[i]) | np.isnan(c)] = -np.inf
                    least = np.partition(c, len(c) - k)[len(c) - k] if len(c) > k else -np.inf
                    some = np.flatnonzero((c >= least - 2e-9) & (c > -np.inf))
                    kept = some[np.argsort(-np.round(c[some], 9), kind="stable")[:k]]
                    who.append(np.full(len(kept), i))
                    whom.append(kept)
                    cosines.append(c[kept])
        columns = [side.take(pa.array(np.concatenate(at))).cast(kind) for side, at, kind in zip((own, other), (who, whom), kinds)]
        return pa.table([*columns, pa.array(np.concatenate(cosines))], ["anchor", "id", "cosine"])

    found = left.groupBy("pa", "pm").cogroup(right.groupBy("pa", "pm")).applyInArrow(run, f"anchor {kind}, id {kind}, cosine double")
    order = Window.partitionBy("anchor").orderBy(F.desc(F.round("cosine", 9)), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("anchor", "id", "rank", "cosine")


def norms(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, n, least, most, finite): checks on a generation of vectors."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(by, norm(v).alias("norm"), (~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("finite"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.bool_and("finite").alias("finite"))


def mean_pool(chunks: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, dim, value): mean of unit vectors, made a unit vector again; one row a dimension."""
    rows = chunks.select(by, F.posexplode(unit(F.col(vector_col).cast("array<double>"))).alias("dim", "x"))
    means = rows.groupBy(by, "dim").agg(F.avg("x").alias("mean"))
    length = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy(by)))
    return means.select(by, F.col("dim").cast("long").alias("dim"), (F.col("mean") / (length + EPSILON)).alias("value"))


def reuse(old: DataFrame, new: DataFrame, fingerprint_same: bool = True) -> DataFrame:
    """(canonical_id, text_sha256, status): reused where id and text hash are in the old generation, else todo."""
    hashed = new.select("canonical_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    known = old.select("canonical_id", "text_sha256").distinct().withColumn("known", F.lit(fingerprint_same))
    return hashed.join(known, ["canonical_id", "text_sha256"], "left").select(
        "canonical_id", "text_sha256", F.when(F.coalesce("known", F.lit(False)), "reused").otherwise("todo").alias("status")
    )


def token_chunks(text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], budget: int = 254) -> list[str]:
    """Pieces of at most ``budget`` tokens each when encoded again, as long as bisection finds them.

    Decoding a part of the tokens may give a text of more tokens; the part is then split in the middle. One token that
    does so is an error.
    """

    def pieces(ids: list[int]) -> list[str]:
        text = decode(ids)
        if not ids or len(encode(text)) <= budget:
            return [text]
        if len(ids) == 1:
            raise ValueError(f"a single token comes back as more than {budget}")
        middle = len(ids) // 2
        return pieces(ids[:middle]) + pieces(ids[middle:])

    ids = encode(text)
    return [p for i in range(0, max(1, len(ids)), budget) for p in pieces(ids[i : i + budget])]


def budget_check(chunks: DataFrame, encode: Callable[[str], list[int]], budget: int = 254) -> DataFrame:
    """(n, most): how many chunks (text) there are and the most tokens of any; more than ``budget`` raises."""
    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array((len(encode(t.as_py() or "")) for t in texts), pa.int64())

    counted = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(tokens("text")), F.lit(0)).alias("most"))
    fault = F.concat(F.lit("a chunk has "), F.col("most").cast("string"), F.lit(f" tokens, more than {budget}"))
    return counted.withColumn("most", F.when(F.col("most") > budget, F.raise_error(fault).cast("long")).otherwise(F.col("most")))


def corpus(posts: DataFrame, now: int) -> DataFrame:
    """(canonical_id, source, source_id, text, created_at) of the window in the canonical order of source and id; a null text is empty."""
    rows = eligible(posts, now).select("canonical_id", "source", "source_id", F.coalesce("text", F.lit("")).alias("text"), "created_at")
    return rows.orderBy("source", "source_id")


def chunked(posts: DataFrame, encode: Callable, decode: Callable, budget: int = 254) -> DataFrame:
    """(canonical_id, chunk, text) in Arrow batches; the tokenizer is any pair of callables."""
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        kind, parts = pa.list_(pa.string()), range(0, len(texts), SLICE)
        made = [pa.array([token_chunks(t or "", encode, decode, budget) for t in texts.slice(k, SLICE).to_pylist()], kind) for k in parts]
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return posts.select("canonical_id", F.posexplode(split("text")).alias("chunk", "text"))


def refresh(old: DataFrame | None, posts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next generation (canonical_id, text_sha256, embedding): reused rows, and ``embed`` of the rest by id."""
    if old is None:
        fresh = posts.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
        return embed(fresh).join(fresh.select("canonical_id", "text_sha256"), "canonical_id").select("canonical_id", "text_sha256", "embedding")
    plan = reuse(old, posts)
    kept = old.join(plan.where("status = 'reused'").select("canonical_id", "text_sha256"), ["canonical_id", "text_sha256"]).select("canonical_id", "text_sha256", "embedding")
    todo = posts.join(plan.where("status = 'todo'").select("canonical_id", "text_sha256"), "canonical_id")
    return kept.unionByName(embed(todo).join(todo.select("canonical_id", "text_sha256"), "canonical_id").select("canonical_id", "text_sha256", "embedding"))
