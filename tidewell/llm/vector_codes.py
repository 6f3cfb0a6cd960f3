"""Product codes of vectors, with codebooks fitted on exact integers.

A part's nearest codebook entry is screened by one float32 matrix product for all entries, |c|^2 - 2 x.c.
The rounding error of every such value is bounded rigorously (conversion, products and sums in any order:
gamma(n) = n u / (1 - n u) times the sum of magnitudes, u = 2^-24), so each true value lies in an interval
around it. Entries whose interval lies wholly above the least upper end can't win; where more than one
remains these are computed again in int64, ties to the smaller index. Nothing is decided by rounding.

Rounds read the vectors only, without a shuffle of rows: each task returns one row of exact sums for each
entry it used, Spark adds them up, and the driver gets parts * entries rows whatever the input. The last
pass writes codes and errors to the shared folder once; sums by label come from there, and are joined back
by broadcast only if labels are few, else by a shuffle join that splits hot labels.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out;
fewer vectors than entries give as many entries; rows that share an id each count, the smaller vector first;
null ids come last; null labels are one label; components of 2**27 or more after scaling raise an
OverflowError; an empty table gives an empty result; columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import few, rounded, usable
from .shared import settle, stored

PARTS, ENTRIES, ROUNDS, SCALE, DIMS = 16, 64, 2, 256, 64
#: Labels whose sums may be broadcast.
FEW_LABELS = 100_000
#: Rows screened at once.
SCREEN_ROWS = 8192


def screen(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(float32 values of |c|^2 - 2 x.c for every row and entry, bound of each row's errors)."""
    n, width = x.shape
    c2 = np.einsum("ij,ij->i", book, book)
    left, right = np.ones((n, width + 1), np.float32), np.empty((width + 1, len(book)), np.float32)
    left[:, :width], right[:width], right[width] = x, -2 * book.T, c2
    value = left @ right
    longest = np.sqrt(c2.max().astype(np.float64))
    size = 2 * np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64)) * longest + longest * longest
    steps = (width + 4) * 2.0**-24  # two conversions, a product, width sums, and one to spare
    return value, steps / (1 - steps) * size * (1 + 1e-9)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, exact squared distance, how many rows needed integers); ties to the smaller index."""
    best, again = np.empty(len(x), np.int64), 0
    for i in range(0, len(x), SCREEN_ROWS):
        own = x[i : i + SCREEN_ROWS]
        value, error = screen(own, book)
        value = value.astype(np.float64)
        near = value <= (value.min(axis=1) + 2 * error)[:, None]
        found = near.argmax(axis=1)
        unsure = np.flatnonzero(near.sum(axis=1) > 1)
        if len(unsure):
            row, entry = np.nonzero(near[unsure])  # by row, then by index
            gap = own[unsure[row]] - book[entry]
            d2 = np.einsum("ij,ij->i", gap, gap)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(d2, first)
            hit = np.flatnonzero(d2 == least[row])
            _, at = np.unique(row[hit], return_index=True)  # the first of equals
            found[unsure] = entry[hit[at]]
            again += len(unsure)
        best[i : i + SCREEN_ROWS] = found
    gap = x - book[best]
    return best, np.einsum("ij,ij->i", gap, gap), again


def start(vectors: DataFrame, entries: int, scale: int, parts: int, dims: int) -> np.ndarray:
    """(part, entry, component): the first vectors by id, cut into parts."""
    ints = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select("id", ints.alias("ints")).orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    return np.array([r["ints"] for r in rows], dtype=np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)


def refit(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Each entry moved to the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.shape
    names = ["part", "entry", "n", *[f"v{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = rounded(batch.column(0), parts * width, scale).reshape(-1, parts, width)
            for p in range(parts):
                best, _, _ = nearest(x[:, p], books[p])
                count[p] += np.bincount(best, minlength=entries)
                np.add.at(total[p], best, x[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *[pa.array(total[part, entry, i]) for i in range(width)]], names)
        settle()

    used = vectors.select("vector").mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    books = books.copy()
    for r in used.collect():
        books[r["part"], r["entry"]] = np.array(r[3:], dtype=np.int64) // r["n"]
    return books


def decode(codes: list[bytes], books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    at = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1)


def quantise(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code binary, error long, label_error long), codebooks by part, entry, component)."""
    if dims % parts or entries > 256:
        raise ValueError("dims must be a multiple of parts, and entries at most 256")
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").alias("label")
    ).where(usable("vector", dims))
    books = start(rows, entries, scale, parts, dims)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    if not books.size:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kinds['id']}, label {kinds['label']}, code binary, error long, label_error long"), books
    for _ in range(rounds):
        books = refit(rows, books, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rounded(batch.column(2), dims, scale).reshape(-1, parts, dims // parts)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], d2, _ = nearest(x[:, p], books[p])
                error += d2
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(x), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error)], ["id", "label", "code", "error"])
        settle()

    coded = stored(rows.select("id", "label", "vector").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, error long"), f"codes-{uuid.uuid4().hex}.parquet")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = stored(sums, f"code-sums-{uuid.uuid4().hex}.parquet")
    if few(sums, FEW_LABELS):
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "label", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
