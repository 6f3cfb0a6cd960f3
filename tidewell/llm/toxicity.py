"""Toxicity by multiple-instance learning: documents carry the labels, sentences carry the scores.

A sentence's score is a logistic regression over its words and their beginnings, as 64-bit hashes; only
features that tell of label 1 are known to the model, and a sentence without one scores 0. A
document's score is the noisy-or of its sentences, 1 - prod(1 - p).  Only document labels are needed to
train: the gradient of the document's loss flows to the sentences that explain it.  The trained sentence
scores then locate the offending sentences.

The model is fitted on the whole texts of a bounded, stratified sample of labelled documents (at most
MOST_TOXIC of label 1 and MOST_CLEAN of label 0, drawn by a hash of the id). Executors count their
features and send the driver the known ones of each sentence, equal sentences of a document as one with
their number; scoring covers every whole text in one pass without a shuffle, the model travelling with
the task.

Edge cases: a null or empty text has no sentence and scores 0; without any positive training label
every score is 0; rows with a null label or null id are not trained on; of documents that share an id one is trained on,
of its labels the larger; repeated rows score alike;
an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, settle
from .textscan import CHUNK_BYTES, Words, chunks, mix, texts

MOST_TOXIC, MOST_CLEAN = 2_000, 3_000
THRESHOLD = 0.3
EPOCHS, RATE, L2 = 1_000, 0.3, 1e-4
#: Hashes are first looked up by so many of their bits.
SIEVE_BITS = 18
#: A feature is used if so many sampled documents have it and its share differs between the labels with this chi-square.
LEAST_DOCS, LEAST_CHI2 = 4, 15.0
#: Besides whole words, their first bytes are features, which catches inflected forms.
PREFIXES = (4, 5)

_STRIP = np.zeros(256, dtype=bool)
_STRIP[list(b".,;:!?\"'()[]{}*#$%&<>|")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    """``known``: hashes of the features, ascending; ``weight``: one each."""

    known: np.ndarray
    weight: np.ndarray
    bias: float


@dataclass
class Sentences:
    """Known features (their places in ``known``) by sentence, and the sentences' rows and bytes."""

    feature: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features with the sentences that hold them, and the sentences' rows, starts and ends.

    Sentences end after . ! ? or a newline, or where the text ends; features are words without outer marks, letters lowered.
    """
    words = Words(offsets, data)
    n = len(words.start)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, none
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):  # up to three marks a side
        move = (start < end) & _STRIP[data[np.minimum(start, len(data) - 1)]]
        start[move] += 1
        move = (start < end) & _STRIP[data[end - 1]]
        end[move] -= 1
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    first = np.ones(n, dtype=bool)
    first[1:] = (words.row[1:] != words.row[:-1]) | (stops[words.start[1:]] > stops[words.start[:-1]])
    sentence = np.cumsum(first) - 1
    bare = Words.__new__(Words)
    bare.start, bare.end = start, end
    where = [np.flatnonzero(start < end)]
    parts = [bare.hashes(data, lower=True)[where[0]]]
    for size in PREFIXES:
        bare.end = np.minimum(start + size, end)
        where.append(np.flatnonzero(end - start > size))
        parts.append(mix(bare.hashes(data, lower=True)[where[-1]] + np.uint64(size)))
    begins = np.flatnonzero(first)
    last = np.append(begins[1:], n) - 1
    return np.concatenate(parts), sentence[np.concatenate(where)], words.row[begins], words.start[begins], words.end[last]


def split(offsets: np.ndarray, data: np.ndarray, known: np.ndarray) -> Sentences:
    """The sentences that hold a known feature; a feature counts once a sentence."""
    h, holder, row, start, end = features(offsets, data)
    if len(known):
        sieve, shift = np.zeros(1 << SIEVE_BITS, dtype=bool), np.uint64(64 - SIEVE_BITS)
        sieve[known >> shift] = True
        maybe = np.flatnonzero(sieve[h >> shift])
        h, holder = h[maybe], holder[maybe]
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[place] == h
        both = np.unique(holder[hit] * len(known) + place[hit])
    else:
        both = np.zeros(0, dtype=np.int64)
    feature, holder = both % max(1, len(known)), both // max(1, len(known))
    held, sentence = np.unique(holder, return_inverse=True)
    return Sentences(feature, sentence, row[held], start[held], end[held])


def logits(s: Sentences, model: Model) -> np.ndarray:
    return np.bincount(s.sentence, weights=model.weight[s.feature], minlength=len(s.row)) + model.bias


def noisy_or(s: Sentences, z: np.ndarray, rows: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) by row; rows without a sentence get 0."""
    return -np.expm1(-np.bincount(s.row, weights=np.logaddexp(0.0, z), minlength=rows)) + 0.0


def telling(have: Column, toxic: Column, n: int, ones: int) -> Column:
    """Whether a feature tells of label 1: chi-square of (document has it, label), with Yates' correction, of features commoner there.

    ``have`` and ``toxic``: documents, and documents of label 1, with the feature, of ``n`` and ``ones``.
    """
    expected = have * (ones / n)
    variance = expected * (1 - ones / n) * (n - have) / max(1, n - 1)
    gap = F.greatest(F.lit(0.0), toxic - expected - 0.5)
    return (have >= LEAST_DOCS) & (gap * gap > LEAST_CHI2 * F.greatest(variance, F.lit(1e-9)))


def holders(sample: DataFrame) -> DataFrame:
    """(h, have, toxic): documents, and documents of label 1, of (id, y, text) that hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, j, offsets, data in chunks(texts(batch.column(2))):
                h, holder, row, _, _ = features(offsets, data)
                order = np.lexsort((row[holder], h))
                h, at = h[order], row[holder][order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
                h, place = np.unique(h[new], return_inverse=True)
                have = np.bincount(place, minlength=len(h))
                toxic = np.bincount(place, weights=y[i:j][at[new]], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(have), pa.array(toxic)], ["h", "have", "toxic"])
        settle()

    counts = sample.select("id", "y", "text").mapInArrow(run, "h long, have long, toxic long")
    return counts.groupBy("h").agg(F.sum("have").alias("have"), F.sum("toxic").alias("toxic"))


def bags(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, y, times, sizes, features): the distinct sets of known features that a document's sentences hold, and how many hold each."""
    kind = sample.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in chunks(texts(batch.column(2))):
                s = split(offsets, data, known)
                found: list[dict[bytes, int]] = [{} for _ in range(j - i)]
                bounds = np.searchsorted(s.sentence, np.arange(len(s.row) + 1))
                for k, r in enumerate(s.row):
                    key = s.feature[bounds[k] : bounds[k + 1]].tobytes()
                    found[r][key] = found[r].get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                        pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
                        pa.array([[len(key) // 8 for key in f] for f in found], pa.list_(pa.int64())),
                        pa.array([np.frombuffer(b"".join(f), dtype=np.int64) for f in found], pa.list_(pa.int64())),
                    ],
                    ["id", "y", "times", "sizes", "features"],
                )
        settle()

    return sample.select("id", "y", "text").mapInArrow(
        run, f"id {kind}, y int, times array<long>, sizes array<long>, features array<long>"
    )


def fit(bag: pa.Table, known: np.ndarray, weights: np.ndarray) -> Model:
    """Full-batch Adagrad on the weighted log loss of the noisy-or, over rows of ``bags``.

    Weights stay at 0 or above, and features that end at 0 are forgotten: a sentence without evidence
    scores 0, so that a clean text isn't rejected for the number of its sentences.
    """
    labels = bag.column("y").to_numpy()
    flat = lambda name: bag.column(name).combine_chunks().flatten().to_numpy().astype(np.int64)
    times, sizes, feature = flat("times"), flat("sizes"), flat("features")
    row = np.repeat(np.arange(len(labels)), pc.list_value_length(bag.column("times")).to_numpy())
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    model = Model(known, np.zeros(len(known)), -5.0)
    total, squares, bias_squares = weights.sum(), np.full(len(known), 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(sentence, weights=model.weight[feature], minlength=len(sizes)) + model.bias
        p = 1 / (1 + np.exp(-z))
        q = -np.expm1(-np.bincount(row, weights=times * np.logaddexp(0.0, z), minlength=len(labels)))
        q = np.clip(q, 1e-9, 1 - 1e-12)
        slope = np.where(labels[row] == 1, -p * ((1 - q) / q)[row], p) * times * weights[row] / total
        g = np.bincount(feature, weights=slope[sentence], minlength=len(known)) + L2 * model.weight / total
        squares += g * g
        model.weight = np.maximum(0.0, model.weight - RATE * g / np.sqrt(squares))
        b = slope.sum()
        bias_squares += b * b
        model.bias -= RATE * b / np.sqrt(bias_squares)
    used = model.weight > 0
    return Model(known[used], model.weight[used], model.bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the bounded sample. ``labels`` holds only rows that may be learned from."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    found = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        picked += usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    nothing = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -40.0)
    if not found.get(1):
        return nothing
    chosen = docs.sparkSession.createDataFrame(picked, usable.schema)  # bounded by the two limits
    sample = cut(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    )
    held = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not held.get(1):
        return nothing
    told = holders(sample).where(telling(F.col("have"), F.col("toxic"), sum(held.values()), held[1])).select("h").toArrow()
    known = np.sort(told.column("h").to_numpy().astype(np.int64).view(np.uint64))
    bag = bags(sample, known).toArrow().sort_by("id")
    share = {k: found[k] / held[k] for k in held}
    return fit(bag, known, np.array([share[int(v)] for v in bag.column("y").to_numpy()], dtype=float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, score) for every row; one pass, no shuffle."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for i, j, offsets, data in chunks(texts(batch.column(1)), CHUNK_BYTES):
                s = split(offsets, data, model.known)
                out.append(noisy_or(s, logits(s, model), j - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], [id_col, "score"])
        settle()

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below the threshold."""
    at = docs.columns.index(text_col)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, dtype=bool)]
            for i, j, offsets, data in chunks(texts(batch.column(at))):
                s = split(offsets, data, model.known)
                keep.append(noisy_or(s, logits(s, model), j - i) < threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))
        settle()

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, start, end, score): byte spans of the sentences whose own score reaches the threshold."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in chunks(texts(batch.column(1))):
                s = split(offsets, data, model.known)
                p = 1 / (1 + np.exp(-logits(s, model)))
                hit = np.flatnonzero(p >= threshold)
                at = offsets[s.row[hit]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(s.row[hit] + i)), pa.array(s.start[hit] - at), pa.array(s.end[hit] - at), pa.array(p[hit])],
                    [id_col, "start", "end", "score"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, end long, score double")
