"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features say whether a text holds an n-gram, of one to three symbols, over two alphabets: its bytes, and the
shapes of its words (which kinds of characters a word has, and whether it equals the word before, so that
lists of symbols, shouting and repetition are n-grams as well).  An indicator is scaled by the class log-count ratio

    r = log((p / |p|) / (q / |q|)),   p, q = 1 + documents of label 1, 0 with the n-gram

rows are scaled to length one, and a linear model is fitted on the hinge loss by dual coordinate descent
(Hsieh et al. 2008), with labels weighted alike.  Margins become scores by a logistic curve (Platt), fitted on margins
of models that haven't seen the text.

The model is fitted on the whole texts of a bounded, stratified sample of labelled documents (at most MOST of each
label, drawn by a hash of the id). Executors extract and Spark counts the n-grams; the driver gets the known ones of each
sampled document as numbers.  Scoring covers every whole text in one pass without a shuffle, the model travelling with
the task: one number for each of the n-grams that at least LEAST_DOCS sampled documents hold.

Edge cases: a null or empty text has no n-gram and gets the score of the bias; a text of any length is taken whole; without
training rows every score is 0.5, with one label only it is that label's smoothed share; rows with a null label or id are not
trained on; of documents that share an id one is trained on, of its labels the larger; repeated rows score alike; an
empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, settle
from .textscan import Words, chunks, texts

MOST = 3_000
#: Sampled documents that must hold an n-gram.
LEAST_DOCS = 5
#: Bound of a dual variable, passes over the sample, and the violation at which they end.
COST, PASSES, TOLERANCE = 10.0, 60, 1e-2
THRESHOLD = 0.5

#: Bits of a word's shape: small letters (and all beyond ASCII), capitals, digits, marks within, a mark at the end, same as the word before.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127], _KIND[128:], _KIND[97:123], _KIND[65:91], _KIND[48:58] = 8, 1, 1, 2, 4
_AT_END, _AGAIN, _SHAPE_BITS = 16, 32, 6
#: First key of each kind of n-gram: bytes of one to three, shapes of one to three, and the end of all keys.
_FIRST = np.cumsum([0, 1 << 8, 1 << 16, 1 << 24, 1 << 6, 1 << 12, 1 << 18]).tolist()
_BYTES, _SHAPES, KEYS = _FIRST[:3], _FIRST[3:6], _FIRST[6]


@dataclass
class Model:
    """``known``: keys of the n-grams, ascending; ``weight``: ratio times weight of each; ``scale``: squared ratio of each; ``slope`` and ``shift`` of the logistic curve."""

    known: np.ndarray
    weight: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float


def grams(offsets: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys by place, bounds of each row's places, symbols an n-gram has beyond the first) of every kind."""
    out, key = [], data.astype(np.int32)
    for n, base in enumerate(_BYTES):
        if n:
            key = (key[: max(0, len(key) - 1)] << 8) | data[n:] if len(data) > n else key[:0]
        out.append((key + base, offsets, n))
    words = Words(offsets, data)
    count = len(words.start)
    shape = np.zeros(count, dtype=np.int32)
    if count:
        kind = np.append(_KIND[data], np.uint8(0))
        shape = np.bitwise_or.reduceat(kind, np.stack([words.start, words.end], axis=1).reshape(-1))[::2].astype(np.int32)
        shape |= np.where(_KIND[data[words.end - 1]] == 8, _AT_END, 0).astype(np.int32)
        h = words.hashes(data)
        again = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
        shape[1:] |= np.where(again, _AGAIN, 0).astype(np.int32)
    key = shape
    for n, base in enumerate(_SHAPES):
        if n:
            key = (key[: max(0, len(key) - 1)] << _SHAPE_BITS) | shape[n:] if count > n else key[:0]
        out.append((key + base, words.bounds, n))
    return out


class Finder:
    """Looks n-grams up: their places among the known ones, from a table over all keys."""

    def __init__(self, known: np.ndarray):
        self.size = len(known)
        self.table = np.zeros(KEYS, dtype=np.int32)  # pages that hold no known key stay unused
        self.table[known] = np.arange(1, len(known) + 1)

    def held(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
        """The places of the known n-grams that each row holds."""
        found = [(self.table[keys], bounds.tolist(), n) for keys, bounds, n in grams(offsets, data)]
        flags = np.zeros(self.size + 1, dtype=bool)
        for r in range(len(offsets) - 1):
            for places, bounds, n in found:
                flags[places[bounds[r] : max(bounds[r], bounds[r + 1] - n)]] = True
            flags[0] = False
            at = np.flatnonzero(flags)
            flags[at] = False
            yield at - 1


def holders(sample: DataFrame) -> DataFrame:
    """(key, have, good): documents, and documents of label 1, of (id, y, text) that hold each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, _, offsets, data in chunks(texts(batch.column(2))):
                found = [(keys, bounds.tolist(), n) for keys, bounds, n in grams(offsets, data)]
                own = [np.unique(np.concatenate([keys[bounds[r] : max(bounds[r], bounds[r + 1] - n)] for keys, bounds, n in found])) for r in range(len(offsets) - 1)]
                label = np.repeat(y[i : i + len(own)], [len(x) for x in own])
                key, place = np.unique(np.concatenate(own), return_inverse=True)
                have, good = np.bincount(place, minlength=len(key)), np.bincount(place, weights=label, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(have), pa.array(good)], ["key", "have", "good"])
        settle()

    counted = sample.select("id", "y", "text").mapInArrow(run, "key long, have long, good long")
    return counted.groupBy("key").agg(F.sum("have").alias("have"), F.sum("good").alias("good"))


def bags(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, y, held): the places of the known n-grams of each document."""
    kind = sample.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for batch in batches:
            finder = finder or Finder(known)
            for i, j, offsets, data in chunks(texts(batch.column(2))):
                held = pa.array([at.astype(np.int32) for at in finder.held(offsets, data)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), held], ["id", "y", "held"])
        settle()

    return sample.select("id", "y", "text").mapInArrow(run, f"id {kind}, y int, held array<int>")


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and of the bias that minimise |w|^2 / 2 + sum of cost * hinge loss, by dual coordinate descent.

    Each label's losses have the same total cost.
    """
    share = {v: len(y) / (2 * max(1, int((y == v).sum()))) for v in (0, 1)}
    values = [unit(ratio, at) for at in rows]
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        worst = 0.0
        for k in rng.permutation(len(rows)).tolist():
            at, (x, one) = rows[k], values[k]
            sign, most = (1.0, cost * share[1]) if y[k] else (-1.0, cost * share[0])
            slope = sign * (w[at] @ x + bias * one) - 1  # of the dual, whose curvature is 1: rows have length one
            moved = min(max(dual[k] - slope, 0.0), most) - dual[k]
            if moved:
                worst = max(worst, abs(moved))
                dual[k] += moved
                w[at] += moved * sign * x
                bias += moved * sign * one
        if worst < TOLERANCE:
            break
    return w, bias


def unit(ratio: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """A row's scaled indicators and its bias feature, of length one together."""
    x = ratio[at]
    length = np.sqrt(x @ x + 1)
    return x / length, 1 / length


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[at] @ x + bias * one for at, (x, one) in ((at, unit(ratio, at)) for at in rows)])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of smoothed targets, by Newton's method with halving."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: np.sum(np.logaddexp(0, a * margin + b) - target * (a * margin + b))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        gap, v = p - target, np.maximum(p * (1 - p), 1e-12)
        g = np.array([gap @ margin, gap.sum()])
        h = np.array([[v @ (margin * margin) + 1e-9, v @ margin], [v @ margin, v.sum() + 1e-9]])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(bag: pa.Table, known: np.ndarray, have: np.ndarray, good: np.ndarray) -> Model:
    """Ratios from the counts, weights by descent, the curve by margins of two models that learn from one half each."""
    y = bag.column("y").to_numpy().astype(np.int64)
    p, q = good + 1.0, have - good + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    held = bag.column("held").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy())])
    flat = held.flatten().to_numpy()
    rows = [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]
    w, bias = descend(rows, y, ratio)
    unseen, half = np.zeros(len(y)), np.arange(len(y)) % 2
    for side in (0, 1):
        own, other = np.flatnonzero(half != side), np.flatnonzero(half == side)
        if len(set(y[own].tolist())) == 2 and len(other):
            found = descend([rows[k] for k in own], y[own], ratio)
            unseen[other] = margins([rows[k] for k in other], ratio, *found)
        else:
            unseen[other] = margins([rows[k] for k in other], ratio, w, bias)
    slope, shift = platt(unseen, y)
    return Model(known, w * ratio, ratio * ratio, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Model:
    """Fit on at most ``most`` documents of each label. ``labels`` holds only rows that may be learned from."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    picked = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    none = np.zeros(0, dtype=np.int64)
    constant = lambda p: Model(none, np.zeros(0), np.zeros(0), 0.0, 0.0, float(np.log(p / (1 - p))))
    if not picked:
        return constant(0.5)
    chosen = docs.sparkSession.createDataFrame(picked, usable.schema)  # bounded by the limit
    sample = cut(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    )
    count = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(count) < 2:
        return constant((count.get(1, 0) + 1) / (sum(count.values()) + 2))
    told = holders(sample).where(F.col("have") >= LEAST_DOCS).toArrow().sort_by("key")
    known, have, good = (told.column(c).to_numpy().astype(np.int64) for c in ("key", "have", "good"))
    return fit(bags(sample, known).toArrow().sort_by("id"), known, have.astype(float), good.astype(float))


def scores(model: Model, finder: Finder, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for r, at in enumerate(finder.held(offsets, data)):
        out[r] = (model.weight[at].sum() + model.bias) / np.sqrt(model.scale[at].sum() + 1)
    return 1 / (1 + np.exp(-(model.slope * out + model.shift)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, score) for every row; one pass, no shuffle."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for batch in batches:
            finder = finder or Finder(model.known)
            out = [np.zeros(0), *[scores(model, finder, offsets, data) for _, _, offsets, data in chunks(texts(batch.column(1)))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], [id_col, "score"])
        settle()

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")
