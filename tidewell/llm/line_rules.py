"""Quality rules by cross-document line frequency, with per-document base statistics.

One Python pass hashes every normalised line (words of the line, letters A-Z lowered, joined by one
space; a line without words has none) and measures the base statistics.  From there on only hashes
move: Spark counts the distinct documents of each line within its host, lines above the host's limit
are removed, and a document left with too small a share of its words is rejected as depleted.

Edge cases: a null text has no words (base_failed); a null host is a host of its own; a null id
counts as one document; repeated rows of one id count as one document but each gets its result; an
empty table gives an empty result; columns other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textscan import CHECK_BASE, Words, chunks, mix, run_hashes, string_hashes, texts, windows

#: A line is too frequent in a host if more than LINE_SHARE of its documents, and more than LINE_DOCS, hold it.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def _repeated(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where the same key stands at two places or more of the same row."""
    both = mix(key + row.astype(np.uint64) * np.uint64(CHECK_BASE))
    _, back, count = np.unique(both, return_inverse=True, return_counts=True)
    return count[back] > 1


def scan(offsets: np.ndarray, data: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Base statistics of each row, and (row, hash, words) of its distinct lines."""
    n = len(offsets) - 1
    words = Words(offsets, data)
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside)[:-1]
    stats = {
        "n_words": words.counts,
        "word_chars": _sums(inside * ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
    }
    hashes = words.hashes(data)
    at, key = windows(words, hashes, 3)
    hit = at[_repeated(key, words.row[at])]
    covered = np.zeros(len(words.row) + 3, dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    stats["n_repeat_words"] = np.bincount(words.row[covered[: len(words.row)]], minlength=n)

    # Lines, in bytes as they are; a row's last line ends where the row ends.
    newline = np.flatnonzero(data == 10)
    begin = np.union1d(newline + 1, offsets[:-1][np.diff(offsets) > 0])
    begin = begin[begin < len(data)]
    end = np.empty(len(begin), dtype=np.int64)
    end[:-1], end[-1:] = begin[1:], len(data)
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(end, offsets[row + 1])
    end = end - (data[end - 1] == 10)
    held = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    full = held[1] > held[0]
    begin, end, row, held = begin[full], end[full], row[full], (held[0][full], held[1][full])
    exact = string_hashes(data, begin, end)
    both = mix(exact + row.astype(np.uint64) * np.uint64(CHECK_BASE))
    _, first = np.unique(both, return_index=True)
    again = np.ones(len(both), dtype=bool)
    again[first] = False
    stats["n_dup_lines"] = np.bincount(row[again], minlength=n)

    normal = run_hashes(words.hashes(data, lower=True), *held)
    both = mix(normal + row.astype(np.uint64) * np.uint64(CHECK_BASE))
    _, first, back = np.unique(both, return_index=True, return_inverse=True)
    line_words = np.bincount(back, weights=held[1] - held[0], minlength=len(first)).astype(np.int64)
    order = np.argsort(first)
    first = first[order]
    return stats, (row[first], normal[first].view(np.int64), line_words[order])


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(uid, id, host, base statistics, lines array<struct<h long, words long>>), kept in the checkpoint folder."""
    rows = docs.select(
        F.col(id_col), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")
    )
    line = pa.struct([("h", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in chunks(texts(batch.column(2))):
                stats, (row, h, count) = scan(offsets, data)
                lines = pa.StructArray.from_arrays([pa.array(h), pa.array(count)], fields=list(line))
                bounds = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)]
                    + [pa.array(stats[c].astype(np.int64)) for c in BASE]
                    + [pa.ListArray.from_arrays(bounds, lines)],
                    [id_col, "host", *BASE, "lines"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, host string, {', '.join(f'{c} long' for c in BASE)}, lines array<struct<h:long,words:long>>"
    return cut(rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()))


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """Returns (id, base statistics, base_failed, n_frequent_lines, words_left, depleted, kept).

    The counts are two-level sums, so a hot line of a hot host is combined before the shuffle; the
    join back to the documents is a sort-merge join on (host, line), which AQE splits where skewed.
    """
    base = measure(docs, id_col, text_col, host_col)
    lines = base.select(
        "uid", F.col(id_col).alias("doc"), F.xxhash64(F.col("host"), F.col("host").isNull()).alias("hk"), F.explode("lines").alias("line")
    ).select("uid", "doc", "hk", "line.h", "line.words")
    hosts = (
        base.select(F.xxhash64(F.col("host"), F.col("host").isNull()).alias("hk"), F.col(id_col).alias("doc"))
        .distinct().groupBy("hk").agg(F.count(F.lit(1)).alias("host_docs"))
    )
    frequent = (
        lines.groupBy("hk", "h", "doc").agg(F.lit(1).alias("one")).groupBy("hk", "h").agg(F.count("one").alias("docs"))
        .where(F.col("docs") > line_docs)
        .join(hosts, "hk").where(F.col("docs") > line_share * F.col("host_docs")).select("hk", "h")
    )
    removed = lines.join(frequent, ["hk", "h"]).groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_frequent_lines"), F.sum("words").alias("words_gone")
    )
    left = F.col("n_words") - F.coalesce("words_gone", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return (
        base.drop("lines").join(removed, "uid", "left")
        .select(
            id_col, *BASE, failed.alias("base_failed"),
            F.coalesce("n_frequent_lines", F.lit(0)).cast("long").alias("n_frequent_lines"),
            left.cast("long").alias("words_left"),
            (left < least_left * F.col("n_words")).alias("depleted"),
        )
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
