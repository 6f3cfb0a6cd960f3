"""Token counts of a byte-level BPE tokenizer file, by a whole-token shortcut.

Offline, once per vocabulary, every vocabulary string is merged on its own; those that come out as
one token form the *whole* set.  A pre-token in that set is one token and is only counted; merges
run for the rest, with a memo.

Edge cases: null texts count as empty (0 tokens); repeated rows are counted each; a piece of any length takes n log n
steps, and only pieces of ordinary length stay in the memo; an empty table gives an empty result; only the id and text
columns are read, so that other names can't clash.  Special strings of the tokenizer inside a text are one token each,
as in the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Memo
from .shared import Idle

def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such files: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Merges:
    """Priorities of the merges over pieces written in byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = byte_letters()

    def count(self, piece: str) -> int:
        """Number of tokens of a pre-token given as text."""
        return len(self.split("".join([self.letters[b] for b in piece.encode("utf-8")])))

    def split(self, written: str) -> list[str]:
        """The merges in order of priority, leftmost first: a heap of the pairs that stand next to each other, in n log n steps."""
        parts, rank = list(written), self.rank
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
        heapify(heap)
        while heap:
            priority, i = heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or rank.get((parts[i], parts[j])) != priority:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (parts[a], parts[b]) in rank:
                    heappush(heap, (rank[parts[a], parts[b]], a))
        return [p for p in parts if p]

    def whole(self) -> frozenset[str]:
        """The vocabulary strings, as text, that encode alone as one token."""
        back = {letter: b for b, letter in self.letters.items()}
        found = []
        for written in self.vocab:
            if all(c in back for c in written) and len(self.split(written)) == 1:
                try:
                    found.append(bytes([back[c] for c in written]).decode("utf-8"))
                except UnicodeDecodeError:
                    pass  # part of a character: never a pre-token by itself
        return frozenset(found)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The whole set of a vocabulary file, computed once in a process."""
    return Merges(path).whole()


class Counter:
    def __init__(self, path: str, pattern: str, whole: frozenset[str]):
        self.merges = Merges(path)
        self.findall = regex.compile(pattern).findall
        self.whole = whole
        self.more = Memo(lambda piece: 0 if piece in whole else self.merges.count(piece) - 1)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))).split if self.merges.special else None

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.cut and any(s in text for s in self.merges.special):
            parts = self.cut(text)
            total = len(parts) - 1
        whole, more = self.whole, self.more
        for part in parts:
            pieces = self.findall(part)
            total += len(pieces) + sum([more[piece] for piece in pieces if piece not in whole])
        return total


_counters: dict[tuple[str, str], Counter] = {}
_idle = Idle(_counters.clear)


def busy():
    return _idle.busy()


def counter(path: str, pattern: str, whole: frozenset[str]) -> Counter:
    """One counter a worker; its memo serves all the worker's tasks."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern, whole)
    return _counters[path, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, n_bytes, n_tokens). No shuffle; the whole set is broadcast, its size bounded by the vocabulary's."""
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(whole_tokens(path))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with busy():
            yield from counted(batches)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern, proven.value).count
        for batch in batches:
            out = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(out, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
