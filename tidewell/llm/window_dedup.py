"""Substring dedup by Rabin-Karp hashes of every window of ``size`` words, counted in Spark.

Hashes roll over the words of a block by prefix sums: a 64-bit polynomial of the words' hashes, and 32 bits of
another one over hashes of another seed.  A block sends its distinct hashes, sorted and packed, with the number of
its documents that hold each, to the bucket of their range. The bucket adds the documents up and takes the least
rank among the senders; a window in two documents or more is repeated, and all but the least rank hear so, one bit a hash.
Ranks are ranges of document ids, so such a window starts in a smaller document; windows that repeat inside one
block are resolved there.  Repeated windows merge into maximal intervals of words, which are removed.
Windows are judged on the input, not on what is left.

Edge cases: texts of any length are taken whole; null and empty texts, and texts shorter than a window, lose nothing (kept text: the
words joined by one space); rows that share an id never remove from each other; a null id counts as
larger than all others and comes back null; an empty table gives an empty result; columns other than
the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import exchange
from .textscan import CHECK_BASE, WORD_BASE, Words, buffers, chunks, texts, windows

SIZE = 13
#: Second hash: so many bytes of another polynomial, over hashes of another seed, besides the 64-bit key.
CHECK = "<u4"
RESULT = "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


class Block:
    """Windows of a block's documents: sorted distinct keys, and each window's place among them."""

    def __init__(self, table: pa.Table, size: int):
        self.text = texts(table.column("text"))
        self.id = exchange.order(table)
        keys, checks, at, row, start, end, counts, n = [], [], [], [], [], [], [], 0
        origin, data = buffers(self.text)
        small = np.int32 if len(data) < 1 << 31 else np.int64  # places in the block's text
        for i, j, offsets, data in chunks(self.text):
            words = Words(offsets, data)
            where, key = windows(words, words.hashes(data), size)
            keys.append(key)
            checks.append((windows(words, words.hashes(data, seed=1), size, CHECK_BASE)[1] >> np.uint64(32)).astype(CHECK))
            at.append((where + n).astype(small))
            row.append((words.row + i).astype(small))
            start.append((words.start + origin[i]).astype(small))
            end.append((words.end + origin[i]).astype(small))
            counts.append(words.counts)
            n += len(words.start)
        none = np.zeros(0, dtype=np.int64)
        self.at, self.row, self.start, self.end = (np.concatenate([np.zeros(0, small), *x]) for x in (at, row, start, end))
        self.counts = np.concatenate([none, *counts])
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        check = np.concatenate([np.zeros(0, CHECK), *checks])
        del keys, checks, at, row, start, end
        self.order = np.argsort(key, kind="stable").astype(small)  # rows stand in order of id, so the first of equals has the smallest
        ranked = key[self.order]
        del key
        first = np.ones(len(ranked), dtype=bool)
        first[1:] = ranked[1:] != ranked[:-1]
        self.keys, self.checks = ranked[first], check[self.order[first]]
        del ranked, check
        self.place = (np.cumsum(first, dtype=small) - 1).astype(small)  # of the windows in self.order
        holder = self.id[self.row[self.at[self.order]]] if len(first) else none
        self.least_id = holder[first]
        other = np.append(first[1:], True) | np.append(holder[1:] != holder[:-1], True)  # the last place of a document among its window's
        self.documents = np.bincount(self.place[other], minlength=len(self.keys)).astype(small) if len(first) else none

    def covered(self, earlier: np.ndarray, size: int) -> np.ndarray:
        """By word: whether a window over it was seen in a smaller document."""
        windows_id = self.id[self.row[self.at[self.order]]] if len(self.at) else self.at
        hit = self.at[self.order][earlier[self.place] | (windows_id > self.least_id[self.place])]
        edge = np.zeros(len(self.row) + size + 1, dtype=np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + size, -1)
        return np.cumsum(edge)[: len(self.row)] > 0


def counted(key: np.ndarray, check: np.ndarray, rank: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window of each row sent, and by window: documents that hold it, least rank among them).

    ``more``: documents beyond the first that a sender counted.
    """
    order = np.argsort(key, kind="stable")
    if ((key[order][1:] == key[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, key))  # two windows share a key
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    window = np.empty(len(key), dtype=np.int64)
    window[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    documents = np.add.reduceat(more[order].astype(np.int64) + 1, first) if len(first) else first
    least = np.minimum.reduceat(rank[order], first) if len(first) else first
    return window, documents, least


def seen_earlier(asked: list[tuple[np.ndarray, np.ndarray, list]]) -> tuple[list[list[np.ndarray]], list[int]]:
    """For each window sent: whether it is repeated and a block of a lower rank holds it too; the number of repeated windows."""
    key, blocks, columns = asked[0]
    if not len(key):
        return [[np.zeros(0, dtype=bool)]], [0]
    # A window that one block sends for one document is in no other: most are left at once.
    way = np.argsort(key, kind="stable")
    same = key[way[1:]] == key[way[:-1]]
    several = way[np.append(same, False) | np.append(False, same) | (columns[1][way] > 0)]
    del way, same
    again, repeated = np.zeros(len(key), dtype=bool), 0
    if len(several):
        rank = exchange.ranks(blocks[several])
        window, documents, least = counted(key[several], columns[0][several], rank, columns[1][several])
        again[several] = (documents > 1)[window] & (rank > least[window])
        repeated = int((documents > 1).sum())
    return [[again]], [repeated]


def kept_texts(own: Block, gone: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each row's remaining words joined by one space, and how many went."""
    removed = np.bincount(own.row[gone], minlength=len(own.id)) if len(own.row) else np.zeros(len(own.id), np.int64)
    first = np.concatenate([[0], np.cumsum(own.counts)])
    _, data = buffers(own.text)
    whole = data.tobytes() if len(data) else b""
    out = []
    for r, n in enumerate(removed.tolist()):
        i, j = first[r], first[r + 1]
        if i == j or n == j - i:
            out.append("")
        elif not n:
            out.append(b" ".join(whole[own.start[i] : own.end[j - 1]].split()).decode())
        else:
            keep = np.flatnonzero(~gone[i:j]) + i
            cut = np.flatnonzero(np.diff(keep) > 1)
            runs = zip(keep[np.concatenate([[0], cut + 1])], keep[np.append(cut, len(keep) - 1)])
            out.append(b" ".join([x for a, b in runs for x in whole[own.start[a] : own.end[b]].split()]).decode())
    return out, removed


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, carry: Sequence[str] = ()) -> DataFrame:
    """Returns (id, n_words, n_removed, kept_text, spans array<struct<start, end>>): spans count words, end excluded.

    Columns named in ``carry`` come back in a last column ``carry``, a struct.
    """
    rows, blocks, total = exchange.blocked(docs, id_col, text_col, carry)
    dealt = exchange.evenly(exchange.deal(total / 6 * 8, blocks, total / blocks / 6), rows)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def windows_of(table: pa.Table) -> list[exchange.Section]:
        own = Block(table, size)
        return [(own.keys, [own.checks, own.documents - 1])]

    def cut_out(table: pa.Table, got) -> pa.Table:
        own = Block(table, size)
        found = got([(own.keys, [own.checks, own.documents - 1])])[0]
        earlier = found[0].astype(bool) if found else np.zeros(len(own.keys), dtype=bool)
        gone = own.covered(earlier, size)
        kept, removed = kept_texts(own, gone)
        first = np.concatenate([[0], np.cumsum(own.counts)])
        before, after = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
        before[1:], after[:-1] = gone[:-1] & (own.row[1:] == own.row[:-1]), gone[1:] & (own.row[1:] == own.row[:-1])
        begins, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        home = first[own.row[begins]] if len(begins) else begins
        spans = pa.StructArray.from_arrays([pa.array(begins - home, pa.int64()), pa.array(ends - home, pa.int64())], fields=list(span))
        bounds = np.searchsorted(own.row[begins] if len(begins) else begins, np.arange(len(own.id) + 1)).astype(np.int32)
        return pa.table(
            {
                "id": table.column("id"), "n_words": pa.array(own.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.string()), "spans": pa.ListArray.from_arrays(pa.array(bounds), spans),
            }
            | ({"carry": table.column("carry")} if carry else {})
        )

    answers = exchange.answer(exchange.send(rows, dealt, windows_of), dealt, seen_earlier)
    schema = T.StructType(T._parse_datatype_string(RESULT).fields + ([rows.schema["carry"]] if carry else []))
    return exchange.finish(rows, answers, cut_out, schema).withColumnRenamed("id", id_col)
