"""Substring dedup over bytes: repeated intervals from merged shard Burrows-Wheeler transforms.

Merging the transforms of all shards of a corpus in one place would gather every byte there, so the
suffixes are first dealt out by content.  Each ``length``-byte window has a *minimizer*, the smallest
hash among its GRAM-byte substrings; equal windows have equal minimizers at equal places.  Runs of
windows with one minimizer form a segment of at most 2 * length - GRAM bytes.

1. Blocks of documents send their minimizers, packed; buckets answer which occur in more than one
   document (1) and in very many (2).
2. For minimizers that are shared, blocks send their distinct segments with the smallest document id
   that holds each (for the very frequent ones, single windows, so that a frequent short phrase with
   ever new surroundings doesn't gather in one bucket).
3. In a bucket each block's segments are a shard, whose suffixes are sorted once; the shards'
   transforms are merged by iterative interleave refinement: after h rounds the interleave is sorted by the first
   h bytes, and the round in which a bound between two suffixes appears gives their common prefix.  Runs of common
   prefixes of ``length`` bytes are the repeated intervals; their smallest document id decides.  No suffix is sorted again.
4. Blocks get one bit for each window back and cut the covered bytes out.

Everything compared decides on bytes; hashes only choose where bytes meet, so the result is exact.

Edge cases: null texts are empty; documents shorter than ``length`` lose nothing; matches never
cross documents; rows that share an id don't remove from each other; a null id counts as larger than
all others and comes back null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import exchange
from .textscan import BYTE_BASE, buffers, chunks, mix, polynomial, texts

LENGTH, GRAM = 50, 24  # GRAM is a multiple of 8
#: Documents that share a minimizer from which on single windows are sent.
FREQUENT = 2_000
#: Bits of a position beside the hash that orders minimizers; longer texts are scanned in pieces that overlap by a window.
PLACE_BITS = 27
#: Shards that are merged at once.
SHARDS = 200
#: Strings that a packed row should hold at least.
LEAST_STRINGS = 32
#: Smaller than usual: besides the text a block holds the strings that it shares.
BLOCK_BYTES = 3 << 20
#: Bytes scanned at a time: the dozen arrays of eight bytes a byte stay in the processor's cache.
CACHED_BYTES = 1 << 17
#: Windows of one text that are scanned at a time.
PIECE = (1 << PLACE_BITS) - 4096


class Segments:
    """Segments of a block: minimizer key, first window and number of windows as places in the block's bytes, and row."""

    def __init__(self, table: pa.Table, length: int):
        self.text = texts(table.column("text"))
        self.id = exchange.order(table)
        self.offsets, self.data = buffers(self.text)
        key, start, count, row = ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for i, j, offsets, data in chunks(self.text, CACHED_BYTES):
            for at in range(0, max(1, len(data) - length + 1), PIECE):
                piece = data[at : at + PIECE + length - 1]
                if len(piece) < length:
                    continue
                own = segments(offsets if len(piece) == len(data) else np.array([0, len(piece)]), piece, length)
                key.append(own[0])
                start.append(own[1] + at + self.offsets[i])
                count.append(own[2])
                row.append(own[3] + i)
        self.key, self.start, self.count, self.row = map(np.concatenate, (key, start, count, row))
        order = np.argsort(self.key, kind="stable")
        ranked = self.key[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = ranked[1:] != ranked[:-1]
        self.keys = ranked[first]
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.cumsum(first) - 1
        rows = self.id[self.row[order]] if len(order) else order
        other = first.copy()
        other[1:] |= rows[1:] != rows[:-1]
        self.documents = np.bincount(np.cumsum(first)[other] - 1, minlength=len(self.keys))


def segments(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer key, first window, windows, row) of the runs of windows with one minimizer, for texts side by side."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length, dtype=np.uint8)])
    eight = np.ndarray((n + GRAM,), dtype="<u8", buffer=padded, strides=(1,)).copy()
    gram = eight[:n]
    for k in range(8, GRAM, 8):
        gram = mix(gram) + eight[k : n + k] * np.uint64(0x9E3779B97F4A7C15)
    gram = mix(gram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~place) | np.arange(n, dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    sizes = np.diff(offsets)
    room = np.repeat(offsets[1:], sizes) - np.arange(n)
    at = np.flatnonzero(room[: n - length + 1] >= length)
    chosen = (least[at] & place).astype(np.int64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(first)
    start = at[begins]
    # mixed once more: smallest hashes would crowd into the first buckets
    return mix(gram[chosen[begins]]), start, np.diff(np.append(begins, len(at))), np.searchsorted(offsets, start, "right") - 1


class Candidates:
    """What a block sends for its shared minimizers: distinct strings in order of key, each with its smallest id.

    ``entry`` gives for each occurrence the string's number; occurrences are (place of first window, windows, row).
    """

    def __init__(self, own: Segments, flags: np.ndarray, length: int):
        flag = flags[own.place] if len(own.place) else np.zeros(0, np.uint8)
        whole = np.flatnonzero(flag == 1)
        start, count, row, key = own.start[whole], own.count[whole], own.row[whole], own.key[whole]
        single = np.flatnonzero(flag == 2)
        if len(single):
            n = own.count[single]
            each = np.repeat(own.start[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, count = np.concatenate([start, each]), np.concatenate([count, np.ones(len(each), np.int64)])
            row = np.concatenate([row, np.repeat(own.row[single], n)])
            key = np.concatenate([key, np.zeros(len(each), np.uint64)])
        self.start, self.count, self.row = start, count, row
        data = memoryview(own.data)
        found: dict[bytes, int] = {}
        strings: list[bytes] = []
        ids: list[int] = []
        keys: list[int] = []
        entry = np.empty(len(start), dtype=np.int64)
        row_ids = own.id[row].tolist() if len(row) else []
        key = key.tolist()
        for k, (a, c) in enumerate(zip(start.tolist(), count.tolist())):
            string = bytes(data[a : a + c + length - 1])
            number = found.get(string)
            if number is None:
                number = found[string] = len(strings)
                strings.append(string)
                ids.append(row_ids[k])
                keys.append(key[k] or xxhash.xxh64_intdigest(string))
            elif row_ids[k] < ids[number]:
                ids[number] = row_ids[k]
            entry[k] = number
        order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.entry = rank[entry]
        self.keys = np.array(keys, dtype=np.uint64)[order]
        self.ids = np.array(ids, dtype="<i8")[order]
        self.strings = [strings[k] for k in order.tolist()]


def suffix_order(text: np.ndarray, segment: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order of shard, then content, by prefix doubling; 0 ends a segment, and ends sort by segment."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + segment.max() + 1
    rank[ends] = segment[ends]
    rank += shard * (int(rank.max()) + 1)
    width = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1
        # beyond an end nothing matters: ends are distinct already
        both = rank * (int(rank.max()) + 3) + after
        order = np.argsort(both)  # equal ones get equal ranks, in whatever order
        ranked = both[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])) - 1
        rank = new
        if int(rank.max()) == n - 1:
            return order
        width *= 2


def transforms(strings: list[bytes], shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transforms of all shards, one after another: (byte before each suffix, its string, its place there, strings of each shard).

    ``shard`` ascends. Bytes are numbered anew, so that 0 is free for what stands before a string: its end.
    """
    whole = np.frombuffer(b"".join(strings), np.uint8)
    used = np.zeros(256, dtype=bool)
    used[whole] = True
    if used.all():
        raise ValueError("UTF-8 text never uses all 256 bytes; 0 must stay free for the ends")
    lengths = np.array([len(s) + 1 for s in strings])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = np.zeros(starts[-1], dtype=np.uint8)
    inside = np.ones(starts[-1], dtype=bool)
    inside[starts[1:] - 1] = False
    text[inside] = np.cumsum(used).astype(np.uint8)[whole]
    segment = np.repeat(np.arange(len(strings)), lengths)
    order = suffix_order(text, segment, shard[segment])
    previous = text[order - 1]
    previous[starts[segment[order]] == order] = 0
    return previous, segment[order], order - starts[segment[order]], np.bincount(shard)


def merge_shards(strings: list[bytes], shard: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place in it, common prefix with the suffix before) of all suffixes, merged from the shards' transforms.

    Round h sorts the interleave of the shards by the first h bytes: the merged transform, sorted stably by its bytes, gives
    the suffixes one byte longer. A bound between suffixes appears in the round after their common prefix and stays in its place, so the
    round it appears in is that prefix and one; prefixes of ``rounds`` and more aren't told apart.
    """
    transform, string, place, sizes = transforms(strings, shard)
    n = len(transform)
    ends = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    shard_of = shard[string].astype(np.uint8)
    interleave = shard_of.copy()
    block = np.zeros(n, dtype=np.int32)
    merged = np.empty(n, dtype=np.uint8)
    prefix = np.full(n, rounds, dtype=np.uint8)
    prefix[0] = 0
    for h in range(rounds):
        merged[np.argsort(interleave, kind="stable")] = transform
        # Stable by the byte before: the suffixes one byte longer, in order. Ends keep the shards' order.
        step = np.argsort(merged, kind="stable")[len(ends) :]
        interleave = np.concatenate([ends, interleave[step]])
        before, byte = block[step], merged[step]
        new = np.ones(n, dtype=bool)
        new[len(ends) + 1 :] = (before[1:] != before[:-1]) | (byte[1:] != byte[:-1])
        prefix[new & (prefix == rounds)] = h
        block = np.cumsum(new, dtype=np.int32)
    back = np.argsort(interleave, kind="stable")
    merged_string, merged_place = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    merged_string[back], merged_place[back] = string, place
    return merged_string, merged_place, prefix


def least_ids(strings: list[bytes], ids: np.ndarray, length: int, sender: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, smallest id of any string that holds the same window) for every window.

    Repeated intervals are runs of suffixes with a common prefix of ``length``. Shards are the blocks that sent the strings, several
    together where there are more than SHARDS.
    """
    sender = np.arange(len(strings)) if sender is None else sender
    way = np.argsort(sender, kind="stable")
    shard = np.unique(sender[way], return_inverse=True)[1]
    shard = shard * min(SHARDS, int(shard[-1]) + 1) // (int(shard[-1]) + 1)
    string, place, prefix = merge_shards([strings[k] for k in way.tolist()], shard, length)
    string = way[string]
    lengths = np.array([len(s) for s in strings])
    full = place <= lengths[string] - length
    bound = np.cumsum(prefix < length)  # the interval of each suffix; suffixes too short for a window are in none of theirs
    string, place, interval = string[full], place[full], bound[full]
    first = np.append(True, interval[1:] != interval[:-1])
    least = np.minimum.reduceat(ids[string], np.flatnonzero(first))
    return string, place, least[np.cumsum(first) - 1]


def repeated_windows(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of each string whose hash also stands in another place; (0, -1) if there is none.

    Equal windows have equal hashes, so what is left out here is unique; what is kept is decided on bytes.
    """
    sizes = np.array([len(s) for s in strings])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(strings), np.uint8)
    room = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    at = np.flatnonzero(room >= length)
    hashes = polynomial(data.astype(np.uint64) + np.uint64(1), at, at + length, BYTE_BASE)
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = at[count[back] > 1]
    owner = np.searchsorted(offsets, hit, "right") - 1
    first, last = np.zeros(len(strings), np.int64), np.full(len(strings), -1)
    begin = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    first[owner[begin]] = (hit - offsets[owner])[begin]
    last[owner] = hit - offsets[owner]  # of equal places the last value stays
    return first, last


def resolve(
    keys: np.ndarray, ids: np.ndarray, strings: list[bytes], length: int, sender: np.ndarray | None = None, pool_bytes: int = 1 << 20, spare: bool = True
) -> np.ndarray:
    """For each sent string a bit for each of its windows: held by a document smaller than the sender's smallest.

    Equal strings are one, with the smallest id of all. With ``spare`` the merge is spared strings that only repeat as a whole, and parts
    without a window that any other string holds; without, the merge decides everything, with the same result.
    """
    found: dict[bytes, int] = {}
    number = np.array([found.setdefault(s, len(found)) for s in strings], dtype=np.int64)
    distinct = list(found)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    key, home = np.zeros(len(distinct), dtype=np.uint64), np.zeros(len(distinct), dtype=np.int64)
    key[number] = keys
    home[number[::-1]] = (np.arange(len(strings)) if sender is None else sender)[::-1]  # the first that sent it
    ones = np.array([(1 << (len(s) - length + 1)) - 1 for s in distinct], dtype=np.uint64)
    masks = np.where(least[number] < ids, ones[number], np.uint64(0)) if spare else np.zeros(len(number), dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    bound = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    several = np.diff(np.append(bound, len(order))) > (1 if spare else 0)
    groups = [order[a:b] for a, b in zip(bound[several], np.append(bound, len(order))[1:][several])]
    senders = np.argsort(number, kind="stable")
    sender_bounds = np.searchsorted(number[senders], np.arange(len(distinct) + 1))
    pool: list[np.ndarray] = []
    held = 0
    for g, group in enumerate(groups):
        pool.append(group)
        held += sum(len(distinct[k]) for k in group.tolist())
        if held < pool_bytes and g + 1 < len(groups):
            continue
        members = np.concatenate(pool)
        pool, held = [], 0
        whole = [distinct[k] for k in members.tolist()]
        first, last = repeated_windows(whole, length) if spare else (np.zeros(len(whole), np.int64), np.array([len(s) - length for s in whole]))
        some = last >= 0
        if not some.any():
            continue
        members, first, last = members[some], first[some], last[some]
        cut = [distinct[k][a : z + length] for k, a, z in zip(members.tolist(), first.tolist(), last.tolist())]
        string, place, smallest = least_ids(cut, least[members], length, home[members])
        string, place = members[string], place + first[string]
        # every sender of the string compares with its own smallest id
        n = np.diff(sender_bounds)[string]
        to = senders[np.repeat(sender_bounds[string], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        hit = np.repeat(smallest, n) < ids[to]
        np.bitwise_or.at(masks, to[hit], np.uint64(1) << np.repeat(place, n)[hit].astype(np.uint64))
    return masks


def shared(asked: list[tuple[np.ndarray, np.ndarray, list]]) -> tuple[list[list[np.ndarray]], list[int]]:
    """For each minimizer sent: 0 held by one document only, 1 by several, 2 by very many."""
    keys, _, columns = asked[0]
    if not len(keys):
        return [[]], ()
    _, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights=columns[0])[place]
    return [[(total > 1).astype(np.uint8) + (total > FREQUENT)]], ()


def merge(asked: list[tuple[np.ndarray, np.ndarray, list]], length: int) -> tuple[list[list[np.ndarray]], list[int]]:
    """For each string sent, a bit for each of its windows; documents stand in order of (rank, id)."""
    keys, blocks, columns = asked[0]
    if not len(keys):
        return [[]], ()
    ids, strings = columns
    rank = exchange.ranks(blocks)
    way = np.lexsort((ids, rank))
    place = np.empty(len(way), dtype=np.int64)
    place[way] = np.cumsum(np.append(0, (rank[way][1:] != rank[way][:-1]) | (ids[way][1:] != ids[way][:-1])))
    return [[resolve(keys, place, strings, length, blocks)]], ()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Returns (id, n_bytes, n_removed, kept binary, spans array<struct<start, end>>): spans count bytes, end excluded."""
    rows, blocks, total = exchange.blocked(docs, id_col, text_col, block_bytes=BLOCK_BYTES)
    first = exchange.evenly(exchange.deal(total / 18 * 7, blocks, total / blocks / 18), rows)
    later = exchange.evenly(exchange.deal(total, blocks, total / blocks / 50, least_keys=LEAST_STRINGS), rows)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def minimizers(own: Segments) -> list[exchange.Section]:
        return [(own.keys, [own.documents])]

    def strings_of(table: pa.Table, got) -> tuple[list[exchange.Section], list[exchange.Section]]:
        own = Segments(table, length)
        found = got(minimizers(own))[0]
        sent = Candidates(own, found[0].astype(np.uint8) if found else np.zeros(0, np.uint8), length)
        # Back come, for each string, how often it stands in the block, its windows, and where it stands.
        way = np.argsort(sent.entry, kind="stable")
        times = np.bincount(sent.entry, minlength=len(sent.keys))
        windows = np.array([len(s) for s in sent.strings], dtype=np.int64) - length + 1
        places = (sent.start[way] - own.offsets[0], sent.keys[sent.entry[way]]) if len(way) else (way, sent.keys)
        return [(sent.keys, [sent.ids.view(np.uint64) ^ np.uint64(1 << 63), sent.strings])], [(sent.keys, [times, windows]), (places[1], [places[0]])]

    def cut_out(table: pa.Table, got) -> pa.Table:
        text, ids = texts(table.column("text")), exchange.order(table)
        offsets, data = buffers(text)
        edge = np.zeros(offsets[-1] - offsets[0] + 1, dtype=np.int32)
        if got.kept:
            masks, (times, windows, places) = got.answered[0][0], (c.astype(np.int64) for c in got.kept)
            entry = np.repeat(np.arange(len(times)), times)
            id_ = ids[np.searchsorted(offsets, places + offsets[0], "right") - 1]
            least = np.minimum.reduceat(id_, np.cumsum(times) - times)
            mask = np.where(id_ > least[entry], ~np.uint64(0), masks[entry])
            for k in range(int(windows.max())):
                at = places[(windows[entry] > k) & ((mask >> np.uint64(k)) & np.uint64(1) == 1)] + k
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept, removed, begins, ends, counts = [], [], [], [], [0]
        whole = data[offsets[0] : offsets[-1]].tobytes()
        for r in range(table.num_rows):
            a, z = int(offsets[r] - offsets[0]), int(offsets[r + 1] - offsets[0])
            change = np.flatnonzero(np.diff(gone[a:z].astype(np.int8), prepend=0, append=0))
            b, e = change[::2], change[1::2]
            stay = np.concatenate([[0], e]), np.concatenate([b, [z - a]])
            kept.append(b"".join([whole[a + x : a + y] for x, y in zip(stay[0].tolist(), stay[1].tolist())]))
            removed.append(int((e - b).sum()))
            begins.append(b)
            ends.append(e)
            counts.append(counts[-1] + len(b))
        none = np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *begins])), pa.array(np.concatenate([none, *ends]))], fields=list(span))
        return pa.table(
            {
                id_col: table.column("id"), "n_bytes": pa.array(np.diff(offsets)[: table.num_rows], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()), "spans": pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans),
            }
        )

    flagged = exchange.answer(exchange.send(rows, first, lambda table: minimizers(Segments(table, length))), first, shared)
    answered = exchange.answer(exchange.send_on(rows, flagged, later, strings_of), later, lambda asked: merge(asked, length))
    schema = f"`{id_col}` long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"
    return exchange.finish(rows, answered, cut_out, schema)
