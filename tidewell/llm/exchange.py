"""Exchanges between blocks of documents and buckets of keys, with packed rows.

A *block* is a set of whole documents of some megabytes, a *bucket* a range of 64-bit keys.  Blocks
send each bucket one packed row of their sorted keys there; a bucket answers each block with one
packed row.  Neither depends on how often a key occurs: a block sends a key once, so a key that a
third of all documents hold costs a row's share per block and no more.

Blocks follow the ids.  Their bounds are quantiles, by bytes, of a sample of the ids, so that neither
gaps nor outliers among the ids matter; blocks and buckets keep their size and grow in number with the
corpus (above some terabytes of text blocks grow instead, so that their bounds stay below MOST_BOUNDS). Rows of an
id too heavy for one block, and rows without an id, are dealt over several *parts*.  A block's
number begins with its rank: of two blocks with different ranks the smaller
number holds the smaller ids, and parts of one rank hold the same id. Rows without an id have the last rank.
It ends with a salt, chosen so that Spark's hash deals the blocks evenly over the tasks; so do the numbers of buckets.

Where blocks and buckets are so many that a row would hold fewer than LEAST_KEYS keys, the exchange
has two levels: rows of several blocks for a coarse bucket are merged into one, which is dealt on to the fine
buckets and whose answers are dealt back.

Everything goes through Spark's shuffle, which recovers from lost executors; the text is shuffled
once by block and that exchange is used again in later steps of the same plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Bytes of text that a block aims at, and of packed keys that a bucket aims at.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Keys that a packed row should hold at least.
LEAST_KEYS = 64
#: Bounds between blocks travel with the plan: so many at most, then blocks grow.
MOST_BOUNDS = 1 << 20
#: Points of the first sample, and points a block that bounds are drawn from.
POINTS, POINTS_A_BLOCK = 1 << 15, 8
PART_BITS, SALT_BITS = 20, 6
#: Blocks and buckets that a task takes.
A_TASK = 2
SEED = 11

PACKED = "block long, bucket long, data binary"

#: Sorted keys, and columns beside them: arrays of numbers from 0, or lists of bytes.
Section = tuple[np.ndarray, list]


# ---------------------------------------------------------------- blocks


def _points(rows: DataFrame, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether null, bytes each stands for): rows fall into random groups, which one row chosen by its bytes stands for."""
    got = (
        rows.select("id", (F.octet_length("text") + 16).alias("bytes"), F.floor(F.rand(SEED) * points).alias("g"), F.rand(SEED + 1).alias("draw"))
        .groupBy("g").agg(F.min_by(F.struct("id"), -F.log(1.0 - F.col("draw")) / F.col("bytes")).alias("one"), F.sum("bytes").alias("bytes"))
        .select("one.id", "bytes").toArrow()
    )
    ids = got.column("id")
    return ids.fill_null(0).to_numpy().astype(np.int64), pc.is_null(ids).to_numpy(zero_copy_only=False).astype(bool), got.column("bytes").to_numpy().astype(np.int64)


def bounds(ids: np.ndarray, weights: np.ndarray, block_bytes: int) -> tuple[list[int], list[int]]:
    """(first ids of all ranks but the first, parts of each rank) from a weighted sample."""
    if not len(ids):
        return [], [1]
    values, place = np.unique(ids, return_inverse=True)
    held, often = np.bincount(place, weights=weights), np.bincount(place)
    heavy = (held > 2 * block_bytes) & (often > 1)
    middle = np.cumsum(held) - held / 2
    number = (middle // block_bytes).astype(np.int64)
    new = np.append(True, number[1:] != number[:-1])
    found = {int(v): 1 for v in values[new]}
    for value in values[heavy].tolist():
        if value < (1 << 63) - 1:
            found.setdefault(value + 1, 1)
    found |= {int(v): int(np.ceil(w / block_bytes)) for v, w in zip(values[heavy], held[heavy])}
    if not heavy[0]:
        del found[int(values[0])]  # the first rank begins below all
    starts = sorted(found)
    return starts, [1, *[found[s] for s in starts]]


def _numbers(values: Sequence[int]) -> Column:
    """A constant array; as text in the plan, which the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def rank_of(value: Column, starts: Sequence[int]) -> Column:
    """How many of the ascending ``starts`` are at most ``value``: a binary search in an expression."""
    if not len(starts):
        return F.lit(0).cast("int")
    steps = [1 << k for k in range(len(starts).bit_length())][::-1]
    padded = _numbers([*starts, *[(1 << 63) - 1] * ((1 << len(steps)) - 1 - len(starts))])
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) <= value, at + step).otherwise(at))
    return F.least(found, F.lit(len(starts)))


def blocked(
    docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = (), block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, int, int]:
    """(documents as (id long, text, carry struct if any, block), number of blocks, bytes of text).

    One aggregation draws the sample and counts the bytes; a second one only where the first sample is too coarse.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []),
    )
    ids, nameless, weights = _points(rows, POINTS)
    total = int(weights.sum())
    block_bytes = max(block_bytes, total // MOST_BOUNDS)
    needed = POINTS_A_BLOCK * (total // block_bytes)
    if needed > POINTS:
        ids, nameless, weights = _points(rows, needed)
    starts, parts = bounds(ids[~nameless], weights[~nameless], block_bytes)
    parts.append(max(1, int(np.ceil(weights[nameless].sum() / block_bytes))))
    rank = F.when(F.col("id").isNull(), F.lit(len(parts) - 1)).otherwise(rank_of(F.col("id"), starts))
    blocks = sum(parts)
    tasks = _tasks(docs, blocks)
    numbers = salted(np.concatenate([(k << PART_BITS) + np.arange(n) for k, n in enumerate(parts)]), tasks)
    if max(parts) > 1:
        # Rows of a scan or of a file read again are numbered alike in every attempt.
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(_numbers(parts), rank + 1)).cast("int")
        rank = F.element_at(_numbers(np.cumsum([0, *parts[:-1]]).tolist()), rank + 1).cast("int") + dealt
    return rows.withColumn("block", F.element_at(_numbers(numbers.tolist()), rank + 1)).repartition(tasks, "block"), blocks, total


def _tasks(frame: DataFrame, units: int) -> int:
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units // A_TASK))


def murmur(values: np.ndarray) -> np.ndarray:
    """Murmur3 of 64-bit numbers with Spark's seed, by which Spark deals rows out."""
    u = np.uint32
    turn = lambda x, k: (x << u(k)) | (x >> u(32 - k))
    with np.errstate(over="ignore"):
        h = np.full(values.shape, 42, dtype=u)
        for half in (values & 0xFFFFFFFF, (values >> 32) & 0xFFFFFFFF):
            h ^= turn(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
            h = turn(h, 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> u(shift))) * u(factor)
        return (h ^ (h >> u(16))).astype(np.int32)


def salted(numbers: np.ndarray, tasks: int) -> np.ndarray:
    """The numbers with a salt behind each that leads to the emptiest of the tasks it can choose from."""
    salts = np.asarray(numbers, dtype=np.int64)[:, None] << SALT_BITS | np.arange(1 << SALT_BITS)
    places = murmur(salts).astype(np.int64) % tasks
    load, out = np.zeros(tasks, dtype=np.int64), np.empty(len(salts), dtype=np.int64)
    for k, choice in enumerate(places):
        best = int(load[choice].argmin())
        load[choice[best]] += 1
        out[k] = salts[k, best]
    return out


def ranks(blocks: np.ndarray) -> np.ndarray:
    return blocks >> PART_BITS + SALT_BITS


def order(table: pa.Table) -> np.ndarray:
    """Ids as numbers that order a block's rows; in the rank of the nameless all are alike."""
    return table.column("id").fill_null(0).to_numpy().astype(np.int64)


# ---------------------------------------------------------------- buckets


@dataclass(frozen=True)
class Deal:
    """Bits of the bucket number that blocks deal by; if ``fine`` exceeds it, merged rows of ``groups`` of blocks are dealt on by that many bits.

    ``numbers`` are the salted numbers of the buckets, if there is one level.
    """

    bits: int
    fine: int
    groups: int
    tasks: int = 0
    numbers: tuple[int, ...] = ()


def deal(packed_bytes: float, blocks: int, keys_a_block: float, bucket_bytes: int = BUCKET_BYTES, least_keys: int = LEAST_KEYS) -> Deal:
    wanted = int(np.round(np.log2(max(1.0, packed_bytes / bucket_bytes))))
    most = max(0, int(np.log2(max(1.0, keys_a_block / least_keys))))
    if wanted <= most + 1:
        return Deal(min(wanted, most + 1), min(wanted, most + 1), 1)
    a_row = max(1.0, packed_bytes / blocks / (1 << most))
    return Deal(most, wanted, max(1, int(np.ceil(blocks * a_row / bucket_bytes))))


def evenly(dealt: Deal, frame: DataFrame) -> Deal:
    """The deal with numbers of buckets that Spark deals evenly over its tasks."""
    if dealt.fine > dealt.bits:
        return dealt
    tasks = _tasks(frame, 1 << dealt.bits)
    return replace(dealt, tasks=tasks, numbers=tuple(salted(np.arange(1 << dealt.bits), tasks).tolist()))


# ---------------------------------------------------------------- packing


def join(parts: Iterable[bytes]) -> bytes:
    """Several byte strings as one."""
    parts = list(parts)
    return np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes() + b"".join(parts)


def part(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 4))]).astype(np.int64)
    return [data[ends[i] : ends[i + 1]] for i in range(n)]


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences, without low bits that all lack, of as few bytes as the largest needs.

    Differences are about exponential, so that their highest bytes are few different ones: these are compressed.
    """
    if not len(keys):
        return b""
    steps = np.diff(keys)
    used = int(np.bitwise_or.reduce(steps)) if len(steps) else 0
    shift = (used & -used).bit_length() - 1 if used else 0
    steps >>= np.uint64(shift)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    rest = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)
    low = np.ascontiguousarray(rest[:, : width - 1]).tobytes()
    return bytes([width, shift]) + np.array([len(steps)], "<u4").tobytes() + keys[:1].astype("<u8").tobytes() + low + zlib.compress(np.ascontiguousarray(rest[:, width - 1]).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    width, shift, n, first = data[0], data[1], int(np.frombuffer(data, "<u4", 1, 2)[0]), np.frombuffer(data, "<u8", 1, 6)
    steps = np.zeros((n + 1, 8), dtype=np.uint8)
    end = 14 + n * (width - 1)
    steps[1:, : width - 1] = np.frombuffer(data, np.uint8, n * (width - 1), 14).reshape(n, width - 1)
    steps[1:, width - 1] = np.frombuffer(zlib.decompress(data[end:]), np.uint8)
    steps = steps.reshape(-1).view("<u8")
    steps <<= np.uint64(shift)
    steps[0] = first[0]
    return np.cumsum(steps, dtype=np.uint64)


def pack_column(values: np.ndarray | list[bytes]) -> bytes:
    """Numbers from 0 in 1 bit, or in 1, 2, 4 or 8 bytes; few numbers from 255 on stand behind the others, which are compressed.

    Strings are packed as their sizes and one compressed whole.
    """
    if isinstance(values, list):
        return b"\x09" + join([pack_column(np.array([len(v) for v in values], dtype=np.uint64)), zlib.compress(b"".join(values), 1)])
    top = int(values.max()) if len(values) else 0
    if top <= 1:
        return b"\x00" + np.array([len(values)], "<u4").tobytes() + zlib.compress(np.packbits(values.astype(bool)).tobytes(), 1)
    large = values >= 255
    if 10 * np.count_nonzero(large) <= len(values):
        return b"\x01" + join([zlib.compress(np.where(large, 255, values).astype(np.uint8).tobytes(), 1), values[large].astype("<u8").tobytes()])
    width = next(w for w in (2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack_column(data: bytes) -> np.ndarray | list[bytes]:
    width = data[0]
    if width == 9:
        sizes, whole = part(data[1:])
        ends = [0, *np.cumsum(unpack_column(sizes).astype(np.int64)).tolist()]
        whole = zlib.decompress(whole)
        return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
    if not width:
        return np.unpackbits(np.frombuffer(zlib.decompress(data[5:]), np.uint8), count=int(np.frombuffer(data, "<u4", 1, 1)[0])).astype(np.uint64)
    if width == 1:
        small, large = part(data[1:])
        values = np.frombuffer(zlib.decompress(small), np.uint8).astype(np.uint64)
        values[values == 255] = np.frombuffer(large, "<u8")
        return values
    return np.frombuffer(data, f"<u{width}", offset=1).astype(np.uint64)


def pack_section(keys: np.ndarray, columns: list) -> bytes:
    return join([pack(keys), *map(pack_column, columns)]) if len(keys) else b""


def unpack_section(data: bytes) -> Section | None:
    if not data:
        return None
    keys, *columns = part(data)
    keys = unpack(keys)
    return keys, [unpack_column(c) for c in columns]


def together(columns: list) -> np.ndarray | list[bytes]:
    """One column of several blocks' shares."""
    if columns and isinstance(columns[0], list):
        return [v for c in columns for v in c]
    return np.concatenate([np.zeros(0, np.uint64), *columns])


def _rows(block: Sequence[int], bucket: Sequence[int], data: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})


def _settled(table: pa.Table) -> pa.Table:
    settle()
    return table


def _shares(sections: list[Section], bits: int, first: int, last: int, every: bool) -> Iterator[tuple[int, list[Section]]]:
    """(bucket, its share of every section) for the buckets from ``first`` to ``last``; empty ones only if ``every``."""
    if not bits:
        yield 0, sections
        return
    edges = np.arange(first + 1, last + 1, dtype=np.uint64) << np.uint64(64 - bits)
    cuts = [np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).tolist() for keys, _ in sections]
    for k in range(last - first + 1):
        if every or any(c[k + 1] > c[k] for c in cuts):
            yield first + k, [(keys[c[k] : c[k + 1]], [v[c[k] : c[k + 1]] for v in columns]) for (keys, columns), c in zip(sections, cuts)]


def _packed(blocks: np.ndarray, share: list[Section], kept: list[Section] = ()) -> bytes:
    """A packed row: the senders' blocks, what comes back as it is, and the sections."""
    echo = join([pack_column(c) for _, columns in kept for c in columns]) if kept else b""
    return join([np.asarray(blocks, dtype="<i8").tobytes(), echo, *[pack_section(*s) for s in share]])


def _outgoing(block: int, sections: list[Section], dealt: Deal, every: bool, kept: list[Section] = ()) -> pa.Table:
    n = len(sections)
    shares = list(_shares([*sections, *kept], dealt.bits, 0, (1 << dealt.bits) - 1, every))
    return _rows([block] * len(shares), [dealt.numbers[b] if dealt.numbers else b for b, _ in shares], [_packed([block], s[:n], s[n:]) for _, s in shares])


def send(docs: DataFrame, dealt: Deal, work: Callable[[pa.Table], list[Section]], every: bool = False) -> DataFrame:
    """``work(documents of a block in order of id)`` gives sections; each bucket gets its share of all. ``every``: empty shares too."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        return _settled(_outgoing(block, work(table.sort_by("id")), dealt, every))

    return docs.groupBy("block").applyInArrow(run, PACKED)


def send_on(docs: DataFrame, answers: DataFrame, dealt: Deal, work: Callable[[pa.Table, Callable], tuple[list[Section], list[Section]]]) -> DataFrame:
    """Like ``send``, after an exchange before: ``work`` also takes ``got`` (see ``finish``).

    It gives the sections, and sections whose columns come back as they are: what the next step would else have to find again.
    """

    def run(table: pa.Table, got: Callable) -> pa.Table:
        sections, kept = work(table, got)
        return _outgoing(table.column("block")[0].as_py(), sections, dealt, False, kept)

    return finish(docs, answers, run, PACKED)


#: Takes (keys, number of the block that sent each, columns) for every section, gives answer columns for every section and numbers to be summed over buckets.
Work = Callable[[list[tuple[np.ndarray, np.ndarray, list]]], tuple[list[list[np.ndarray]], Sequence[int]]]


def _answered(data: list[bytes], work: Work) -> list[bytes]:
    """Answers to the packed rows of one bucket."""
    opened = [part(d) for d in data]
    senders = [np.frombuffer(o[0], "<i8") for o in opened]
    asked, lengths = [], []
    for s in range(2, len(opened[0])):
        keys, blocks, columns, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
        for sender, o in zip(senders, opened):
            section = unpack_section(o[s])
            sizes.append(len(section[0]) if section else 0)
            if section:
                own = section[1]
                if len(sender) > 1:
                    blocks.append(sender[own[0].astype(np.int64)])
                    own = own[1:]
                else:
                    blocks.append(np.repeat(sender, len(section[0])))
                keys.append(section[0])
                columns.append(own)
        asked.append((np.concatenate(keys), np.concatenate(blocks), [together(list(c)) for c in zip(*columns)]))
        lengths.append(np.concatenate([[0], np.cumsum(sizes)]))
    given, note = work(asked)
    note = np.asarray(note, dtype="<i8").tobytes()
    return [
        join([note, opened[k][1], *[join([pack_column(c[at[k] : at[k + 1]]) for c in columns]) if at[k + 1] > at[k] else b"" for columns, at in zip(given, lengths)]])
        for k in range(len(data))
    ]


def _gathered(answers: list[bytes]) -> tuple[list[list[np.ndarray]], np.ndarray, list]:
    """Answer columns for every section in order of key, the sum of the notes, and the columns that were kept."""
    notes, found, kept = np.zeros(0, np.int64), [], []
    for data in answers:
        note, echo, *sections = part(data)
        note = np.frombuffer(note, "<i8")
        notes = note + notes if len(notes) else note
        found = found or [[] for _ in sections]
        for f, section in zip(found, sections):
            if section:
                f.append([unpack_column(c) for c in part(section)])
        if echo:
            kept.append([unpack_column(c) for c in part(echo)])
    return [[together(list(c)) for c in zip(*f)] for f in found], notes, [together(list(c)) for c in zip(*kept)]


def answer(sent: DataFrame, dealt: Deal, work: Work, every: bool = False) -> DataFrame:
    """(block, bucket, data): what goes back to each block."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return _settled(_rows(table.column("block").to_pylist(), table.column("bucket").to_pylist(), _answered(table.column("data").to_pylist(), work)))

    if dealt.fine <= dealt.bits:
        if dealt.tasks:
            sent = sent.repartition(dealt.tasks, "bucket")
        return sent.groupBy("bucket").applyInArrow(bucket, PACKED)

    def merged(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[Section], list[np.ndarray]]:
        """(blocks, their keys in every section, merged sections with the sender's place as first column, order of merging)."""
        blocks, opened = table.column("block").to_numpy(), [part(d) for d in table.column("data").to_pylist()]
        sections, orders, counts = [], [], []
        for s in range(2, len(opened[0])):
            own = [unpack_section(o[s]) for o in opened]
            counts.append(np.array([len(o[0]) if o else 0 for o in own]))
            keys = np.concatenate([np.zeros(0, np.uint64), *[o[0] for o in own if o]])
            way = np.argsort(keys, kind="stable")
            member = np.repeat(np.arange(len(own), dtype=np.uint64), counts[-1])
            columns = [together(list(c)) for c in zip(*[o[1] for o in own if o])]
            columns = [[c[k] for k in way.tolist()] if isinstance(c, list) else c[way] for c in columns]
            sections.append((keys[way], [member[way], *columns] if len(own) > 1 else columns))
            orders.append(way)
        return blocks, counts, sections, orders

    def fine_shares(table: pa.Table, sections: list[Section]) -> list[tuple[int, list[Section]]]:
        coarse, more = table.column("bucket")[0].as_py(), dealt.fine - dealt.bits
        return list(_shares(sections, dealt.fine, coarse << more, ((coarse + 1) << more) - 1, every))

    def onward(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks, _, sections, _ = merged(table)
        unit = table.column("unit")[0].as_py()
        shares = fine_shares(table, sections)
        return _settled(_rows([unit] * len(shares), [b for b, _ in shares], [_packed(blocks, s) for _, s in shares]))

    def back(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], [], [])
        table = table.sort_by("block")
        blocks, counts, sections, orders = merged(table)
        columns, note, _ = _gathered(answers.sort_by("bucket").column("data").to_pylist())
        echoes = [part(d)[1] for d in table.column("data").to_pylist()]
        ends = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        for s, way in enumerate(orders):
            for c, values in enumerate(columns[s]):
                columns[s][c] = np.empty_like(values)
                columns[s][c][way] = values
        out = [
            join([note.astype("<i8").tobytes(), echoes[k], *[join([pack_column(v[at[k] : at[k + 1]]) for v in own]) if at[k + 1] > at[k] else b"" for own, at in zip(columns, ends)]])
            for k in range(len(blocks))
        ]
        return _settled(_rows(blocks.tolist(), table.column("bucket").to_pylist(), out))

    group = F.pmod(F.xxhash64("block"), F.lit(dealt.groups))
    units = sent.withColumn("unit", F.shiftleft(group, dealt.bits) + F.col("bucket"))
    answers = units.groupBy("unit").applyInArrow(onward, PACKED).groupBy("bucket").applyInArrow(bucket, PACKED)
    return units.groupBy("unit").cogroup(answers.groupBy("block")).applyInArrow(back, PACKED)


def finish(docs: DataFrame, answers: DataFrame, work: Callable[[pa.Table, Callable], pa.Table], schema) -> DataFrame:
    """``work(documents of a block in order of id, got)`` gives the result's rows.

    ``got(sections)`` takes what the block sent and gives the answer columns of every section; ``got.note`` is the sum of the notes
    and ``got.kept`` the columns that came back as they were.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answered, note, kept = _gathered(right.sort_by("bucket").column("data").to_pylist())

        def got(sections: list[Section]) -> list[list[np.ndarray]]:
            if any(len(c) != len(keys) for (keys, _), columns in zip(sections, answered) for c in columns) or (not answered and any(len(k) for k, _ in sections)):
                raise ValueError("answers don't fit what was sent")
            return answered or [[] for _ in sections]

        got.note, got.kept, got.answered = note, kept, answered
        return _settled(work(left.sort_by("id"), got))

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
