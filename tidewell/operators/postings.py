"""The stored inverted index: blocks of postings with bounds of their scores, hot terms over many parts, updates by segments.

Posts are dealt into *blocks* of about BLOCK posts of like length. A row of ``postings`` holds one term's occurrences in one block;
``heads`` holds the same rows without them: how many posts, the most occurrences and the shortest post, from which follows
an upper bound of what the term can add to a score there, whatever the corpus' mean length comes to be. Posts of like length
together make bounds tight. ``top`` scores the blocks of the best bounds first, and after them only blocks whose bound reaches the
k-th best score so far: exact, ties included, as it leaves out nothing that could still enter.

A *segment* is what one update adds: its own blocks in its own parts. What was stored before isn't touched; posts that went or were
replaced are listed in ``dead``, with the terms they no longer count for in ``less``. ``differences`` finds what doesn't fit the texts.

Postings name posts by their place in the block; a row of each block without a term holds the ids and lengths.

A part is segment * SEGMENT + shard. Heads lie by the hash of their term, so that a query reads one part of each segment and term; postings too,
but a term that by its share of a group's posts has more than SPAN blocks' posts is spread over as many parts as it has times that; its heads say where
they lie. Shards are as many as the segment's postings need. So no part, and no task that writes or reads one, grows with a term.

Edge cases: a null text has no token, and its post a length of 0; a post that is given twice is an error of the caller's; a clause
without a token matches nothing; an index of no post matches nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem
from . import commits
from .commits import PART, Snapshot, Write
from .state import checkpoint_dir
from .search import B, K1, LEAST_IDF, SLICE, Clauses, normal, score, stems_of, token_column

#: Posts of a block; blocks of one term in a part; postings that a shard is meant for.
BLOCK, SPAN, SHARD_POSTINGS = 256, 64, 4_000_000
#: Blocks, or tokens, of the posts that one group of the building holds.
GROUP_BLOCKS, GROUP_TOKENS = 16, 1_000_000
SEGMENT = 1 << 20
#: Blocks that are scored before any bound is compared.
FIRST_BLOCKS = 32
#: Posts of a group that a term must be in for it to be spread; buckets of parts that a group sends rows to.
LEAST_HOT, MOST_BUCKETS = 4, 1024
#: Tasks that read postings to mark posts, rows of which one marks at a time, and posts that it holds sums of.
MARKERS, ROWS_MARKED, MOST_MARKED = 64, 2048, 1 << 24
TABLES = ("postings", "heads", "posts", "facts", "dead", "less")
#: Relative room for the rounding of bounds.
ROOM = 1e-9


def _class(n: Column) -> Column:
    """Posts whose lengths differ by a fifth at most."""
    return F.floor(4 * F.log2(n + 1)).cast("int")


#: A row of ``postings``. Of a term in a block: which of the block's posts hold it, up to where each one's positions go, and the positions. Of no term:
#: the block's posts and their lengths.
HELD = "part int, term string, block int, who array<smallint>, ends array<int>, places array<int>, posts long, most int, shortest int, ids array<string>, n array<int>"
ROWS = pa.schema([
    ("part", pa.int32()), ("term", pa.string()), ("block", pa.int32()), ("who", pa.list_(pa.int16())), ("ends", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
    ("posts", pa.int64()), ("most", pa.int32()), ("shortest", pa.int32()), ("ids", pa.list_(pa.string())), ("n", pa.list_(pa.int32())),
])


def _held(ids: pa.Array, words: pa.Array, block: int, stems: bool) -> pa.RecordBatch:
    """The rows of one block, without their part: one a term, and one without a term for the posts themselves."""
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    known = words.flatten().dictionary_encode()
    names = known.dictionary.to_pylist()
    terms, of = np.unique(np.array([stem(w) for w in names] if stems else names, dtype=object), return_inverse=True)
    code = of[known.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
    post, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(code, kind="stable")  # posts and places ascend already
    code, post, place = code[order], post[order], place[order]
    fresh = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(post) != 0)]) if len(code) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(code[fresh]) != 0]) if len(fresh) else np.zeros(0, np.int64)
    who, often = post[fresh], np.diff(np.r_[fresh, len(code)])
    most, shortest = (np.maximum.reduceat(often, first), np.minimum.reduceat(n[who], first)) if len(first) else (first, first)
    posts = np.diff(np.r_[first, len(fresh)])
    ends = fresh + often - np.repeat(fresh[first], posts)
    # The posts themselves come last.
    lists = lambda starts, values, kind: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(kind)))
    of_term, at = np.r_[first, len(fresh), len(fresh)], np.r_[fresh[first], len(code), len(code)]
    last, none = pa.array(np.r_[np.zeros(len(first) + 1), len(n)].astype(np.int32)), pa.array(np.r_[np.ones(len(first), bool), False])
    numbers = lambda x, own, kind: pa.array(np.r_[x, own].astype(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*terms.tolist(), None], pa.string()), pa.array(np.full(len(first) + 1, block, np.int32)), lists(of_term, who, np.int16), lists(of_term, ends, np.int32), lists(at, place, np.int32),
            numbers(posts, len(n), np.int64), numbers(most, 0, np.int32), numbers(shortest, n.min(), np.int32),
            pa.ListArray.from_arrays(last, ids, mask=none), pa.ListArray.from_arrays(last, pa.array(n.astype(np.int32)), mask=none),
        ],
        ROWS.names[1:],
    )


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])))
def placed(words: pa.Array, stems: pa.Array) -> pa.Array:
    """Each text's different terms with their positions."""
    out = []
    for start in range(0, len(words), SLICE):
        rows = words.slice(start, SLICE)
        n = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten()
        known = (stems_of(flat) if stems[start].as_py() else flat).dictionary_encode()
        post, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = known.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((place, code, post))
        code, post, place = code[order], post[order], place[order]
        fresh = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(post) != 0)]) if len(code) else np.zeros(0, np.int64)
        positions = pa.ListArray.from_arrays(pa.array(np.r_[fresh, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))
        one = pa.StructArray.from_arrays([known.dictionary.take(pa.array(code[fresh])), positions], ["term", "positions"])
        ends = np.searchsorted(post[fresh], np.arange(len(n) + 1))
        out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), one))
    return pa.concat_arrays(out)


def _dealt(rows: list[pa.RecordBatch], shards: int, buckets: int, first_part: int, hot: float) -> Iterator[pa.RecordBatch]:
    """A group's rows with their parts, packed by bucket: (bucket, size, packed). A term goes over as many parts as it fills ``hot`` of the group's posts."""
    table = pa.Table.from_batches(rows).combine_chunks()
    known = table.column("term").combine_chunks().dictionary_encode()
    names, code = known.dictionary.to_pylist(), known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    block, posts = table.column("block").to_numpy().astype(np.int64), table.column("posts").to_numpy()
    often = np.bincount(code[code >= 0], posts[code >= 0], len(names))
    parts = np.where(often >= LEAST_HOT, np.ceil(often / posts[code < 0].sum() / hot), 1).astype(np.int64)
    home = np.array([zlib.crc32(w.encode()) for w in names] + [0], np.int64)  # the last one: without a term
    part = (home[code] + block % np.maximum(1, np.r_[parts, shards])[code]) % shards
    rank = np.empty(len(names) + 1, np.int64)
    rank[np.r_[np.argsort(np.array(names, dtype=object)), len(names)].astype(np.int64)] = np.arange(len(names) + 1)
    bucket = part * buckets // shards
    order = np.lexsort((block, rank[code], part))
    table = pa.Table.from_arrays([pa.array((part + first_part).astype(np.int32)), *table.columns], names=ROWS.names).cast(ROWS).take(pa.array(order))
    whole, bucket = table.combine_chunks().to_batches()[0], bucket[order]
    starts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
    data = [whole.slice(a, b - a).serialize() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])]
    packed = pa.array([pa.compress(d, "zstd", asbytes=True) for d in data], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array([d.size for d in data], pa.int64()), packed], ["bucket", "size", "packed"])


def _blocks(stems: bool, per: int, *deal):
    """Rows (canonical_id, words, base), those of a base together, to packed rows of ``HELD``: ``per`` posts a block, counted from the base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, at, base = [], [], 0, None  # slices of the block that is open, blocks of the group, the block, its group's first one

        def close() -> None:
            if held:
                made.append(_held(pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), at, stems))
                held.clear()

        def away() -> Iterator[pa.RecordBatch]:
            close()
            if made:
                yield from _dealt(made, *deal)
                made.clear()

        for batch in batches:
            ids, words, bases = batch.columns
            start = 0
            firsts = bases.to_numpy()
            while start < batch.num_rows:
                if firsts[start] != base:
                    yield from away()
                    base = at = int(firsts[start])
                same = int(np.searchsorted(firsts[start:] != base, True))
                took = min(same, per - sum(len(h[0]) for h in held))
                held.append((ids.slice(start, took), words.slice(start, took)))
                start += took
                if sum(len(h[0]) for h in held) == per:
                    close()
                    at += 1
        yield from away()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(packed.as_buffer(), size, "zstd")), ROWS)


def segment_tables(posts: DataFrame, segment: int, first_block: int, stems: bool) -> tuple[dict[str, DataFrame], int]:
    """(tables of a segment, its number of blocks).

    Texts are shuffled once, by group: posts of one class of lengths and one hash, GROUP_BLOCKS blocks or GROUP_TOKENS tokens of them. A task
    makes a group's blocks one after the other and sends each bucket of parts one packed row; posts and heads are read from the postings that
    are written.
    """
    spark = posts.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = F.size(token_column(text))
    sizes = posts.select(size.alias("n")).groupBy(_class(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("tokens")).collect()  # a row a class
    starts, at = {}, first_block
    for r in sorted(sizes, key=lambda r: r["c"]):
        groups = max(1, -(-r["posts"] // (BLOCK * GROUP_BLOCKS)), -(-r["tokens"] // GROUP_TOKENS))
        room = 4 * -(-r["posts"] // (BLOCK * groups)) + 4  # blocks of a group: hashes deal unevenly
        starts[r["c"]] = (at, groups, room)
        at += groups * room
    told = {"posts": sum(r["posts"] for r in sizes), "tokens": sum(r["tokens"] for r in sizes)}
    entry = F.create_map(*[x for c, (start, groups, room) in starts.items() for x in (F.lit(c), F.struct(F.lit(start).alias("start"), F.lit(groups).alias("groups"), F.lit(room).alias("room")))])[_class(size)] if starts else None
    base = (entry["start"] + F.pmod(F.xxhash64("canonical_id"), entry["groups"]) * entry["room"]).cast("int") if starts else F.lit(0)
    shards = 1 << max(0, math.ceil(math.log2(max(1, told["tokens"] / SHARD_POSTINGS))))
    buckets, part = min(shards, MOST_BUCKETS), segment * SEGMENT

    # In the order of ids, so that a task that is run again makes the same blocks.
    dealt = posts.select("canonical_id", text.alias("text"), base.alias("base")).repartition("base").sortWithinPartitions("base", "canonical_id")
    hot = SPAN * BLOCK / max(1, told["posts"])
    packed = dealt.select("canonical_id", token_column(F.col("text")).alias("words"), "base").mapInArrow(_blocks(stems, BLOCK, shards, buckets, part, hot), "bucket int, size long, packed binary")
    rows = packed.repartition(2 * buckets, "bucket").select("size", "packed").mapInArrow(_unpacked, HELD)
    own, none = F.lit(part).cast("int"), spark.createDataFrame([], f"{PART} int, canonical_id string, block int, term string, posts long")

    def kept(written: Snapshot) -> DataFrame:
        return written.read("postings").where("term is null").select(own.alias(PART), "block", F.explode(F.arrays_zip("ids", "n")).alias("p")).select(PART, F.col("p.ids").alias("canonical_id"), "p.n", "block")

    def heads(written: Snapshot) -> DataFrame:
        home = (F.pmod(F.crc32("term"), F.lit(shards)) + part).cast("int")
        found = written.read("postings").where("term is not null").select(home.alias(PART), "term", "block", "posts", "most", "shortest", F.col(PART).alias("lies"))
        return found.where("part = lies").unionByName(found.where("part <> lies").hint("rebalance", PART))  # hot terms alone move

    tables = {
        "postings": rows, "heads": heads, "posts": kept,
        "facts": spark.createDataFrame([(part, segment, shards, at - first_block, told["posts"], told["tokens"])], f"{PART} int, segment int, shards int, blocks int, posts long, tokens long"),
        "dead": none.select(PART, "canonical_id", "block"), "less": none.select(PART, "term", "posts"),
    }
    return tables, at - first_block


ORDERS = {"postings": ("term", "block"), "heads": ("term", "block"), "posts": ("canonical_id",), "less": ("term",)}
DEALT = ("postings", "heads")


def _writes(tables: dict, parts: list[int] | None = None) -> dict[str, Write]:
    return {n: Write(t, parts, order=ORDERS.get(n, ()), dealt=n in DEALT) for n, t in tables.items()}


def _each(rows: DataFrame, *more: str) -> DataFrame:
    """(term, block, who, positions) of rows of postings, and what else they have: one a post."""
    start = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
    each = F.transform("who", lambda w, i: F.struct(w.cast("int").alias("who"), F.slice("places", start(i) + 1, F.get("ends", i) - start(i)).alias("positions")))
    return rows.select("term", "block", *more, F.explode(each).alias("p")).select("term", "block", *more, "p.*")


def _marks(terms: list[str], code: np.ndarray, place: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64 bits for each token: of its term, its place in the post, and which of the term's places that is."""
    own = np.frombuffer(b"".join(blake2b(t.encode(), digest_size=8).digest() for t in terms), np.uint64)
    x = own[code] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _halves(sums: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The upper and the lower 32 bits, of which sums don't overflow."""
    return pa.array((sums >> np.uint64(32)).astype(np.int64)), pa.array((sums & np.uint64(0xFFFFFFFF)).astype(np.int64))


@F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())]))
def marked(words: pa.Array, stems: pa.Array) -> pa.Array:
    """Each text's number of tokens and the sum of their marks."""
    out = []
    for start in range(0, len(words), SLICE):
        rows = words.slice(start, SLICE)
        n = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten()
        known = (stems_of(flat) if stems[start].as_py() else flat).dictionary_encode()
        code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        post, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(post * max(1, len(known.dictionary)) + code, kind="stable")
        code, post, place = code[order], post[order], place[order]
        fresh = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(post) != 0)]) if len(code) else np.zeros(0, np.int64)
        nth = np.arange(len(code)) - np.repeat(fresh, np.diff(np.r_[fresh, len(code)]))
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(_marks(known.dictionary.to_pylist(), code, place, nth), dtype=np.uint64)]
        ends = np.cumsum(n)
        out.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), *_halves(total[ends] - total[ends - n])], ["n", "high", "low"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of postings to the sums of marks of each block's posts, as 64-bit numbers in a row, once a block."""
    blocks: dict[int, int] = {}
    held = np.zeros((0, 0), np.uint64)

    def out() -> Iterator[pa.RecordBatch]:
        names = list(blocks)
        for start in range(0, len(names), 1024):
            some = names[start : start + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([held[blocks[b]].tobytes() for b in some], pa.binary())], ["block", "sums"])
        blocks.clear()

    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_MARKED):
            batch = whole.slice(start, ROWS_MARKED)
            known = batch.column("term").dictionary_encode()
            some = pc.list_value_length(batch.column("who")).to_numpy(zero_copy_only=False).astype(np.int64)
            many = pc.list_value_length(batch.column("places")).to_numpy(zero_copy_only=False).astype(np.int64)
            who, ends, place = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("who", "ends", "places"))
            row = np.repeat(np.arange(len(some)), some)
            ends = ends + (np.cumsum(many) - many)[row]  # a posting's end among all places
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            often = ends - starts
            nth = np.arange(len(place)) - np.repeat(starts, often)
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(_marks(known.dictionary.to_pylist(), np.repeat(known.indices.to_numpy(zero_copy_only=False)[row], often), place, nth), dtype=np.uint64)]
            own, of = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            width = max(held.shape[1], int(who.max()) + 1)
            if len(blocks) * width > MOST_MARKED:
                yield from out()
                held = np.zeros((0, 0), np.uint64)
            at = np.array([blocks.setdefault(int(b), len(blocks)) for b in own], np.int64)
            if len(blocks) > held.shape[0] or width > held.shape[1]:
                more = np.zeros((max(2 * held.shape[0], len(blocks)), width), np.uint64)
                more[: held.shape[0], : held.shape[1]] = held
                held = more
            np.add.at(held, (at[of][row], who), total[ends] - total[starts])
    yield from out()


def _told(block: pa.Table) -> pa.Table:
    """(block, canonical_id, n, high, low) of a block's posts; sums of posts that the block doesn't name have no id."""
    sums = [np.frombuffer(b, np.uint64) for b in block.column("sums").to_pylist() if b is not None]
    named = block.filter(pc.is_valid(block.column("ids"))).combine_chunks()
    ids = [i for x in named.column("ids").to_pylist() for i in x]
    n = [i for x in named.column("n").to_pylist() for i in x]
    total = np.zeros(max([len(ids), *map(len, sums)]), np.uint64)
    for s in sums:
        total[: len(s)] += s
    more = np.flatnonzero(total[len(ids) :])  # of the width beyond the block's posts
    total = np.r_[total[: len(ids)], total[len(ids) :][more]]
    at = block.column("block")[0].as_py()
    names = [pa.array([at] * len(total), pa.int32()), pa.array(ids + [None] * len(more), pa.string()), pa.array(n + [0] * len(more), pa.int32()), *_halves(total)]
    return pa.table(names, ["block", "canonical_id", "n", "high", "low"])


class Postings:
    """One commit of a stored index."""

    def __init__(self, base: Snapshot, stems: bool = True):
        if not base.tables:
            raise FileNotFoundError(f"no index in {base.folder}")
        self.base, self.spark, self.stems = base, base.spark, stems
        self.facts = [r.asDict() for r in base.read("facts").collect()]  # a row a segment, and one for what went

    @classmethod
    def build(cls, posts: DataFrame, folder: str, stems: bool = True) -> Postings:
        """A new index of all posts."""
        base = commits.snapshot(posts.sparkSession, folder)
        tables, _ = segment_tables(posts, 0, 0, stems)
        return cls(commits.publish(base, _writes(tables)), stems)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, stems: bool = True) -> Postings:
        return cls(commits.snapshot(spark, folder), stems)

    def updated(self, gone: DataFrame, posts: DataFrame) -> Postings:
        """The next commit: without the posts in ``gone`` (canonical_id), and with ``posts``, which replace those of their ids.

        A new segment; nothing that is stored is written again. Raises ``commits.Conflict`` if the index has changed since.
        """
        segment = 1 + max(f["segment"] for f in self.facts)
        part = segment * SEGMENT
        tables, _ = segment_tables(posts, segment, sum(f["blocks"] for f in self.facts), self.stems)
        ids = gone.select("canonical_id").union(posts.select("canonical_id")).distinct()
        went = self.alive().join(ids, "canonical_id", "left_semi").select("canonical_id", "n", "block").checkpoint()
        lost = went.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        own = F.lit(part).cast("int")
        tables["dead"] = went.select(own.alias(PART), "canonical_id", "block")
        near = self._terms().join(went.select("block").distinct(), "block", "left_semi").select("block", "term", F.explode(F.transform("who", lambda w: w.cast("int"))).alias("who"))
        lost_at = self._posts().join(went.select("canonical_id", "block"), ["canonical_id", "block"], "left_semi").select("block", "who")
        tables["less"] = near.join(lost_at, ["block", "who"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("posts")).select(own.alias(PART), "term", "posts")
        f = tables["facts"]
        tables["facts"] = f.withColumn("posts", F.col("posts") - lost[0]).withColumn("tokens", F.col("tokens") - lost[1])
        shards = range(part, part + max(1, f.first()["shards"]))
        return Postings(commits.publish(self.base, _writes(tables, list(shards))), self.stems)

    # ------------------------------------------------------------ reading

    def alive(self) -> DataFrame:
        """(canonical_id, n, block) of the posts that count."""
        return self.base.read("posts").drop(PART).join(self.base.read("dead").drop(PART), ["canonical_id", "block"], "left_anti")

    def lengths(self) -> DataFrame:
        return self.alive().select("canonical_id", "n")

    def _homes(self, terms: Sequence[str]) -> list[int]:
        """Parts in which the terms' heads lie."""
        return sorted({f["segment"] * SEGMENT + zlib.crc32(t.encode()) % f["shards"] for f in self.facts for t in terms})

    def _terms(self) -> DataFrame:
        return self.base.read("postings").where("term is not null")

    def _posts(self) -> DataFrame:
        """(block, who, canonical_id, n) of all posts, those that went too."""
        rows = self.base.read("postings").where("term is null").select("block", F.posexplode(F.arrays_zip("ids", "n")).alias("who", "p"))
        return rows.select("block", "who", F.col("p.ids").alias("canonical_id"), "p.n")

    def heads(self, terms: Sequence[str]) -> DataFrame:
        return self.base.read("heads", self._homes(terms)).where(F.col("term").isin(list(terms)))

    def held(self, terms: Sequence[str], blocks: DataFrame, lies: Sequence[int] | None) -> DataFrame:
        """(canonical_id, block, n, term, positions) of living posts of some blocks."""
        rows = self.base.read("postings", lies).where(F.col("term").isin(list(terms)))
        names = self.base.read("postings").where("term is null").join(blocks.select("block"), "block", "left_semi").select("block", "ids", "n")
        rows = _each(rows.join(blocks.select("block"), "block", "left_semi")).join(names, "block")
        rows = rows.select(F.get("ids", F.col("who")).alias("canonical_id"), "block", F.get("n", F.col("who")).alias("n"), "term", "positions")
        return rows.join(self.base.read("dead").drop(PART), ["canonical_id", "block"], "left_anti")

    def found(self, clauses: Clauses, blocks: DataFrame, lies: Sequence[int] | None) -> DataFrame:
        """(canonical_id, n, f0, f1 ...) of the posts in some blocks that hold every clause."""
        terms = list(dict.fromkeys(t for c in clauses for t in c))
        at = {t: F.col(f"p{k}") for k, t in enumerate(terms)}
        posts = self.held(terms, blocks, lies).groupBy("canonical_id", "block", "n").agg(
            *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{k}") for k, t in enumerate(terms)]
        ).where(reduce(lambda a, b: a & b, [F.col(f"p{k}").isNotNull() for k in range(len(terms))]))
        shifted = lambda t, k: F.transform(at[t], lambda p: p - k)
        starts = [reduce(F.array_intersect, [shifted(t, k) if k else at[t] for k, t in enumerate(c)]) for c in clauses]
        posts = posts.select("canonical_id", "n", *[F.size(s).alias(f"f{i}") for i, s in enumerate(starts)])
        return posts.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(clauses))]))

    def _common(self, terms: Sequence[str]) -> DataFrame:
        """(block, and by term k most, shortest and lies): blocks in which all terms occur."""
        stats = [F.max(F.when(F.col("term") == t, F.struct("most", "shortest", "lies"))).alias(f"t{k}") for k, t in enumerate(terms)]
        return self.heads(terms).groupBy("block").agg(F.count(F.lit(1)).alias("__n"), *stats).where(F.col("__n") == len(terms)).drop("__n")

    def frequencies(self, clauses: Clauses) -> list[int]:
        """How many posts hold each clause: of a term from its heads, of a phrase from the blocks in which all its terms occur."""
        terms = list(dict.fromkeys(c[0] for c in clauses if len(c) == 1))
        told = {}
        if terms:
            counts = self.heads(terms).groupBy("term").agg(F.sum("posts").alias("n")).unionByName(
                self.base.read("less").where(F.col("term").isin(terms)).groupBy("term").agg((-F.sum("posts")).alias("n"))
            )
            told = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return [told.get(c[0], 0) if len(c) == 1 else self.phrase(c).count() for c in clauses]

    def phrase(self, clause: list[str]) -> DataFrame:
        """(canonical_id, n, f): the posts that hold the phrase, and how often."""
        if not clause:
            return self.lengths().limit(0).withColumn("f", F.lit(0))
        blocks = self._common(list(dict.fromkeys(clause)))
        return self.found([clause], blocks, None).withColumnRenamed("f0", "f")

    def _statistics(self, clauses: Clauses) -> dict[str, float]:
        posts, tokens = sum(f["posts"] for f in self.facts), sum(f["tokens"] for f in self.facts)
        return {"docs": posts, "mean": tokens / posts if posts else 1.0} | {f"d{i}": d for i, d in enumerate(self.frequencies(clauses))}

    def _scored(self, rows: DataFrame, stats: dict[str, float], clauses: int) -> DataFrame:
        return rows.withColumns({k: F.lit(v) for k, v in stats.items()}).select("canonical_id", score(clauses).alias("bm25"))

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "canonical_id string, bm25 double")

    def match(self, clauses: Clauses) -> DataFrame:
        """(canonical_id, bm25) of all posts that hold every clause; lower is better."""
        clauses = normal(clauses, self.stems)
        if not all(clauses):
            return self._nothing()
        terms = list(dict.fromkeys(t for c in clauses for t in c))
        return self._scored(self.found(clauses, self._common(terms), None), self._statistics(clauses), len(clauses))

    def bounds(self, clauses: Clauses, stats: dict[str, float]) -> DataFrame:
        """(block, bound, lies): blocks that may hold a match, the best (highest) score it could have, and the parts where its postings lie."""
        terms = list(dict.fromkeys(t for c in clauses for t in c))
        at = {t: F.col(f"t{k}") for k, t in enumerate(terms)}
        total = F.lit(0.0)
        for i, c in enumerate(clauses):
            most = reduce(F.least, [at[t]["most"] for t in dict.fromkeys(c)]) if len(set(c)) > 1 else at[c[0]]["most"]
            shortest = reduce(F.greatest, [at[t]["shortest"] for t in dict.fromkeys(c)]) if len(set(c)) > 1 else at[c[0]]["shortest"]
            ratio = (stats["docs"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)
            idf = math.log(ratio) if ratio > 1 else LEAST_IDF
            f = most.cast("double")
            total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * shortest / stats["mean"]))
        return self._common(terms).select("block", (total * (1 + ROOM)).alias("bound"), F.array_distinct(F.array(*[c["lies"] for c in at.values()])).alias("lies"))

    def top(self, clauses: Clauses, k: int, among: DataFrame | None = None, first: int = FIRST_BLOCKS) -> DataFrame:
        """(canonical_id, bm25): all of the k best matches, with those that tie with the last one, and some more.

        ``among`` (canonical_id): only these count. Blocks of the ``first`` best bounds are scored; of the others only those whose bound
        reaches the k-th score found in them.
        """
        clauses = normal(clauses, self.stems)
        if not all(clauses):
            return self._nothing()
        stats = self._statistics(clauses)
        bounds = self.bounds(clauses, stats)
        chosen = bounds.orderBy(F.desc("bound"), "block").limit(first).collect()
        if not chosen:
            return self._nothing()
        kept = lambda rows: rows.join(among.select("canonical_id"), "canonical_id", "left_semi") if among is not None else rows
        blocks = self.spark.createDataFrame([(r["block"],) for r in chosen], "block int")
        best = kept(self._scored(self.found(clauses, F.broadcast(blocks), sorted({p for r in chosen for p in r["lies"]})), stats, len(clauses)))
        worst = best.orderBy("bm25").limit(k).agg(F.count(F.lit(1)).alias("n"), F.max("bm25").alias("bm25")).first()
        reach = -worst["bm25"] * (1 - ROOM) if worst["n"] == k else None
        wanted = bounds if reach is None else bounds.where(F.col("bound") >= reach)
        self.told = {"first": len(chosen), "reach": reach}
        return kept(self._scored(self.found(clauses, wanted, None), stats, len(clauses)))

    def scanned(self, clauses: Clauses, reach: float | None) -> tuple[int, int]:
        """(blocks that reach a score, blocks in which all terms occur): what ``top`` reads of what ``match`` reads."""
        clauses = normal(clauses, self.stems)
        bounds = self.bounds(clauses, self._statistics(clauses))
        return tuple(bounds.agg(F.count_if(F.lit(True) if reach is None else F.col("bound") >= reach), F.count(F.lit(1))).first())

    # ------------------------------------------------------------ integrity

    def differing(self, posts: DataFrame) -> DataFrame:
        """(canonical_id) of posts whose postings or lengths are not what their texts give; empty if the index is sound.

        Each post has one fingerprint, the sum of its tokens' marks. A task adds up what its parts hold of each block, so what moves is
        eight bytes a post and task, whatever the texts and however many posts differ.
        """
        texts = posts.select("canonical_id", marked(token_column(F.coalesce("text", F.lit(""))), F.lit(self.stems)).alias("m")).select("canonical_id", "m.*")
        sums = self._terms().select("term", "block", "who", "ends", "places").coalesce(MARKERS).mapInArrow(_sums, "block int, sums binary")
        named = self.base.read("postings").where("term is null").select("block", "ids", "n")
        found = sums.unionByName(named, allowMissingColumns=True).groupBy("block").applyInArrow(_told, "block int, canonical_id string, n int, high long, low long")
        known = found.join(self.base.read("dead").drop(PART), ["canonical_id", "block"], "left_anti").drop("block")
        sides = known.withColumn("side", F.lit(1)).unionByName(texts.withColumn("side", F.lit(-1))).where("n > 0 or high <> 0 or low <> 0")
        told = sides.groupBy("canonical_id").agg(F.sum("side").alias("posts"), *[F.sum(F.col("side") * F.col(c)).alias(c) for c in ("n", "high", "low")])
        return told.where("posts <> 0 or n <> 0 or high <> 0 or low <> 0").select("canonical_id")

    def differences(self, posts: DataFrame) -> DataFrame:
        """(term, canonical_id): postings that are not what the posts' texts give; empty if the index is sound. Only posts that differ are compared term by term."""
        checkpoint_dir(self.spark)
        told = self.differing(posts).checkpoint()
        mine = self._posts().join(self.base.read("dead").drop(PART), ["canonical_id", "block"], "left_anti").join(told, "canonical_id", "left_semi")
        at = mine.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("who", "canonical_id"))).alias("some"))  # BLOCK at most
        rows = self._terms().join(at, "block").where(F.exists("who", lambda w: F.map_contains_key("some", w.cast("int"))))
        own = _each(rows, "some").select("term", F.element_at("some", F.col("who")).alias("canonical_id"), F.xxhash64("positions").alias("h"), F.lit(1).alias("side")).where("canonical_id is not null")
        texts = posts.select("canonical_id", "text").join(told, "canonical_id", "left_semi")
        again = texts.select("canonical_id", F.explode(placed(token_column(F.coalesce("text", F.lit(""))), F.lit(self.stems))).alias("t"))
        both = own.unionByName(again.select("t.term", "canonical_id", F.xxhash64("t.positions").alias("h"), F.lit(-1).alias("side")))
        return both.groupBy("term", "canonical_id", "h").agg(F.sum("side").alias("s")).where("s <> 0").select("term", "canonical_id").distinct()
