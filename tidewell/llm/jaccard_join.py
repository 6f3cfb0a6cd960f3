"""N-gram Jaccard join in the metric space of shingle sets, by pivots, Voronoi regions, windows and recursion.

Jaccard distance 1 - |x & y| / |x | y| is a metric, so pivots cut the space into Voronoi regions: if
x is nearest to pivot p and y to q and d(x, y) <= r, then d(x, q) <= d(x, p) + 2 r and d(x, q) lies within r of
the ring of distances that q's documents have, and a document that is replicated into every region within those
windows meets all its partners.

1. Who may have a partner at all: by the overlap that d(x, y) <= r demands, partners share one of their first
   |x| - ceil((1-r)|x|) + 1 shingles, the rarest first.  Documents without a shared one there end here.
2. Regions of pivot documents: the pivot of a shared shingle is the document of the smallest number that
   holds it there; a document belongs to the region of each of its shingles' pivots (few, as the
   smallest number is mostly the same).  Partners have a pivot in common, so that regions are joined
   independently of each other, and only documents that share a rare shingle come together: no
   chains.
3. Inside a region, pivots, windows and recursion.  Regions that fit a task do it there (``Join``).
   Larger ones are split in Spark (``divide``): sampled pivots, each document in the region of the nearest, or in
   the remote one if all pivots are further than 1 - r; documents linked to a pivot take its label, and
   documents of one label needn't be compared any more, as connected ones are all that's asked for.
   A region that pivots don't divide (all distances alike) is dealt into parts: those not labelled
   like the most, in blocks, against all.

Document frequencies come from the packed exchange of blocks and buckets, so a shingle of a third of
all documents costs one key a block.  Identical sets are one vertex.  Links are decided by exact
integer comparison of set sizes (of 64-bit shingle hashes).

Edge cases: documents without a word have no shingle and link with nothing; with one to four words the
whole sequence is the only shingle; a text of any length is taken whole; repeated rows are linked to each other like
copies; rows that share an id but not the set are documents of their own, each in the group of its set; null ids come
back null, and such rows are linked with nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange
from .components import components
from .shared import cut
from .textscan import CHECK_BASE, WORD_BASE, Words, chunks, mix, polynomial, texts, windows

SIZE, PERCENT = 5, 80
#: Only so many leading bits of a shingle's hash are exchanged; a clash makes a shingle look more frequent, no more.
RARITY_BITS = 40
#: Distinct sets of a region that are joined in one task; larger regions are divided first.
TOGETHER = 800
#: Pivots of a region, and sets that are compared without more pivots.
PIVOTS, LEAF = 8, 16
#: So many regions at most are broadcast.
FEW = 200
#: A region that holds more than this share of the one it came from isn't divided again.
STUCK = 0.8


class Block:
    """Distinct shingles of each document of a block, sorted by hash."""

    def __init__(self, table: pa.Table, size: int):
        text = texts(table.column("text"))
        keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, _, offsets, data in chunks(text):
            words = Words(offsets, data)
            hashes = words.hashes(data, lower=True)
            at, key = windows(words, hashes, size)
            keys.append(key)
            rows.append(words.row[at] + i)
            few = np.flatnonzero((words.counts > 0) & (words.counts < size))
            whole = polynomial(hashes, words.bounds[few], words.bounds[few + 1], WORD_BASE)
            keys.append(mix(whole + words.counts[few].astype(np.uint64) * np.uint64(CHECK_BASE)))
            rows.append(few + i)
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        self.key, self.row = key[first], row[first]
        self.bounds = np.searchsorted(self.row, np.arange(table.num_rows + 1))
        self.short, self.place, self.count = np.unique(self.key >> np.uint64(64 - RARITY_BITS), return_inverse=True, return_counts=True)


def rarity(asked: list[tuple[np.ndarray, np.ndarray, list]]) -> tuple[list[list[np.ndarray]], list[int]]:
    """For each shingle sent: in how many documents it is."""
    keys, _, columns = asked[0]
    if not len(keys):
        return [[]], ()
    _, place = np.unique(keys, return_inverse=True)
    return [[np.bincount(place, weights=columns[0]).astype(np.int64)[place]]], ()


def entered(own: Block, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(by row: whether it may have a partner; by shingle: whether its document enters its region)."""
    n = np.diff(own.bounds)
    prefix = n - -(-percent * n // 100) + 1
    order = np.lexsort((own.key, frequency, own.row))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    inside = rank - own.bounds[own.row] < prefix[own.row]
    region = inside & (frequency > 1)
    return np.bincount(own.row[region], minlength=len(n)) > 0, region


class Sets:
    """Shingle sets over numbers from 0, and distances from one to many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        values, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), dtype=np.int32)

    def overlaps(self, one: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others (all sets have members)."""
        own = self.items[self.starts[one] : self.starts[one + 1]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[others] - (ends - sizes), sizes) + np.arange(ends[-1])
        found = np.add.reduceat(self.mark[self.items[at]], ends - sizes)
        self.mark[own] = 0
        return found

    def compare(self, one: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, whether linked)."""
        same = self.overlaps(one, others)
        union = self.sizes[one] + self.sizes[others] - same
        return 1.0 - same / union, 100 * same >= percent * union


class Join:
    """Exact join of sets that fit one task; links are kept as a forest."""

    def __init__(self, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None):
        self.sets, self.percent, self.radius = Sets(sets), percent, 1 - percent / 100 + 1e-9
        self.compared = 0
        self.root = np.arange(len(sets))
        if label is not None:  # those of one label are connected already
            _, first, place = np.unique(label, return_index=True, return_inverse=True)
            self.root = first[place]
        self.edges: list[tuple[int, int]] = []

    def link(self, one: int, others: np.ndarray) -> None:
        for other in others.tolist():
            a, b = self.root[one], self.root[other]
            if a != b:
                self.root[self.root == b] = a
                self.edges.append((one, other))

    def scan(self, home: np.ndarray, visitors: np.ndarray) -> None:
        """Every home document against the later home ones and the visitors that aren't connected with it yet."""
        for k, one in enumerate(home.tolist()):
            others = np.concatenate([home[k + 1 :], visitors])
            others = others[self.root[others] != self.root[one]]
            n, m = self.sets.sizes[one], self.sets.sizes[others]
            others = others[(100 * m >= self.percent * n) & (100 * n >= self.percent * m)]
            if len(others):
                self.compared += len(others)
                _, linked = self.sets.compare(one, others, self.percent)
                self.link(one, others[linked])

    def run(self, home: np.ndarray, visitors: np.ndarray) -> None:
        """Join home with itself and with the visitors (who meet elsewhere)."""
        both = np.concatenate([home, visitors])
        if len(home) == 0 or len(both) < 2 or (self.root[both] == self.root[both[0]]).all():
            return
        if len(both) <= LEAF or len(home) <= PIVOTS:
            return self.scan(home, visitors)
        # Pivots: the first, then always the one farthest from those chosen.
        pivots, distance = [int(home[0])], []
        for _ in range(PIVOTS):
            self.compared += len(both)
            d, linked = self.sets.compare(pivots[-1], both, self.percent)
            self.link(pivots[-1], both[linked])
            distance.append(d)
            nearest = np.min(distance, axis=0)
            far = int(np.argmax(nearest[: len(home)]))
            if nearest[far] <= 0:
                break
            pivots.append(int(home[far]))
        d = np.array(distance)
        least, last = d.min(axis=0), len(d)
        region = np.where(least < 1 - self.radius, d.argmin(axis=0), last)  # the last one is remote from all pivots
        is_home = np.arange(len(both)) < len(home)
        for p in range(last + 1):
            own = is_home & (region == p)
            if not own.any():
                continue
            if p < last:
                window = (d[p] <= d[p][own].max() + self.radius) & (d[p] >= d[p][own].min() - self.radius)
                window &= (region == last) | (d[p] <= least + 2 * self.radius)
            else:
                window = least >= 1 - 2 * self.radius
            guests = window & ~own & (~is_home | (region > p))
            h, v = both[own], both[guests]
            if len(h) + len(v) > 0.8 * len(both):
                self.scan(h, v)  # the space is too dense here for regions to help
            else:
                self.run(h, v)


def join_together(table: pa.Table, percent: int) -> pa.Table:
    """Links inside each region of one bucket: rows (cell, side, rep, label, set). Side 1 are guests, who are joined with those at home only."""
    a, b = [], []
    cells = table.column("cell").to_numpy()
    order = np.lexsort((table.column("rep").to_numpy(), cells))
    rep, side, label = (table.column(c).to_numpy()[order] for c in ("rep", "side", "label"))
    sets = table.column("set").take(pa.array(order)).to_pylist()
    bounds = np.flatnonzero(np.append(True, np.diff(cells[order]) != 0)).tolist() + [len(order)]
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i > 1:
            own = Join([np.frombuffer(s, "<u8") for s in sets[i:j]], percent, label[i:j])
            own.run(np.flatnonzero(side[i:j] == 0), np.flatnonzero(side[i:j] == 1))
            a += [int(rep[i + x]) for x, _ in own.edges]
            b += [int(rep[i + y]) for _, y in own.edges]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


LINKS = "a long, b long"


def shingled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, carry: Sequence[str] = ()) -> DataFrame:
    """(id, n, lo, hi, regions array<long>, set binary, carry if any): regions and set only where a partner is possible; checkpointed."""
    rows, blocks, total = exchange.blocked(docs, id_col, text_col, carry)
    dealt = exchange.evenly(exchange.deal(total / 6 * 4, blocks, total / blocks / 6), rows)
    shift = np.uint64(64 - RARITY_BITS)

    def shingles_of(own: Block) -> list[exchange.Section]:
        return [(own.short << shift, [own.count])]

    def enter(table: pa.Table, got) -> pa.Table:
        own = Block(table, size)
        found = got(shingles_of(own))[0]
        frequency = found[0].astype(np.int64)[own.place] if found else np.zeros(0, np.int64)
        able, region = entered(own, frequency, percent)
        n = np.diff(own.bounds)
        total = lambda salt: np.add.reduceat(np.append(mix(own.key ^ np.uint64(salt)), np.uint64(0)), own.bounds[:-1]).view(np.int64) if len(n) else np.zeros(0, np.int64)
        regions, sets = [], []
        for r, (i, j) in enumerate(zip(own.bounds[:-1].tolist(), own.bounds[1:].tolist())):
            regions.append(own.key[i:j][region[i:j]].view(np.int64) if able[r] else None)
            sets.append(own.key[i:j].astype("<u8").tobytes() if able[r] else None)
        return pa.table(
            {
                "id": table.column("id"), "n": pa.array(n, pa.int64()), "lo": pa.array(total(0)), "hi": pa.array(total(CHECK_BASE)),
                "regions": pa.array(regions, pa.list_(pa.int64())), "set": pa.array(sets, pa.binary()),
            }
            | ({"carry": table.column("carry")} if carry else {})
        )

    answers = exchange.answer(exchange.send(rows, dealt, lambda table: shingles_of(Block(table, size))), dealt, rarity)
    found = T._parse_datatype_string("id long, n long, lo long, hi long, regions array<long>, set binary").fields
    return cut(exchange.finish(rows, answers, enter, T.StructType(found + ([rows.schema["carry"]] if carry else []))))


def regions_of(distinct: DataFrame) -> DataFrame:
    """(cell, rep): for (rep, regions), the documents of each pivot document's region; ``cell`` is the pivot's rep.

    A region all of whose documents are in one other region of a smaller pivot is left out.
    """
    entered = distinct.select("rep", F.explode("regions").alias("s"))
    pivots = entered.groupBy("s").agg(F.min("rep").alias("cell"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "cell")
    members = cut(entered.join(pivots, "s").select("cell", "rep").distinct())
    least = members.groupBy("rep").agg(F.min("cell").alias("least"))
    spare = members.join(least, "rep").groupBy("cell").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low = high and low < cell")
    return members.join(spare.select("cell"), "cell", "left_anti")


def measured(percent: int):
    """Distances of documents (left) to their region's pivots (right): who is linked, and whose region is nearest, after the last if remote."""
    radius = 1 - percent / 100

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("rep")
        sets = [np.frombuffer(s, "<u8") for s in right.column("set").to_pylist() + left.column("set").to_pylist()]
        k, n = right.num_rows, left.num_rows
        own, others = Sets(sets), np.arange(k, k + n)
        d, linked = zip(*[own.compare(p, others, percent) for p in range(k)]) if n else ([np.zeros(0)] * k, [np.zeros(0, bool)] * k)
        d, linked = np.array(d), np.array(linked)
        near = d.argmin(axis=0)
        region = np.where(d.min(axis=0) < 1 - radius, near, k)
        flat = pa.array(d.T.reshape(-1)), pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
        at = [np.flatnonzero(row).tolist() for row in linked.T]
        return pa.table(
            {
                **{c: left.column(c) for c in ("cell", "side", "rep", "label", "set", "n")},
                "region": pa.array(region.astype(np.int32)), "d": pa.ListArray.from_arrays(flat[1], flat[0]), "linked": pa.array(at, pa.list_(pa.int32())),
                "pivots": pa.array([right.column("rep").to_pylist() if x else None for x in at], pa.list_(pa.int64())),
            }
        )

    return run


def merged_pivots(table: pa.Table) -> pa.Table:
    """(cell, p, q), pivots linked to one document, -> (cell, p, root)."""
    p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
    root = np.arange(max(p.max(), q.max()) + 1)
    for a, b in zip(p.tolist(), q.tolist()):
        low, high = sorted((root[a], root[b]))
        root[root == high] = low
    own = np.unique(np.concatenate([p, q]))
    cell = table.column("cell")[0].as_py()
    return pa.table({"cell": pa.array([cell] * len(own), pa.int64()), "p": pa.array(own.astype(np.int32)), "root": pa.array(root[own].astype(np.int32))})


def divide(state: DataFrame, percent: int, depth: int, small) -> tuple[DataFrame, DataFrame]:
    """(links, smaller regions) of regions (cell, side, rep, label, set, n) too large for a task; side 1 are guests.

    ``small`` marks tables of a few rows a region: a hint to broadcast them where the regions are known to be few.
    """
    radius = 1 - percent / 100 + 1e-9
    key = F.xxhash64("rep", F.lit(depth))
    home = state.where("side = 0")
    drawn = home.where(F.pmod(key, F.lit(1 << 30)) < F.lit(PIVOTS * float(1 << 30)) / F.col("n")).select("cell", "rep", "set", "n")
    least = home.groupBy("cell").agg(F.min_by(F.struct("rep", "set", "n"), key).alias("one")).select("cell", "one.*")
    pivots = small(cut(drawn.unionByName(least).dropDuplicates(["cell", "rep"])))
    parts = F.ceil(F.col("n") / TOGETHER).cast("int")
    left = state.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*[F.col(c).alias(c) for c in ("cell", "part", "rep", "set")])
    far = cut(
        left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(
            measured(percent), "cell long, side int, rep long, label long, set binary, n long, region int, d array<double>, linked array<int>, pivots array<long>"
        )
    )
    links = far.where("size(linked) > 0").select(F.col("rep").alias("a"), F.explode(F.transform("linked", lambda k: F.element_at("pivots", k + 1))).alias("b")).where("a <> b")
    pairs = far.where("size(linked) > 0").select("cell", F.explode("linked").alias("p"), F.element_at("linked", 1).alias("q")).distinct()
    roots = pairs.groupBy("cell").applyInArrow(merged_pivots, "cell long, p int, root int")
    named = far.withColumn("p", F.when(F.size("linked") > 0, F.element_at("linked", 1))).join(small(roots), ["cell", "p"], "left")
    rings = far.where("side = 0").groupBy("cell", F.col("region").alias("q")).agg(
        F.min(F.expr("d[least(region, size(d) - 1)]")).alias("low"), F.max(F.expr("d[least(region, size(d) - 1)]")).alias("high")
    )
    # Of two regions the documents of the later one visit the earlier one; guests visit all.
    visited = named.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("d")))).where("q = region and side = 0 or q < region or side = 1")
    met = visited.join(small(rings), ["cell", "q"])
    at_home = (F.col("q") == F.col("region")) & (F.col("side") == 0)
    remote = F.col("q") == F.size("d")
    to_pivot = F.expr("d[least(q, size(d) - 1)]")
    near = (to_pivot <= F.col("high") + radius) & (to_pivot >= F.col("low") - radius)
    own = F.expr("d[least(region, size(d) - 1)]")
    near = near & ((F.col("region") == F.size("d")) | (to_pivot <= own + 2 * radius))
    met = met.where(at_home | (remote & (F.array_min("d") >= 1 - 2 * radius)) | (~remote & near))
    label = F.when(F.col("root").isNull(), F.col("label")).otherwise(F.xxhash64("cell", "root", F.lit(depth)))
    return links, met.select(
        F.xxhash64("cell", "q", F.lit(depth)).alias("cell"), F.when(at_home, 0).otherwise(1).alias("side"), "rep", label.alias("label"), F.col("n").alias("before")
    )


def parted(stuck: DataFrame, small) -> DataFrame:
    """Regions that pivots don't divide: the documents not labelled like the most, in blocks, against all in blocks."""
    labels = stuck.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("held"))
    most = labels.groupBy("cell").agg(F.max_by("label", F.struct("held", "label")).alias("most"), F.sum("held").alias("all"), F.max("held").alias("largest"))
    sized = stuck.join(small(most), "cell")
    blocks = lambda count: F.greatest(F.lit(1), F.ceil(count / (TOGETHER // 2))).cast("int")
    loose, whole = blocks(F.col("all") - F.col("largest")), blocks(F.col("all"))
    part = lambda count: F.pmod(F.xxhash64("rep"), count).cast("int")
    asking = sized.where("label <> most").select("*", part(loose).alias("i"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("j"), F.lit(0).alias("at"))
    asked = sized.select("*", F.explode(F.sequence(F.lit(0), loose - 1)).alias("i"), part(whole).alias("j"), F.lit(1).alias("at"))
    return asking.unionByName(asked.select(asking.columns)).select(F.xxhash64("cell", "i", "j").alias("cell"), F.col("at").alias("side"), "rep", "label")


def joined_regions(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the documents of each region (cell, rep), so that linked ones are connected; ``sets``: (rep, set).

    Regions of more than one in FEW of all rows are fewer than FEW: what is known of them is broadcast, so that nothing of a
    hot region is gathered by its number.
    """
    columns = ["cell", "side", "rep", "label"]
    links, tasks, depth = [], [], 0
    state = members.select("cell", F.lit(0).alias("side"), "rep", F.col("rep").alias("label"), F.lit(None).cast("long").alias("before"))
    while True:
        counted = state.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(1 - F.col("side")).alias("homes"))
        counted = cut(counted)
        sizes = counted.where("low <> high and homes > 0").select("cell", "n")
        rows = counted.agg(F.sum("n"), F.max("n")).first()
        hot = F.col("n") > max(TOGETHER, (rows[0] or 0) // FEW)
        tasks.append(state.join(sizes.where(F.col("n") <= TOGETHER), "cell").select(columns))
        if (rows[1] or 0) <= TOGETHER:
            break
        smaller = []
        for which, small in ((hot, F.broadcast), ((F.col("n") > TOGETHER) & ~hot, lambda frame: frame)):
            own = sizes.where(which)
            if not own.take(1):
                continue
            large = state.join(small(own), "cell")
            stuck = F.coalesce(F.col("n") > STUCK * F.col("before"), F.lit(False))
            tasks.append(parted(large.where(stuck), small).select(columns))
            found, next_ = divide(large.where(~stuck).join(sets, "rep"), percent, depth, small)
            links.append(found)
            smaller.append(next_)
        if not smaller:
            break
        state, depth = cut(reduce(DataFrame.unionByName, smaller)), depth + 1
    wanted = cut(reduce(DataFrame.unionByName, tasks))
    held = sets.select(F.avg(F.octet_length("set"))).first()[0] or 0
    buckets = max(1, int(wanted.count() * held / (2 << 20)))
    dealt = wanted.join(sets, "rep").withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("int"))
    found = dealt.groupBy("bucket").applyInArrow(lambda table: join_together(table, percent), LINKS)
    return reduce(DataFrame.union, [found, *links])


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, carry: Sequence[str] = ()
) -> DataFrame:
    """Returns (id, n_shingles, representative, component_id, group): the smallest id with the same set, and the smallest reachable by links.

    Vertices are the distinct sets, ``rep`` a hash of theirs. ``group`` is one for sets connected by links and null for
    rows that can't have a partner. Columns named in ``carry`` come back in a last column ``carry``, a struct.
    """
    base = shingled(docs, id_col, text_col, size, percent, carry)
    able = base.where("set is not null and id is not null")
    alike = able.groupBy("lo", "hi").agg(F.min("id").alias("id")).withColumn("rep", F.xxhash64("lo", "hi"))
    members = able.select("id", "lo", "hi").distinct().join(alike.withColumnRenamed("id", "least"), ["lo", "hi"])  # no more work on its rows, so AQE can split hot sets
    distinct = cut(able.join(alike, ["id", "lo", "hi"]).select("rep", "lo", "hi", "regions", "set").dropDuplicates(["lo", "hi"]).select("rep", "regions", "set"))

    final = components(joined_regions(cut(regions_of(distinct)), distinct.select("rep", "set"), percent)).select(F.col("id").alias("rep"), "component")
    lowest = final.join(alike.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("lowest"))
    final = final.join(lowest, "component")
    named = members.join(final, "rep", "left").select("id", "lo", "hi", "least", "lowest", F.coalesce("component", "rep").alias("group"))
    return base.select("id", "n", "lo", "hi", *(["carry"] if carry else [])).join(named, ["id", "lo", "hi"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("representative"),
        F.coalesce("lowest", "least", "id").alias("component_id"), "group", *(["carry"] if carry else []),
    )
