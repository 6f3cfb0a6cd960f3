"""What only larger tables show: faults found at ten and a hundred times the tests' tables, at small sizes."""

import json

from pyspark.sql import functions as F

from tests.test_signed import NOW, signed
from tidewell.operators import extras, feeds, nearest, sweeps, vectors, window
from tidewell.plans import queries
from tidewell.sources import relay
from tidewell.streaming import ingest

DAY = 86400


def test_seconds_round_to_milliseconds_first(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-05 10:00:00.999499' as ts union all select timestamp_ntz'2024-01-05 10:00:00.9996'")
    got = sorted(r[0] for r in rows.select(queries.seconds("ts")).collect())
    assert got == [1704448800, 1704448801]


def test_posts_within_a_longer_window(spark):
    rows = ingest.parsed(spark.createDataFrame([(json.dumps(signed(created_at=NOW - 40 * DAY), ensure_ascii=False),)], "value string"))
    assert [r["verdict"] for r in ingest.judged(rows, NOW).collect()] == ["outside"]
    assert [r["verdict"] for r in ingest.judged(rows, NOW, window=40 * DAY).collect()] == ["accept"]


def test_filters_take_an_event_that_comes_twice(spark):
    events = spark.createDataFrame([("x", "a", 1, 5), ("x", "a", 1, 5), ("y", "a", 2, 5), ("z", None, 1, 5)], "id string, pubkey string, kind int, created_at long")
    filters = spark.createDataFrame(
        [(1, None, ["a", "b", "a"], [1], None, None), (2, ["x", "z"], ["a"], None, None, 5), (3, ["x"], None, [], None, None), (4, None, None, None, 6, None)],
        "filter int, ids array<string>, authors array<string>, kinds array<int>, since long, until long",
    )
    assert {(r["id"], r["filter"]) for r in sweeps.matching(events, filters).collect()} == {("x", 1), ("x", 2)}
    plan = sweeps.matching(events, filters.where("filter < 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "Aggregate" not in plan  # pairs aren't shuffled


def test_recorded_pages_read_their_own_lines(spark, tmp_path, monkeypatch):
    stored = [(k // 2, f"{(k * 7) % 100:03d}") for k in range(100)]
    lines = [json.dumps(["EVENT", "s", {"id": i, "pubkey": "k", "kind": 1, "created_at": 1 + t}]) for t, i in stored] + ["", '["EOSE", "s"]']
    (tmp_path / "wss_one.jsonl").write_text("\n".join(lines) + "\n")
    source = relay.Recorded(str(tmp_path))
    asked = [json.loads(f) for f in source.frames("wss://one", 31, 7)]
    expected = sorted(((1 + t, i) for t, i in stored if 1 + t < 31), key=lambda e: (-e[0], e[1]))[:7]
    assert [(e[2]["created_at"], e[2]["id"]) for e in asked[:-1]] == expected and asked[-1] == ["EOSE", "s"]
    read = []
    monkeypatch.setattr(relay.json, "loads", lambda text, own=json.loads: read.append(1) or own(text))
    list(source.frames("wss://one", None, 5))
    assert len(read) == 0  # the file isn't read as a whole again
    monkeypatch.undo()
    # Three pages of ten in one batch of a stream, and the same rows when it is replayed.
    stream = relay._Stream({"folder": str(tmp_path), "relays": "wss://one", "limit": "10", "pages": "3", "requests": "9"})
    rows, end = stream.read(stream.initialOffset())
    rows = list(rows)
    assert len(rows) == 30 and end == {"budget": 6, "wss://one": 36}
    assert list(stream.readBetweenOffsets(stream.initialOffset(), end)) == rows


def test_index_build_shuffles_texts_once(spark, tmp_path, monkeypatch):
    from tidewell.operators import postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    posts = spark.createDataFrame([(f"p{k}", None if k == 7 else "a b a " * (k % 5)) for k in range(60)], "canonical_id string, text string")
    index = postings.Postings.build(posts, str(tmp_path))
    blocks = index.alive().groupBy("block").count().collect()
    assert sum(r["count"] for r in blocks) == 60 and max(r["count"] for r in blocks) <= 4
    assert set(index.base.read("posts").columns) == {"part", "canonical_id", "n", "block"}  # terms come from the postings
    assert index.differences(posts).collect() == []
    changed = posts.where("canonical_id <> 'p3'").union(spark.createDataFrame([("p3", "a a b " * 3)], posts.schema))
    assert {r["canonical_id"] for r in index.differences(changed).collect()} == {"p3"}


def test_index_build_moves_packed_rows(spark, tmp_path):
    from tidewell.operators import postings

    posts = spark.createDataFrame([(f"p{k}", f"the w{k % 50} the") for k in range(600)], "canonical_id string, text string")
    tables, _ = postings.segment_tables(posts, 0, 0, True)
    plan = tables["postings"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "hashpartitioning(bucket" in plan  # texts, and packed rows instead of postings
    index = postings.Postings.build(posts, str(tmp_path))
    rows = index.base.read("postings")
    assert "canonical_id" not in rows.schema.simpleString() and rows.where("term is null").count() == rows.select("block").distinct().count()
    assert {r["canonical_id"]: r["f"] for r in index.phrase(["the"]).collect()} == {f"p{k}": 2 for k in range(600)}


def test_index_differences_move_no_postings(spark, tmp_path, monkeypatch):
    """Posts are told by fingerprints, however many differ: order, copies of a term's places and lengths count, posts without a word don't."""
    from tidewell.operators import postings

    texts = {f"p{k}": f"a b w{k % 9} a " * (k % 5) for k in range(60)} | {"null": None, "none": "--"}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "canonical_id string, text string")
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "MOST_MARKED", 8)
    index = postings.Postings.build(frame(texts), str(tmp_path))
    ids = lambda rows: sorted(r["canonical_id"] for r in index.differing(frame(rows)).collect())
    assert ids(texts) == [] and ids(texts | {"new": "", "also": "!"}) == []
    other = texts | {"p1": "b a w1 a", "p2": texts["p2"] + "a", "p3": None, "none": "x", "new": "a", "p6": "A  b-w6 a"}
    del other["p4"]
    assert ids(other) == ["new", "none", "p1", "p2", "p3", "p4"]
    assert {r["canonical_id"] for r in index.differences(frame(other)).collect()} == {"new", "none", "p1", "p2", "p3", "p4"}
    twice = frame(texts).union(frame({"p7": "a twin"}))  # counted as two, the other posts aren't touched
    assert [r["canonical_id"] for r in index.differing(twice).collect()] == ["p7"]
    plan = index.differing(frame(texts))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "Generate explode" not in plan  # no row a posting
    index = index.updated(frame({"p8": ""}).select("canonical_id"), frame({"p9": "fresh words"}))
    assert ids({k: v for k, v in texts.items() if k != "p8"} | {"p9": "fresh words"}) == [] and ids(texts) == ["p8", "p9"]


def test_index_differences_of_posts_without_a_word(spark, tmp_path):
    """Where there is no word to lose, no fault is planted: the SQL leaves such posts out."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tests import oracle

    ids = [1, 10, 11, 2, 20, 3, None]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": ["a word", "", "!?", "word", "--", "three", "no id"], "lang": ["en"] * 7, "source": ["s"] * 7, "n_chars": pa.array([1] * 7, pa.int64())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"event_id": [1], "user_id": [1]}), tmp_path / "events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    sql = queries.ORACLES["search_index_differences"]
    oracle.same(queries.QUERIES["search_index_differences"](spark, str(tmp_path)), con, sql)


def test_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(s, str(k)) for s in ("b", "a", None) for k in range(40)], "source string, id string")
    got = window.numbered(rows, [(F.col("source"), False), (F.substring("id", 1, 1), False)], [F.asc("id")])
    ordered = sorted(((s or "", str(k)) for s in ("b", "a", None) for k in range(40)))
    assert [(r["source"] or "", r["id"]) for r in sorted(got.collect(), key=lambda r: r["position"])] == ordered
    down = window.numbered(rows, [(F.col("source"), True)], [F.desc("id")], "k").where("k = 1").first()
    assert (down["source"], down["id"]) == ("b", "9")


def test_has_next_sorts_nothing(spark, monkeypatch):
    rows = spark.range(101).withColumn("text", F.lit("x"))
    monkeypatch.setattr(type(rows), "orderBy", lambda *a: 1 / 0)
    assert [feeds.has_next(rows, [F.asc("id")], n) for n in (0, 1, 2)] == [True, True, False]
    assert not feeds.has_next(rows.limit(100), [F.asc("id")], 1)


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ANCHORS", 3)
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(50)], "vec_id long, embedding array<float>").coalesce(1)
    got = {(r["anchor"], r["id"], r["rank"]) for r in nearest.top_k(rows, None, 2, centres=4)[0].collect()}
    assert got == {(r["anchor"], r["id"], r["rank"]) for r in vectors.top_k(rows, rows, 2).collect()}
    texts = spark.createDataFrame([(str(k), None if k == 299 else "ab" * (k % 4)) for k in range(300)], "canonical_id string, text string").coalesce(1)
    letters, joined = (lambda t: [ord(c) for c in t]), (lambda x: "".join(map(chr, x)))
    chunks = vectors.chunked(texts, letters, joined, 4)
    assert chunks.where("chunk = 0").count() == 300 and vectors.budget_check(chunks, letters, 4).first()[:] == (300 + sum(k % 4 == 3 for k in range(299)), 4)


def test_top_k_by_products_of_groups(spark, monkeypatch):
    """Copies tie by id, over several groups a side; no pair is made in the JVM."""
    monkeypatch.setattr(vectors, "ANCHORS", 5)
    monkeypatch.setattr(vectors, "MEMBERS", 7)
    own = {k: [1.0 + k % 3, float(k % 5), 2.0] for k in range(40)}
    rows = spark.createDataFrame(list(own.items()), "vec_id long, embedding array<float>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    expected = {(q, i, n) for q in range(0, 40, 4) for n, i in enumerate(sorted((i for i in own if i != q), key=lambda i: (-round(cosine(own[q], own[i]), 9), i))[:3], 1)}
    found = vectors.top_k(rows, rows.where("vec_id % 4 = 0"), 3)
    assert {(r["anchor"], r["id"], r["rank"]) for r in found.collect()} == expected
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_leading_rows_go_to_their_keys():
    import pyarrow as pa

    from tidewell.streaming import keyed

    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("k", "j", "id", keyed.MICROS), r)) for r in rows], pa.schema([("k", pa.string()), ("j", pa.int64()), ("id", pa.string()), (keyed.MICROS, pa.int64())]))
    rows = [batch([("a", 1, "z", 5), ("a", 1, "y", 5), ("a", 1, "x", 4)]), batch([("a", 2, "w", None), ("b", 1, "v", 1)]), batch([("a", 1, "u", 3), ("b", 1, "t", 2)])]
    found = [r for b in keyed.leading(["k", "j"], "id")(iter(rows)) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in found] == [("a", 1, "y", 5), ("b", 1, "t", 2)]
    assert list(keyed.leading(["k"], "id")(iter([batch([("a", 2, "w", None)])]))) == [] and list(keyed.leading(["k"], "id")(iter([]))) == []


def test_range_join_writes_less_than_it_has_rows(spark, tmp_path):
    points = spark.range(8000).select(F.col("id").alias("point"), (F.col("id") * 7919 % 8000 / 800.0).alias("at"))
    ranges = spark.range(30000).select(F.col("id").alias("part"), (F.col("id") * 31 % 100 / 10.0).alias("low")).withColumn("high", F.col("low") + 0.5)
    out = extras.range_join(points, ranges, "at", "low", "high", 1.0).select("point", "part")
    out.write.parquet(str(tmp_path / "out"))
    same = points.join(F.broadcast(ranges), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("point", "part")
    told = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("point", "part").cast("decimal(38)"))).first() for d in (spark.read.parquet(str(tmp_path / "out")), same)]
    assert told[0] == told[1] and told[0][0] > 10000000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < told[0][0]  # each part is written beside the same neighbours for every point


def test_range_join_keeps_copies_nulls_and_maps(spark):
    points = spark.createDataFrame([(1, 0.0, {"a": 1}), (1, 0.0, {"a": 1}), (2, 0.5, None), (3, -1.5, {}), (4, None, {})], "point long, at double, more map<string, int>")
    bounds = [(0.0, 0.5)] * 300 + [(-2.0, 0.25), (-2.0, 0.25), (None, 9.0), (0.0, None), (0.5, 0.0), (0.0, 0.0)]
    ranges = spark.createDataFrame([(*b, k % 5 or None, {"k": k}) for k, b in enumerate(bounds)], "low double, high double, part int, tags map<string, int>")
    rows = extras.range_join(points, ranges, "at", "low", "high", 1.0)
    assert rows.columns == ["point", "at", "more", "low", "high", "part", "tags"]
    expected = [(p, k) for p, at in ((1, 0.0), (1, 0.0), (2, 0.5), (3, -1.5)) for k, (low, high) in enumerate(bounds) if None not in (low, high) and low <= at < high]
    found = rows.collect()
    assert sorted((r["point"], r["tags"]["k"]) for r in found) == sorted(expected) and all((r["low"], r["high"]) == bounds[r["tags"]["k"]] and r["part"] == (r["tags"]["k"] % 5 or None) for r in found)
    bare = extras.range_join(points.select("at"), ranges.select("low", "high"), "at", "low", "high", 1.0)
    assert bare.columns == ["at", "low", "high"] and bare.count() == len(expected)
