"""Operators on small fixtures with exact results."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregates, enrich, extras, feeds, graph, intervals, lookups, moderation, state, tree, vectors, window
from tidewell.streaming import schedule

NOW = 1_800_000_000
POST = "canonical_id string, source string, author_id long, text string, created_at long, parent_id string, root_id string"


def posts(spark, rows):
    full = [(i, "nostr", a, t, NOW - age, p, r) for i, a, t, age, p, r in rows]
    return spark.createDataFrame(full, POST)


def test_window_ends(spark):
    df = posts(spark, [("in", 1, "", window.WINDOW, None, None), ("old", 1, "", window.WINDOW + 1, None, None), ("now", 1, "", 0, None, None), ("late", 1, "", -1, None, None)])
    assert {r[0] for r in window.eligible(df, NOW).collect()} == {"in", "now"}
    assert {r[0] for r in window.eligible(df, NOW, NOW - 10).collect()} == {"in"}
    assert {r[0] for r in window.eligible(df, NOW, NOW + 99).collect()} == {"in", "now"}
    assert window.lookup(df, "old", NOW).collect() == []


def test_pages_join_without_gap(spark):
    df = posts(spark, [(f"p{i:03d}", 1, "", i // 3, None, None) for i in range(120)])
    pages = [[r[0] for r in feeds.new(df, NOW, n).collect()] for n in range(4)]
    assert [len(p) for p in pages] == [50, 50, 20, 0]
    assert sum(pages, []) == [f"p{i:03d}" for i in range(120)]


def test_conversations(spark):
    df = posts(spark, [
        ("r1", 1, "", 1000, None, None), *[(f"a{i}", 2, "", 900 - i, "r1", "r1") for i in range(5)],
        ("r2", 3, "", 1000, None, None), ("b1", 4, "", 800, "r2", "r2"), ("b2", 5, "", 700, "r2", "r2"), ("b3", 3, "", 10, "r2", "r2"),
        ("c1", 6, "", 100, "gone", "gone"), ("d1", 7, "", 2 * 86400, None, ""),
    ])
    cards = {r["root_id"]: r for r in feeds.conversations(df, NOW).collect()}
    assert [r["root_id"] for r in feeds.conversations(df, NOW).collect()] == ["r2", "gone", "r1", "d1"]
    assert (cards["r2"]["n_reply_authors"], cards["r2"]["n_replies"], cards["r2"]["card_id"]) == (2, 3, "b3")
    assert (cards["gone"]["root_present"], cards["gone"]["n_replies"], cards["gone"]["n_reply_authors"]) == (False, 1, 1)
    assert cards["r1"]["n_reply_authors"] == 1 and cards["d1"]["n_replies"] == 0


def test_reach(spark):
    follows = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 2), (1, 0), (3, 4), (3, 1), (9, 9)], "follower long, followee long")
    hubs = spark.createDataFrame([(3,)], "pubkey long")
    got = {r["author_id"]: (r["hops"], r["weight"]) for r in graph.reach(follows, hubs, 0).collect()}
    # 1: direct, endorsed by 2 through hub 3; 2: direct, endorsed by 1; 3: by 1 and 2; 4: by 1 and 2 through 3
    assert got == {1: (1, 40), 2: (1, 45), 3: (2, 18), 4: (3, 8)}
    score = {r["author_id"]: r["graph_score"] for r in graph.reach(follows, hubs, 0).collect()}
    assert abs(score[3] - 1 / (0.25 + 0.25) ** 0.5) < 1e-12
    assert graph.reach(follows.where("false"), hubs, 0).collect() == []


def test_reach_of_all_roots(spark, monkeypatch):
    """Equal to ``reach`` for each root, also where every account is split over a grid."""
    import random

    monkeypatch.setattr(graph, "GRID", 3)
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.choice([0, 1, rng.randrange(14)])) for _ in range(70)] + [(5, 5), (0, 0)]
    follows = spark.createDataFrame(rows, "follower long, followee long")
    hubs = spark.createDataFrame([(0,), (1,), (3,), (7,), (7,)], "pubkey long")
    got = {}
    for r in graph.reach_all(follows, hubs).collect():
        got.setdefault(r["root"], {})[r["author_id"]] = (r["hops"], r["weight"])
    for root in sorted({f for f, _ in rows})[:4]:
        assert got[root] == {r["author_id"]: (r["hops"], r["weight"]) for r in graph.reach(follows, hubs, root).collect()}, root
    assert graph.reach_all(follows.where("false"), hubs).collect() == []


def test_reach_limits_feed(spark):
    follows = spark.createDataFrame([(0, 1), (1, 2)], "follower long, followee long")
    df = posts(spark, [("x", 1, "", 5, None, None), ("y", 2, "", 1, None, None), ("z", 3, "", 0, None, None)])
    hubs = follows.select(F.col("follower").alias("pubkey"))
    run = lambda **k: [r["canonical_id"] for r in feeds.social(df, follows, hubs, 0, NOW, **k).collect()]
    assert run() == ["y", "x"] and run(reach=1) == ["x"] and run(order="connections") == ["x", "y"]


def test_deep_chain(spark):
    df = posts(spark, [(f"n{i}", 1, "", 5000 - i, f"n{i - 1}" if i else None, "n0") for i in range(1105)])
    far = tree.ancestors(df).where("id = 'n1104'")
    assert far.count() == 1104 and far.agg(F.max("distance")).first()[0] == 1104
    below = tree.descendants(df, "n0", NOW)
    assert below.count() == 1104
    order = intervals.forest_preorder(df, NOW).orderBy("position").collect()
    assert [(r["canonical_id"], r["position"]) for r in order] == [(f"n{i}", i + 1) for i in range(1105)] and order[3]["depth"] == 3 and order[-1]["depth"] == 6


def test_trees_with_cycle_and_gap(spark):
    df = posts(spark, [("a", 1, "", 50, "b", None), ("b", 1, "", 40, "a", None), ("c", 1, "", 30, "b", None), ("o", 1, "", 20, "gone", "gone"), ("q", 1, "", 10, "o", "gone")])
    pairs = {(r["id"], r["ancestor"], r["distance"]) for r in tree.ancestors(df).collect()}
    assert pairs == {("a", "b", 1), ("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("q", "o", 1)}
    assert {r[0] for r in tree.descendants(df, "a", NOW).collect()} == {"b", "c"}
    assert [(r["parent_id"], r["n"]) for r in tree.missing_parents(df, NOW).collect()] == [("gone", 1)]
    up = lambda i: {r["canonical_id"]: (r["distance"], r["missing_parent_id"], r["cycle_cut"]) for r in tree.walk_up(df, i).collect()}
    assert up("q") == {"q": (0, None, False), "o": (1, "gone", False)}
    assert up("c") == {"c": (0, None, False), "b": (1, None, False), "a": (2, None, True)} and up("nobody") == {}
    placed = {(r["root_id"], r["position"], r["canonical_id"], r["depth"]) for r in intervals.forest_preorder(df, NOW).collect()}
    assert placed == {("o", 1, "o", 0), ("o", 2, "q", 1)}  # what hangs on a cycle has no place
    ends = {r["id"]: r["missing_parent_id"] for r in tree.missing_root(tree.ancestors(df), df).collect()}
    assert ends == {"o": "gone", "q": "gone"}


def test_preorder_and_shown_depth(spark):
    rows = [("r", 1, "", 99, None, None), ("k2", 1, "", 50, "r", "r"), ("k1", 1, "", 60, "r", "r"), ("g", 1, "", 10, "k1", "r")]
    rows += [(f"d{i}", 1, "", 9 - i, f"d{i - 1}" if i else "k2", "r") for i in range(8)]
    got = [(r["canonical_id"], r["depth"]) for r in tree.preorder(posts(spark, rows), "r", NOW).orderBy("position").collect()]
    assert got == [("k1", 1), ("g", 2), ("k2", 1), ("d0", 2), ("d1", 3), ("d2", 4), ("d3", 5), ("d4", 6), ("d5", 6), ("d6", 6), ("d7", 6)]


def test_latest_ties_to_smallest_id(spark):
    df = spark.createDataFrame([("k", 0, 5, "f"), ("k", 0, 5, "d"), ("k", 0, 5, "e"), ("k", 0, 4, "a"), ("k", 3, 1, "z")], "pubkey string, kind int, created_at long, event_id string")
    assert {(r["kind"], r["event_id"]) for r in state.latest(df, ["pubkey", "kind"], "created_at", "event_id").collect()} == {(0, "d"), (3, "z")}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", None)], "id int, v string, w string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", None)], "id int, v string, w string")
    assert {(r[0], r[1]) for r in state.upsert_actions(old, new, "id", ["v", "w"]).collect()} == {(1, "unchanged"), (2, "update"), (3, "keep"), (4, "insert")}
    assert {r["id"] for r in state.upsert(old, new, "id").collect()} == {1, 2, 3, 4}
    df = posts(spark, [("x", 1, "", 0, None, None)]).withColumn("source", F.lit("other"))
    assert state.admissible(df.withColumn("created_at", F.lit(0).cast("long")), NOW, "nostr").collect() == []  # outside first
    with pytest.raises(Exception, match="unsupported source"):
        state.admissible(df, NOW, "nostr").collect()


def test_edges_and_warnings(spark):
    key = "ab" * 32
    lists = spark.createDataFrame([("f", [["p", key], ["p", key], ["p", "short"], ["e", key], ["p"]])], "pubkey string, tags array<array<string>>")
    assert [tuple(r) for r in state.edges(lists).collect()] == [("f", key)]
    rows = "canonical_id string, category string, reason string, created_at long, seq int"
    old = spark.createDataFrame([("a", "spam", "first", 1, 1)], rows)
    new = spark.createDataFrame([("a", "spam", "second", 9, 2)], rows)
    assert [tuple(r) for r in state.warnings_upsert(old, new).collect()] == [("a", "spam", "second", 1)]


def test_generations(spark, tmp_path):
    """All tables appear together; what a crash leaves is never read."""
    folder = str(tmp_path / "s")
    write = lambda n: state.publish_all({"a": spark.range(n), "b": spark.range(2 * n)}, folder)
    read = lambda: [t.count() for t in state.current_all(spark, folder, ("a", "b")).values()]
    assert state.current_all(spark, folder, ("a",)) is None and write(1) == 1 and read() == [1, 2]
    spark.range(7).write.parquet(f"{folder}/a/part=0/version=dead")
    assert read() == [1, 2] and write(3) == 2 and read() == [3, 6]
    with pytest.raises(Exception, match="no such column"):
        state.publish_all({"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("no such column")))}, folder)
    assert read() == [3, 6] and write(4) == 3 and read() == [4, 8]


def test_publish(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert state.current(spark, folder) is None
    state.publish(spark.range(3), folder)
    state.publish(spark.range(5), folder)
    assert state.current(spark, folder).count() == 5


def test_moderation(spark):
    text = ["AKIA" + "A" * 16 + " nsec1" + "q" * 40, "sk-" + "a" * 30, "ghp_" + "b" * 36, "healthy breast cancer advice", "an Explicit Sex Scene here", " ".join(["https://x.y/z"] * 6), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select(
        "i", moderation.secret(F.col("t")).alias("s"), moderation.explicit(F.col("t")).alias("x"), moderation.link_farm(F.col("t")).alias("f")
    )
    got = {r["i"]: (r["s"], r["x"], r["f"]) for r in df.collect()}
    assert got[0][0] == "nsec key" and got[1][0] == "openai-style key" and got[2][0] == "github token"
    assert got[3] == (None, False, False) and got[4][1] and got[5][2] and got[6] == (None, None, None)


def test_gate_and_cards(spark):
    warnings = spark.createDataFrame([("x", "spam", "auto-flagged: spam link-farm"), ("x", "author-cw", "author: nsfw"), ("y", "spam", "auto-flagged: spam link-farm")], "canonical_id string, category string, reason string")
    assert {r[0]: (r[1], r[2]) for r in moderation.gate(warnings).collect()} == {"x": ("author: nsfw · auto-flagged: spam link-farm", True), "y": ("auto-flagged: spam link-farm", False)}
    df = posts(spark, [("x", 1, "secret body", 50, None, None), ("y", 2, "b" * 300, 40, "x", "x"), ("z", 3, "<b>c</b>  d", 30, "y", "x")])
    cards = {r["canonical_id"]: r for r in enrich.cards(feeds.new(df, NOW), df, warnings, NOW).collect()}
    assert cards["y"]["parent_excerpt"] == "content warning" and cards["y"]["rest_chars"] == 20 and cards["y"]["reply_count"] == 1
    assert cards["z"]["reply_count"] is None and cards["z"]["parent_excerpt"] == "b" * 159 + "…" and cards["x"]["warning_hides"]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()[0]
    assert get(enrich.age(F.lit(NOW - 90_000), NOW)) == "1d" and get(enrich.age(F.lit(NOW - 59), NOW)) == "59s" and get(enrich.age(F.lit(NOW + 5), NOW)) == "0s"
    assert get(enrich.when(F.lit(0))) == "1970-01-01 00:00 UTC" and get(enrich.iso(F.lit(0))) == "1970-01-01T00:00:00Z"
    assert get(enrich.before_argument(F.lit("2020-01-02"), NOW)) == 1577923200
    assert get(enrich.before_argument(F.lit("2020-13-02"), NOW)) is None and get(enrich.before_argument(F.lit("2999-01-01"), NOW)) is None
    assert get(enrich.safe_link(F.lit("javascript:alert(1)"))) is None and get(enrich.safe_link(F.lit("https://a.b/c"))) == "https://a.b/c"
    assert get(F.length(enrich.clip(F.repeat(F.lit("x"), 70_000)))) == 65_536 + 13
    name = lambda stored, profile: get(enrich.display_name(F.lit(stored), F.lit(profile), F.lit("f" * 64)))
    assert name("abcdef012345", None) == "f" * 16 and name("Ann", None) == "Ann" and name("Ann", '{"name": "Bo"}') == "Bo" and name("Ann", "broken") == "Ann"
    assert get(enrich.address(F.lit('{"nip05": "_@a.b"}'))) == "@a.b" and get(enrich.address(F.lit('{"nip05": "x@a.b"}'))) == "x@a.b" and get(enrich.address(F.lit("{}"))) == ""


def test_requests():
    parse = lambda **k: feeds.Request.parse(k, NOW)
    assert parse().mode == "conversations" and parse(q="x").mode == "relevance" and parse(q="x", mode="new").mode == "new"
    assert parse(mode="relevance").mode == "conversations" and parse(q="x", mode="social", go="1").mode == "relevance"
    assert parse(mode="discovery", q="x", reach="3", order="connections") == feeds.Request("discovery", "x", 0, None, "connections", 3)
    assert parse(date="2020-01-02").before == 1577923200 and parse(date="2020-01-02", before="7").before == 7 and parse(date="2020-13-02").before is None and parse(page="x").page == 0
    assert parse(mode="discovery", q="a b", reach="3", page="2", before="5").query_string() == "q=a+b&mode=discovery&before=5&reach=3&order=recent" and parse(mode="new").query_string() == "mode=new"
    assert parse(before="5").before == 5 and parse(before=str(NOW)).before is None and parse(reach="9", order="?").reach == 2 and parse(page="-4").page == 0


def test_feed_modes(spark):
    df = posts(spark, [("x", 1, "alpha beta", 5, None, None), ("y", 2, "beta", 1, "x", "x")])
    follows = spark.createDataFrame([(0, 1)], "follower long, followee long")
    hubs = spark.createDataFrame([], "pubkey long")
    run = lambda **k: feeds.feed(df, follows, hubs, 0, feeds.Request.parse(k, NOW), NOW).collect()
    assert [r["canonical_id"] for r in run(mode="new", q="beta")] == ["y", "x"]
    assert [r["canonical_id"] for r in run(mode="relevance", q="alpha")] == ["x"]
    assert [r["root_id"] for r in run(q="beta", mode="conversations")] == ["x"]
    assert [r["canonical_id"] for r in run(mode="social")] == ["x"]


def test_missing_profiles(spark):
    df = posts(spark, [("a", 1, "", 9, None, None), ("b", 2, "", 5, "a", "a"), ("c", 3, "", 1, None, None)])
    known = spark.createDataFrame([(1, 0)], "pubkey long, kind int")
    assert [r["author_id"] for r in aggregates.missing_profiles(df, known, 5).collect()] == [2, 3]


def test_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, [2.0, 0.1])], "vec_id long, embedding array<float>")
    got = [(r["id"], r["rank"]) for r in vectors.top_k(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2)]  # a tie goes to the smaller id
    whole = sorted(tuple(r) for r in vectors.top_k(df, df, 3).collect())
    monkeypatch.setattr(vectors, "ANCHORS", 1)  # one block an anchor
    assert sorted(tuple(r) for r in vectors.top_k(df, df, 3).collect()) == whole and len(whole) == 12
    encode, decode = (lambda t: list(t.encode())), (lambda ids: bytes(ids).decode())
    assert vectors.token_chunks("abcdefg", encode, decode, 3) == ["abc", "def", "g"] and vectors.token_chunks("", encode, decode, 3) == [""]
    grown = lambda t: list(t.encode()) * (2 if len(t) > 2 else 1)  # noqa: E731  re-encoding may exceed the budget
    assert all(len(grown(c)) <= 4 for c in vectors.token_chunks("abcdefgh", grown, lambda ids: bytes(ids[:4]).decode(), 4))
    with pytest.raises(ValueError):
        vectors.token_chunks("a", lambda t: [1] * (9 if t == "b" else 1), lambda ids: "b", 3)


def test_budgets(spark):
    chunks = spark.createDataFrame([("abc",), (None,), ("abcd",)], "text string")
    assert tuple(vectors.budget_check(chunks, list, 4).first()) == (3, 4)
    with pytest.raises(Exception, match="a chunk has 4 tokens, more than 3"):
        vectors.budget_check(chunks, list, 3).collect()
    assert tuple(vectors.budget_check(chunks.where("false"), list, 3).first()) == (0, 0)


def test_refresh_reuses(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "canonical_id string, text string")
    embed = lambda rows: rows.select("canonical_id", F.array(F.lit(1.0), F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("embedding"))
    first = vectors.refresh(None, df, embed)
    changed = df.withColumn("text", F.when(F.col("canonical_id") == "b", "yyy").otherwise(F.col("text"))).where("canonical_id <> 'a'")
    assert {(r[0], r[1]) for r in vectors.reuse(first, changed).select("canonical_id", "status").collect()} == {("b", "todo"), ("c", "reused")}
    assert {r["canonical_id"]: r["embedding"][1] for r in vectors.refresh(first, changed, embed).collect()} == {"b": 3.0, "c": 0.0}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 2, 9)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, t int, v string")
    assert {(r["id"], r["out"]) for r in extras.as_of(left, right, "k", "t", "v", "out").collect()} == {(1, "b"), (2, None), (3, None)}


def test_lookups(spark):
    rows = spark.createDataFrame([("k", 0, '{"id": "e", "tags": [["p", "x"]], "content": "c"}'), ("k", 3, "broken")], "pubkey string, kind int, event_json string")
    assert lookups.metadata(rows, "k", 0).first()["event"]["tags"] == [["p", "x"]] and lookups.metadata(rows, "z", 0).collect() == []
    table = spark.createDataFrame([("b", 2, '{"n": 5}'), ("a", 1, '{"n": 7, "m": "x"}')], "source string, updated_at long, detail string")
    assert [tuple(r) for r in lookups.status(table, ["n", "m"]).collect()] == [("a", 1, "7", "x"), ("b", 2, "5", None)]
    after = lookups.put(table, spark.createDataFrame([("b", 9, "{}")], table.schema), ["source"])
    assert {(r["source"], r["updated_at"]) for r in after.collect()} == {("a", 1), ("b", 9)}
    seen = spark.createDataFrame([("x", 3), ("y", 1), ("x", 0), ("z", 2)], "v string, at int")
    assert [r["v"] for r in lookups.distinct_in_order(seen, "v", "at", 2).collect()] == ["x", "y"]
    assert {(r["v"], r["at"]) for r in lookups.first_seen(seen, "v", ["at"]).collect()} == {("x", 0), ("y", 1), ("z", 2)}
    kept, gone = lookups.without(seen, F.when(F.col("v") == "x", True))
    assert kept.count() == 2 and gone.count() == 2


def test_context(spark):
    df = posts(spark, [("r", 1, "", 99, None, None), ("a", 1, "", 90, "r", "r"), ("b", 1, "", 80, "a", "r"), ("c", 1, "", 70, "b", "r"), ("d", 1, "", 75, "b", "r")])
    above, own, below = feeds.context(df, "b", NOW)
    assert [r["canonical_id"] for r in above.collect()] == ["r", "a"] and own.first()["canonical_id"] == "b"
    assert [(r["canonical_id"], r["depth"]) for r in below.collect()] == [("d", 1), ("c", 1)]


def test_schedule():
    assert schedule.shares(80) == (40, 40) and schedule.shares(2) == (3, 2)
    assert schedule.due(None, 5) and not schedule.due(100, 200) and schedule.due(100, 100 + 86400) and schedule.due(300, 200)
    assert schedule.accept_list(None, 5, "b", 9) and not schedule.accept_list(None, 10, "b", 9)
    assert schedule.accept_list((5, "b"), 5, "a", 9) and not schedule.accept_list((5, "b"), 5, "c", 9) and not schedule.accept_list((5, "b"), 4, "a", 9)
    assert schedule.relays(["a", "b"], ["b", "c", "c", "d"], 3) == ["a", "b", "c"]
