"""Search against SQLite's FTS5, an independent implementation of the same formula."""

import random
import sqlite3
import unicodedata

import pytest

from tidewell.functions.porter import stem
from tidewell.operators import postings, search
from tidewell.operators.postings import Postings

WORDS = "run running runs alpha beta gamma delta activation activations relational hopping falling café naïve the of and".split()


def texts(n=120, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def fts(rows, expression, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(text, tokenize='{tokenizer}')")
    con.executemany("insert into t(rowid, text) values (?, ?)", enumerate(rows))
    return dict(con.execute("select rowid, bm25(t) from t where t match ?", (expression,)).fetchall())


@pytest.mark.parametrize("query, expression", [("alpha beta", '"alpha" AND "beta"'), ('"of the" gamma', '"of the" AND "gamma"'), ("delta delta", '"delta" AND "delta"'), ('"the the"', '"the the"')])
def test_bm25_equals_fts5(spark, tmp_path, query, expression):
    rows = texts()
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "canonical_id string, text string")
    expected = fts(rows, expression, "unicode61")
    for match in (lambda c: search.match(posts, c, stems=False), Postings.build(posts, str(tmp_path), stems=False).match):
        got = {int(r[0]): r[1] for r in match(search.parse(query)).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-9 * max(1, abs(expected[k])) for k in got)


@pytest.mark.parametrize("query, expression", [("run activation", '"run" AND "activation"'), ("Cafe NAÏVE", '"cafe" AND "naive"'), ('"of runs" hopping', '"of runs" AND "hopping"')])
def test_stored_index_equals_fts5(spark, tmp_path, query, expression):
    """The default: stems, and Latin letters without their diacritics."""
    rows = texts()
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "canonical_id string, text string")
    expected = fts(rows, expression, "porter unicode61")
    index = Postings.build(posts, str(tmp_path))
    for match in (lambda c: search.match(posts, c), index.match):
        got = {int(r[0]): r[1] for r in match(search.parse(query)).collect()}
        assert got.keys() == expected.keys() and got
        assert all(abs(got[k] - expected[k]) < 1e-9 * max(1, abs(expected[k])) for k in got)
    assert index.differences(posts).collect() == []
    plan = index.heads(["run"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,run)" in plan


def test_index_is_kept_up_to_date(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "canonical_id string, text string")
    old = frame([("a", "one two"), ("b", "two three"), ("c", "four")])
    now = frame([("a", "one two"), ("b", "five"), ("d", "two two")])
    index = Postings.build(old, str(tmp_path))
    assert {tuple(r) for r in index.differences(now).collect()} == {("two", "b"), ("three", "b"), ("four", "c"), ("five", "b"), ("two", "d")}
    before = index.base
    index = index.updated(frame([("c", "")]), frame([("b", "five"), ("d", "two two")]))
    for name in ("postings", "heads", "posts"):  # nothing that was stored is written again
        assert before.parts(name).items() <= index.base.parts(name).items()
    assert index.differences(now).collect() == [] and {r[0] for r in index.match([["two"]]).collect()} == {"a", "d"}
    assert index.frequencies(search.normal([["two"], ["three"], ["five"], ["one", "two"], ["two", "one"]])) == [2, 0, 1, 1, 0]
    index = index.updated(frame([]), frame([("b", None), ("a", "two three")])).updated(frame([("d", "")]), frame([("e", "three two two")]))
    assert index.differences(frame([("b", None), ("a", "two three"), ("e", "three two two")])).collect() == []
    fresh = {tuple(r) for r in search.match(frame([("b", None), ("a", "two three"), ("e", "three two two")]), [["two"], ["three"]]).collect()}
    assert {(r[0], round(r[1], 12)) for r in index.match([["two"], ["three"]]).collect()} == {(i, round(b, 12)) for i, b in fresh} and len(fresh) == 2
    assert {r["canonical_id"]: r["n"] for r in index.lengths().collect()} == {"a": 2, "b": 0, "e": 3}


@pytest.fixture
def small(monkeypatch):
    """Many blocks, parts and hot terms even for few posts."""
    for name, value in (("BLOCK", 4), ("SPAN", 3), ("SHARD_POSTINGS", 150)):
        monkeypatch.setattr(postings, name, value)


def many(n=400, seed=3):
    rng = random.Random(seed)
    return [(f"p{k}", " ".join(rng.choice(["the", "the", "of", *[f"w{rng.randrange(60)}" for _ in range(4)]]) for _ in range(rng.choice([2, 5, 20, 60])))) for k in range(n)]


@pytest.mark.parametrize("query", ["the", "w7", '"of the"', '"of the" w3', "the of w1", '"the the" of', "absent the"])
def test_top_equals_all(spark, tmp_path, small, query):
    """The k best of the blocks that are read are the k best of all, ties included; hot terms lie in several parts."""
    rows = many()
    posts = spark.createDataFrame(rows, "canonical_id string, text string")
    index = Postings.build(posts, str(tmp_path))
    assert index.facts[0]["shards"] > 4 and len({r["lies"] for r in index.heads(["the"]).collect()}) > 3
    clauses = search.parse(query)
    every = {r[0]: r[1] for r in search.match(posts, clauses).collect()}
    found = {r[0]: r[1] for r in index.match(clauses).collect()}
    assert found.keys() == every.keys() and all(abs(found[k] - every[k]) < 1e-9 for k in every)
    for k, among in ((1, None), (10, None), (10, posts.where("canonical_id like '%3'")), (1000, None)):
        held = every if among is None else {i: b for i, b in every.items() if i.endswith("3")}
        best = sorted(held.values())[:k]
        got = {r[0]: r[1] for r in index.top(clauses, k, among, first=3).collect()}
        assert got.keys() <= held.keys() and {i for i, b in held.items() if best and b <= best[-1] - 1e-9} <= got.keys()
        assert sorted(got.values())[: len(best)] == pytest.approx(best, abs=1e-9)
        assert {i for i, b in held.items() if best and abs(b - best[-1]) < 1e-12} <= got.keys()  # ties with the last


def test_top_skips_blocks(spark, tmp_path, small):
    """Bounds leave most blocks of a frequent term unread."""
    posts = spark.createDataFrame([(f"q{k}", "the " * (12 if k < 9 else 1) + "x " * (20 + k % 300)) for k in range(900)], "canonical_id string, text string")
    index = Postings.build(posts, str(tmp_path))
    index.top([["the"], ["x"]], 5, first=3).collect()
    read, stored = index.scanned([["the"], ["x"]], index.told["reach"])
    assert 0 < read < stored / 3


def test_no_part_holds_a_hot_term(spark, tmp_path, small):
    posts = spark.createDataFrame([(f"q{k}", "the") for k in range(600)], "canonical_id string, text string")
    index = Postings.build(posts, str(tmp_path))
    sizes = [r["count"] for r in index.base.read("postings").groupBy("part").count().collect()]
    assert sum(sizes) >= 150 and max(sizes) <= 3 * sum(sizes) / index.facts[0]["shards"] + 3


def test_two_writers_of_an_index(spark, tmp_path):
    from tidewell.operators import commits

    frame = lambda rows: spark.createDataFrame(rows, "canonical_id string, text string")
    index = Postings.build(frame([("a", "one")]), str(tmp_path))
    index.updated(frame([]), frame([("b", "two")]))
    with pytest.raises(commits.Conflict):
        index.updated(frame([]), frame([("c", "two")]))
    assert Postings.stored(spark, str(tmp_path)).match([["two"]]).count() == 1


def test_empty_index(spark, tmp_path):
    index = Postings.build(spark.createDataFrame([], "canonical_id string, text string"), str(tmp_path))
    assert index.match([["a"]]).collect() == [] and index.top([["a", "b"]], 3).collect() == [] and index.match([[]]).collect() == []


def test_folding_equals_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab(t, row)")
    for code in [*range(0xC0, 0x250), *range(0x300, 0x331), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        if unicodedata.category(letter)[0] in "LM" and unicodedata.unidata_version >= "15" and code not in (0x37F, 0x528, 0x52A, 0x52C, 0x52E):  # younger than SQLite's table
            con.execute("delete from t")
            con.execute("insert into t values (?)", (f"a{letter}b",))
            found = [r[0] for r in con.execute("select term from v")]
            assert len(found) != 1 or search.fold(f"a{letter}b") == found[0], hex(code)


@pytest.mark.parametrize("word, expected", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("adjustable", "adjust"), ("controll", "control"), ("is", "is")])
def test_stem(word, expected):
    assert stem(word) == expected


def test_stems_equal_sqlite(spark):
    con = sqlite3.connect(":memory:")
    words = sorted({w for w in (WORDS + "nations generalizations oscillators hopefulness goodness electrical adoption communism bowdlerize rate roll probate cease controlling vietnamization sensibility operator feudalism decisiveness sky".split()) if w.isascii()})
    con.execute("create virtual table t using fts5(text, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, row)")
    for w in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (w,))
        assert con.execute("select term from v").fetchall() == [(stem(w),)], w


def test_parse():
    assert search.parse('"Of  the" NOT café') == [["of", "the"], ["not"], ["café"]]
    assert search.parse("foo_bar") == [["foo", "bar"]]
    assert search.parse("_ alpha") == [[], ["alpha"]]
    for bad in ('"open', "", '""', "!!"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


def test_clause_without_token_matches_nothing(spark):
    posts = spark.createDataFrame([("a", "alpha _")], "canonical_id string, text string")
    assert search.match(posts, search.parse("_ alpha")).collect() == []
