"""The ten operators against brute force, libraries and planted cases, with hostile inputs."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidewell.llm import backoff_lm, byte_bpe, components, exchange, jaccard_join, line_rules, mixing, suffix_merge, token_counts, textscan, toxicity, vector_dedup, window_dedup

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "a" * 400, "ab" * 300, "\x1c\x1d\u0085　x", "日本語 😀😀 naïve", "ab\n\n\n cd\t\t e", "it's we'll 123 ½ ²", "힣ᄀ 🧑‍🚀", "!!!===---" * 9,
    "<|endoftext|> x<|endoftext|>", "The quick brown fox. " * 50, "​  q z", "ſ'S 'T", "".join(map(chr, range(1, 600))),
]


@pytest.fixture(scope="module")
def rows():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return H.frame(spark, rows).repartition(3).cache()


@pytest.fixture(params=[exchange.Deal(3, 3, 1), exchange.Deal(1, 4, 3)], ids=["one level", "two levels"])
def small_blocks(monkeypatch, request):
    """Several blocks, buckets and chunks even for little tables."""
    real = exchange.blocked
    monkeypatch.setattr(exchange, "blocked", lambda *a, **k: real(*a, **(k | {"block_bytes": 900})))
    monkeypatch.setattr(exchange, "deal", lambda *a, **k: request.param)


# ---------------------------------------------------------------- 1


def vectors(seed=5, n=260):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 24))
    for k in range(40, n, 4):
        base[k] = base[k - 40] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.3])
    base[100:180] = base[7] + rng.normal(size=(80, 24)) * 0.04
    return base.astype(np.float32), rng.integers(0, 3, n) * 0


def test_vector_dedup(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TOGETHER", 40)  # large buckets are cut and still whole
    x, label = vectors()
    table = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    table += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, table[0][1], 1), (904, table[0][1], None), (905, [], 0), (906, [1.0, None], 0), (907, [float("inf")] * 24, 0), (908, table[0][1], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash")).withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: r for r in vector_dedup.vector_dedup(df).collect()}
    fine = [t for t in table if t[1] and t[2] is not None and all(v is not None and math.isfinite(v) for v in t[1]) and any(t[1])]
    unit = np.array([np.array(t[1]) / np.linalg.norm(t[1]) for t in fine])
    near = (unit @ unit.T >= 0.98) & (np.array([t[2] for t in fine])[:, None] == np.array([t[2] for t in fine])[None])
    links = [(fine[a][0], fine[b][0]) for a, b in zip(*np.nonzero(near)) if a < b]
    expected = H.classes([t[0] for t in table], links)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * 2 * len(links) and found <= 2 * len(links)
    assert sum(got[i]["component_id"] == c for i, c in expected.items()) >= 0.99 * len(expected)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905, 906, 907))
    assert got[908]["component_id"] == 0 and not got[908]["kept"] and got[908]["n_links"] == got[0]["n_links"]
    assert vector_dedup.vector_dedup(df.where("false")).collect() == []
    wide = vector_dedup.vector_dedup(df.withColumn("embedding", F.col("embedding").cast("array<double>")))
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in wide.collect()} == {(r["vec_id"], r["n_links"], r["component_id"]) for r in got.values()}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(vector_dedup.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(vector_dedup.hadamard(vector_dedup.hadamard(x)), x)


def test_recall_by_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pdf = df.toPandas()
    unit = np.array(pdf["embedding"].tolist(), dtype=float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (pdf["label"].to_numpy()[:, None] == pdf["label"].to_numpy()[None])
    found = vector_dedup.vector_dedup(df).agg(F.sum("n_links")).first()[0]
    assert 0.99 * (near.sum() - len(pdf)) <= found <= near.sum() - len(pdf)


@pytest.mark.parametrize("dim, depth", [(64, 1), (64, 2), (64, 4), (768, 2), (768, 4)])
def test_recall_at_the_limit(dim, depth):
    """Pairs at a cosine of just 0.98 share a bucket, also with the codes that large tables use."""
    rng = np.random.default_rng(dim + depth)
    x, y = rng.normal(size=(2, 1500, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    a, b = vector_dedup.codes(x, depth), vector_dedup.codes(y, depth)
    met = [bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())]
    assert np.mean(met) >= 0.98


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    expected = H.classes({v for e in edges for v in e if v is not None}, [e for e in edges if None not in e])
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in expected.items() if any(i in e and e[0] != e[1] and None not in e for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- 2


def test_line_rules_base(docs, rows):
    got = {r["doc_id"]: r for r in line_rules.line_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        stats = H.line_statistics(t)
        assert tuple(got[i][c] for c in line_rules.BASE) == stats, i
        assert got[i]["base_failed"] == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])


def test_frequent_lines(spark):
    rng = random.Random(4)
    own = lambda: " ".join(H.vocabulary(rng, 70))
    menu = "Home  About   CONTACT " + " ".join(f"item{k}" for k in range(60))
    rows = [(i, (menu + "\n" + own()) if i < 40 else own()) for i in range(60)] + [(70, menu.lower().replace("  ", " ") + "\nfew words"), (71, None), (72, ""), (73, menu)]
    df = H.frame(spark, rows, lambda i: "a" if i < 73 else None)
    got = {r["doc_id"]: r for r in line_rules.line_rules(df.union(df.where("doc_id = 70"))).collect()}
    assert all(got[i]["kept"] and got[i]["n_frequent_lines"] == 1 and got[i]["words_left"] == 70 for i in range(40))
    assert all(got[i]["kept"] and got[i]["n_frequent_lines"] == 0 for i in range(40, 60))
    assert not got[70]["kept"] and got[70]["depleted"] and got[70]["words_left"] == 2  # normalised, and twice is once
    assert got[73]["words_left"] == 63 and got[73]["kept"]  # another host
    assert not got[71]["kept"] and not got[72]["kept"]
    assert line_rules.line_rules(df.where("false")).collect() == []


# ---------------------------------------------------------------- 3 and 7


def test_byte_bpe(spark):
    import tiktoken

    rng = random.Random(9)
    texts = ODD + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), 0x1F600])) for _ in range(rng.randint(0, 80))) for _ in range(300)] + [t for _, t in H.corpus()]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    df = H.frame(spark, list(enumerate(texts)) + [(None, "x"), (3, "again")])
    got = [(r["doc_id"], np.frombuffer(bytes(r["ids_le"]), "<u4").tolist(), r["decoded"]) for r in byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()]
    expected = [(i, library.encode_ordinary(t or ""), t or "") for i, t in list(enumerate(texts)) + [(None, "x"), (3, "again")]]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    two = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(r["decoded"] for r in two.collect()) == sorted(t or "" for _, _, t in expected)
    assert byte_bpe.encode(df.where("false"), RANKS, P.PATTERN).collect() == []


def test_transducer_equals_merges_on_a_small_vocabulary():
    rng = random.Random(3)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        texts = [[bytes([rng.choice(b"aaabbc")]) for _ in range(rng.randint(1, 30))] for _ in range(60)]
        for rank in range(256, 290):  # learn merges as they are learnt: the most frequent pair, then apply it
            pairs = Counter(p for t in texts for p in zip(t, t[1:]) if p[0] + p[1] not in ranks)
            if not pairs:
                break
            a, b = max(sorted(pairs), key=pairs.get)
            ranks[a + b] = rank
            for t in texts:
                k = 0
                while k < len(t) - 1:
                    if t[k] == a and t[k + 1] == b:
                        t[k : k + 2] = [a + b]
                    k += 1
        machine = byte_bpe.MergeTransducer(ranks)
        for _ in range(150):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            assert machine.encode(piece) == byte_bpe.merge(piece, ranks)


def test_memory_is_bounded_within_one_piece(monkeypatch):
    """A piece of many states: the transducer forgets on the way, with the same result."""
    monkeypatch.setattr(byte_bpe, "STRETCH", 100)
    ranks, rng = byte_bpe.read_ranks(RANKS), random.Random(2)
    piece = "".join(rng.choice("abcdefghij") for _ in range(6000)).encode()
    small, large = byte_bpe.MergeTransducer(ranks, 300), byte_bpe.MergeTransducer(ranks)
    assert small.encode(piece) == large.encode(piece) and len(small.moves) <= 400 < len(large.moves)
    assert small.encode(b"") == [] == byte_bpe.MergeTransducer(ranks).encode(b"")


def test_output_follows_bounded_lookahead():
    machine = byte_bpe.MergeTransducer(byte_bpe.read_ranks(RANKS))
    state, out = 0, []
    for byte in b"a" * 2000:
        state, emitted = machine.moves.get(state << 8 | byte) or machine.step(state, byte)
        out += emitted
    assert sum(len(machine.token_bytes[t]) for t in out) > 1700  # not kept back to the end


def test_utf8_stream():
    text = "aé漢😀z" * 3
    data = text.encode()
    for size in range(1, 6):
        stream = byte_bpe.Utf8Stream()
        assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.close() == text
    stream = byte_bpe.Utf8Stream()
    assert stream.feed(b"\xe6\xbc") == "" and stream.close() == "�"
    assert byte_bpe.Utf8Stream().feed(b"\xff\x80a") == "��a"


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ODD + [t or "" for _, t in H.corpus(2)]
    library = Tokenizer.from_file(path)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    df = H.frame(spark, [*enumerate(texts), (None, None), (1, " ")])
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, path, P.PATTERN).collect())
    assert got == Counter([(i, len(t.encode()), n) for i, (t, n) in enumerate(zip(texts, expected))] + [(None, 0, 0), (1, 1, 1)])
    whole = token_counts.whole_tokens(path)
    rng = random.Random(1)
    long = ["".join(rng.choice("abcdefghij") for _ in range(100_000)), "a" * 100_000, "ab1 " * 30_000]
    began = time.monotonic()
    counter = token_counts.Counter(path, P.PATTERN, whole)
    assert [counter.count(t) for t in long] == [len(e.ids) for e in library.encode_batch(long, add_special_tokens=False)]
    assert time.monotonic() - began < 60 and all(len(p) <= byte_bpe.LONG for p in counter.more)
    assert " the" in whole and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[:: 997])


# ---------------------------------------------------------------- 4


def test_targets(spark):
    rng = random.Random(3)
    cases = [[10, 10], [10, 100], [10, 10, 100], [0, 5], [0, 0], [7], *[[rng.randint(0, 10 ** rng.randint(1, 6)) for _ in range(rng.randint(2, 40))] for _ in range(4)]]
    for sizes in cases:
        names = [f"s{k:03d}" for k in range(len(sizes) - 1)] + [None]
        table = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
        expected = H.fill(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes)) if sum(sizes) else [0.0] * len(sizes)
        assert got == pytest.approx(dict(zip(names, expected)))


@pytest.mark.parametrize("cell_rows", [100, 3])
def test_mix(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)  # 3: classes are several cells
    rng = random.Random(6)
    source = lambda i: None if i is None or i % 5 == 0 else ("hot" if i % 5 < 3 else f"s{i % 5}")
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 40, 300]))) for i in range(900)] + [(950, None), (951, ""), (952, "  "), (953, "w " * 5000), (None, "w w"), (None, None), (7, "x y z"), (7, "x y z")]
    df = H.frame(spark, rows, source)
    got = mixing.plan(df).collect()
    size = Counter()
    for i, t in rows:
        size[source(i)] += len(H.words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, H.fill([size[s] for s in order], [3, 1, 2, 3][: len(order)], 1.5 * sum(size.values()))))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - aims[r["source"]]) < 1e-6
    assert len(got) == len(rows) and all(abs(taken[s] - aims[s]) <= 2 for s in size)  # by the shortest documents, not by the longest
    copies = H.systematic([(i, t, source(i)) for i, t in rows], aims)
    assert Counter((r["doc_id"], r["size"], r["copies"]) for r in got) == Counter((i, len(H.words(t)), c) for (i, t), c in zip(rows, copies))
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.plan(df.repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in got)
    mixed = mixing.mix(df)
    expected = Counter()
    for r in got:
        expected[r["doc_id"]] += r["copies"]
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == +expected
    assert mixing.plan(df.where("false")).collect() == [] and mixing.mix(df.where("false")).collect() == []
    assert all(r["taken"] == 0 for r in mixing.plan(df.where("doc_id in (950, 951, 952)")).collect())


# ---------------------------------------------------------------- 5 and 8


def test_merged_transforms():
    rng = random.Random(1)
    for trial in range(40):
        letters = b"ab" if trial % 2 else b"abc\x00"
        strings = list({bytes(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(1, 40))})
        ids = np.array([rng.randint(0, 20) for _ in strings])
        got = {(a, b): c for a, b, c in zip(*(x.tolist() for x in suffix_merge.least_ids(strings, ids, 5)))}
        least = {}
        for s, i in zip(strings, ids.tolist()):
            for k in range(len(s) - 4):
                least[s[k : k + 5]] = min(least.get(s[k : k + 5], 99), i)
        assert got == {(n, k): least[s[k : k + 5]] for n, s in enumerate(strings) for k in range(len(s) - 4)}
        shard = np.sort(np.array([rng.randint(0, 3) for _ in strings]))
        shard = np.unique(shard, return_inverse=True)[1]
        string, place, prefix = suffix_merge.merge_shards(strings, shard, 4)
        suffixes = [strings[a][b:] for a, b in zip(string, place)]
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:])]
        assert [min(4, c) for c in common] == prefix[1:].tolist() and all(a[:4] <= b[:4] for a, b in zip(suffixes, suffixes[1:]))


def test_the_merge_alone_decides_the_same():
    """Without the table of equal segments and the hash filter, and whatever the shards are."""
    rng = random.Random(5)
    for _ in range(30):
        # Equal windows have equal minimizers: each base has letters of its own, and its key.
        base = [bytes(rng.choice([65 + 2 * k, 66 + 2 * k]) for _ in range(rng.randint(8, 16))) for k in range(6)]
        cuts = [(k, rng.randint(0, 3)) for k in range(6) for _ in range(rng.randint(1, 6))]
        strings = [base[k][i : rng.randint(i + 5, len(base[k]))] for k, i in cuts]
        keys = np.array([k for k, _ in cuts], dtype=np.uint64)
        ids, sender = np.array([rng.randint(0, 9) for _ in strings]), np.array([rng.randint(0, 4) for _ in strings])
        found = [suffix_merge.resolve(keys, ids, strings, 5, sender, pool, spare).tolist() for spare in (True, False) for pool in (1 << 20, 20)]
        assert found[0] == found[1] == found[2] == found[3] and any(found[0])


@pytest.mark.parametrize("frequent", [2000, 3])
def test_suffix_dedup(docs, rows, small_blocks, monkeypatch, frequent):
    monkeypatch.setattr(suffix_merge, "FREQUENT", frequent)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_merge.suffix_dedup(docs).collect()}
    assert got == H.byte_dedup(rows) and sum(v[1] for v in got.values())


def test_suffix_dedup_edges(spark, small_blocks):
    line = "the same line of rather more than fifty bytes, again and again. "
    top = (1 << 63) - 1  # the largest id is smaller than none
    df = H.frame(spark, [(5, line), (5, line), (2, "x" * 300), (9, "y" + "x" * 120), (None, line), (None, line), (top, "q" * 90), (None, "q" * 95), (-3, "z" * 70), (4, "z" * 70), (7, None), (8, "é" * 40)])
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_merge.suffix_dedup(df).collect()), key=repr)
    assert got == sorted([(5, 0), (5, 0), (2, 0), (9, 120), (None, len(line)), (None, len(line)), (top, 0), (None, 95), (-3, 0), (4, 70), (7, 0), (8, 0)], key=repr)
    assert suffix_merge.suffix_dedup(df.where("false")).collect() == []


def test_long_text_in_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_merge, "PIECE", 700)
    monkeypatch.setattr(suffix_merge, "CACHED_BYTES", 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_merge.suffix_dedup(docs).collect()}
    assert got == H.byte_dedup(rows)


def test_window_dedup(docs, rows, small_blocks):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in window_dedup.window_dedup(docs).collect()}
    assert got == H.window_dedup(rows) and sum(v[1] for v in got.values())


def test_window_dedup_edges(spark, small_blocks):
    line = " ".join(f"w{k}" for k in range(13))
    df = H.frame(spark, [(4, line), (4, line), (9, "a " + line + " b"), (None, line), (1, None), (2, "w0 w1"), (11, line + " " + line)])
    result = window_dedup.window_dedup(df, carry=["lang", "source"]).collect()
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"], r["carry"]["lang"]) for r in result), key=repr)
    expected = [(4, 0, line, "en"), (4, 0, line, "en"), (9, 13, "a b", "en"), (None, 13, "", "en"), (1, 0, "", "en"), (2, 0, "w0 w1", "en"), (11, 26, "", "en")]
    assert got == sorted(expected, key=repr)
    assert window_dedup.window_dedup(df.where("false")).collect() == []


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (exchange.unpack(exchange.pack(keys)) == keys).all()
        high = np.unique(keys & np.uint64(0xFFFFFFFF00000000))  # low bits that all lack take no room
        assert (exchange.unpack(exchange.pack(high)) == high).all() and len(exchange.pack(high)) <= 30 + 4 * n
    assert exchange.part(exchange.join([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]
    for values in ([0, 1, 1], [0, 255], [300], [1 << 40], [], [(1 << 64) - 1], [1, 2, 3] * 9 + [255, 1 << 50]):
        column = np.array(values, dtype=np.uint64)
        assert (exchange.unpack_column(exchange.pack_column(column)) == column).all()
    assert exchange.unpack_column(exchange.pack_column([b"", b"xy", b"z"])) == [b"", b"xy", b"z"]


def largest_block(spark, ids, block_bytes=20_000):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(i, "x" * 984) for i in ids], T._parse_datatype_string("doc_id long, text string"))
    rows, blocks, total = exchange.blocked(df.repartition(3), "doc_id", "text", block_bytes=block_bytes)
    assert total == 1000 * len(ids)
    held = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.collect_set("id").alias("ids")).collect()
    named = sorted((r for r in held if r["low"] is not None), key=lambda r: r["block"])
    for a, b in zip(named, named[1:]):  # blocks follow the ids; parts of one rank hold one id
        same = exchange.ranks(a["block"]) == exchange.ranks(b["block"])
        assert a["high"] < b["low"] or (same and a["ids"] == b["ids"] and len(a["ids"]) == 1)
    nameless = {exchange.ranks(r["block"]) for r in held if r["low"] is None}
    assert len(nameless) <= 1 and all(r["high"] is None for r in held if exchange.ranks(r["block"]) in nameless)
    assert sum(r["n"] for r in held) == len(ids)
    return max(r["n"] for r in held)


def test_blocks_hold_like_shares_whatever_the_ids(spark):
    """Dense, with one far outlier, clustered, negative, all null, half null, one id for a third of the rows, huge ids: 20 rows a block are meant."""
    n = 2000
    tables = {
        "dense": list(range(n)), "outlier": [*range(n - 1), 10**15], "clusters": [k % 4 * 10**12 + k for k in range(n)], "negative": [-k * k for k in range(n)],
        "null": [None] * n, "half null": [None if k % 2 else k for k in range(n)], "one id": [7 if k % 3 else k for k in range(n)],
        "two heavy neighbours": [6 + k % 2 if k % 3 else k for k in range(n)], "huge": [(1 << 63) - 1 - k // 2 for k in range(n)], "one id only": [(1 << 63) - 1] * n,
    }
    for name, ids in tables.items():
        assert largest_block(spark, ids) <= 45, name
    assert largest_block(spark, [5, None]) == 1


def test_tasks_get_like_shares(spark):
    numbers = np.array([0, 1, -5, 1 << 40, (1 << 62) + 12345])
    hashes = [r[0] for r in spark.createDataFrame([(int(n),) for n in numbers], "v long").select(F.hash("v")).collect()]
    assert exchange.murmur(numbers).tolist() == hashes
    for many, tasks in ((8, 4), (500, 250), (4096, 51)):
        dealt = exchange.salted(np.arange(many), tasks)
        load = Counter((exchange.murmur(dealt) % tasks).tolist())
        assert (dealt >> exchange.SALT_BITS == np.arange(many)).all() and max(load.values()) <= -(-many // tasks) + 1
    rows, blocks, _ = exchange.blocked(spark.range(3000).selectExpr("id as doc_id", "repeat('x', 984) as text"), "doc_id", "text", block_bytes=20_000)
    counts = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("block").alias("n")).collect()]
    assert blocks > 140 and max(counts) <= exchange.A_TASK + 1


def test_deal_keeps_buckets_and_rows():
    """From megabytes to 100 TB, buckets stay near their size and rows hold some keys, on both levels."""
    for total in (10**6, 10**9, 3 * 10**10, 10**12, 10**14):
        blocks = max(1, total // max(exchange.BLOCK_BYTES, total // exchange.MOST_BOUNDS))
        keys = total / 6
        own = exchange.deal(keys * 8, blocks, keys / blocks)
        assert keys * 8 / (1 << max(own.bits, own.fine)) <= 2 * exchange.BUCKET_BYTES
        assert own.bits == 0 or keys / blocks / (1 << own.bits) >= exchange.LEAST_KEYS / 2
        if own.fine > own.bits:
            unit = keys / own.groups / (1 << own.bits)
            assert unit * 8 <= 2 * exchange.BUCKET_BYTES and unit / (1 << (own.fine - own.bits)) >= 16


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("together", [800, 4])
def test_jaccard_join(spark, small_blocks, monkeypatch, together):
    monkeypatch.setattr(jaccard_join, "TOGETHER", together)  # 4: regions are divided by pivots in Spark
    rng = random.Random(8)
    base = rng.choices(H.vocabulary(rng, 500), k=300)
    rows = H.corpus(3)
    for k in range(40):  # a chain and a star of edits
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(300)] = f"edit{k}"
        rows.append((2000 + k, " ".join(own)))
        base[rng.randrange(300)] = f"drift{k}"
    rows += [(3000, "one two"), (3001, "ONE two"), (3002, "two one"), (3003, None)]
    sizes, expected = H.jaccard(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(H.frame(spark, rows)).collect()}
    assert got == {i: (sizes[i], expected[i]) for i in sizes}
    assert len(set(expected.values())) < len(expected) - 20


def test_jaccard_edges(spark):
    df = H.frame(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b C d e f"), (None, "a b c d e f"), (8, None), (9, "")])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect()), key=repr)
    assert got == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, None), (8, 0, 8), (9, 0, 9)], key=repr)
    assert jaccard_join.jaccard_join(df.where("false")).collect() == []


def test_jaccard_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    df = H.frame(spark, [(5, a), (5, b), (7, a), (9, b), (8, b + " more"), (2, a + " end")])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect())
    assert got == [(2, 37, 2), (5, 36, 2), (5, 36, 5), (7, 36, 2), (8, 37, 5), (9, 36, 5)]


@pytest.mark.parametrize("kind, few", [("edits of one text", 200), ("edits of one text", 1), ("mixtures", 200), ("clusters", 3)])
def test_large_regions_are_divided(spark, monkeypatch, kind, few):
    """Regions larger than a task: dense ones, where pivots link most; mixtures, all about equally far from each other; and clusters."""
    monkeypatch.setattr(jaccard_join, "TOGETHER", 24)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = random.Random(11)
    base, rows = [f"b{k}" for k in range(120)], []
    pool = [[f"s{j}x{k}" for k in range(12)] for j in range(14)]
    centres = [[f"c{j}x{k}" for k in range(90)] for j in range(6)]
    for i in range(170):
        if kind == "edits of one text":
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(120)] = rng.choice(["e1", "e2", "e3"])
        elif kind == "mixtures":
            own = ["rare", "phrase", "in", "every", "text", "here"] + sum(rng.sample(pool, 7), [])
        else:
            own = base[:30] + centres[i % 6]
            own[rng.randrange(30, 120)] = f"d{rng.randint(0, 3)}"
        rows.append((i, " ".join(own)))
    sizes, expected = H.jaccard(rows)
    divided = []
    real = jaccard_join.divide
    monkeypatch.setattr(jaccard_join, "divide", lambda *a: divided.append(1) or real(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(H.frame(spark, rows)).collect()}
    assert got == {i: (sizes[i], expected[i]) for i in sizes} and divided


def test_a_shared_phrase_makes_no_large_region(spark, monkeypatch):
    """5,000 texts, each with one near copy, share a phrase: pairs meet, not all."""
    rng = random.Random(12)
    phrase, rows = [f"p{k}" for k in range(30)], []
    for i in range(2500):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        rows += [(2 * i, " ".join(phrase + own)), (2 * i + 1, " ".join(phrase + own[:-1] + ["end"]))]
    pairs = []
    real = jaccard_join.joined_regions
    monkeypatch.setattr(jaccard_join, "joined_regions", lambda cells, *a: pairs.append(cells.groupBy("cell").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]) or real(cells, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(H.frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(5000)} and pairs[0] <= 5000


def test_metric_join_in_memory():
    rng = random.Random(5)
    sets = []
    for _ in range(30):
        base = rng.sample(range(100_000), rng.randint(5, 60))
        for _ in range(rng.randint(1, 12)):
            own = set(base)
            for _ in range(rng.randint(0, 8)):
                own.discard(rng.choice(base))
                own.add(rng.randint(0, 10**6))
            sets.append(np.array(sorted(own), dtype=np.uint64))
    own = jaccard_join.Join(sets, 80)
    own.run(np.arange(len(sets)), np.zeros(0, np.int64))
    assert own.compared < len(sets) ** 2 / 6  # pivots and windows spare most pairs
    plain = [set(s.tolist()) for s in sets]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
    assert H.classes(range(len(sets)), own.edges) == H.classes(range(len(sets)), links)


# ---------------------------------------------------------------- 9


def language_model(rows, modulus=7, remainder=2, order=backoff_lm.ORDER, coarse=True):
    """(scores as the query returns them, strengths by bisection of the evidence's condition)."""
    held = lambda i: zlib.crc32(str(i).encode()) % modulus == remainder
    tokens = [(i, ["<s>"] * (order - 1) + H.words(H.lower(t)) + [None]) for i, t in rows]
    grams, contexts = Counter(), Counter()
    for i, w in tokens:
        if i is not None and not held(i):
            for k in range(order - 1, len(w)):
                for n in range(order):
                    grams[tuple(w[k - n : k + 1])] += 1
                    contexts[tuple(w[k - n : k])] += 1
    n, v = contexts[()], len([g for g in grams if len(g) == 1])
    prior = []
    for m in range(1, order):
        kinds = sum(len(g) == m + 1 for g in grams)
        sizes = [c for g, c in contexts.items() if len(g) == m]
        rises = [math.log(x * sum(math.log1p(c / x) for c in sizes)) for x in backoff_lm.STRENGTHS]
        low, high = 0.25, 2.0**20
        if coarse:  # as interpolated between the strengths that buckets sum for
            low = high = math.exp(np.interp(math.log(max(1, kinds)), rises, np.log(backoff_lm.STRENGTHS)))
        for _ in range(200):
            middle = math.sqrt(low * high)
            if coarse:
                break
            low, high = (middle, high) if middle * sum(math.log1p(c / middle) for c in sizes) < max(1, kinds) else (low, middle)
        prior.append(low)
    out = []
    for i, w in tokens:
        base = score = 0.0
        for k in range(order - 1, len(w)):
            p = (grams[w[k],] + 1) / (n + v + 1)
            base += math.log10(p)
            for m in range(1, order):
                p = (grams[tuple(w[k - m : k + 1])] + prior[m - 1] * p) / (contexts[tuple(w[k - m : k])] + prior[m - 1])
            score += math.log10(p)
        out.append((i, i is not None and held(i), len(w) - order + 1, sum(grams[x,] > 0 for x in w[order - 1 :]), n, base, score))
    return out, prior


def test_language_model(spark, rows, small_blocks):
    many = rows + [(None, rows[2][1]), rows[3], (rows[3][0], rows[4][1])]  # no id, a repeated row, an id with two texts
    expected, _ = language_model(many)
    got = sorted((tuple(r) for r in backoff_lm.score(H.frame(spark, many).repartition(3)).collect()), key=repr)
    for g, e in zip(got, sorted(expected, key=repr), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and g[6] == pytest.approx(e[6], rel=1e-3)


def one_block(texts, ids=None, order=3):
    """(block, counts, the bucket's note) of documents, all keys in one bucket."""
    table = pa.table({"id": pa.array(ids or list(range(len(texts))), pa.int64()), "text": pa.array(texts, pa.string())})
    own = backoff_lm.Block(table, 7, 2, order)
    answers, note = backoff_lm.add_up([(keys, np.zeros(len(keys), np.int64), columns) for keys, columns in own.sections()])  # as an exchange of one block
    return own, [a[0] for a in answers], np.array(note)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("lanes", [1, 7, 4096])
def test_walk_equals_the_formula(order, lanes):
    """The states carried from token to token give what interpolation at every position gives, however texts are cut into lanes."""
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["", None, "z z z a b"]
    own, counts, note = one_block(texts, order=order)
    prior = backoff_lm.strengths(note, order)
    machine = backoff_lm.Automaton(own, counts, prior, *note[:2].tolist())
    formula = np.log10(backoff_lm.smoothed(counts, prior, *note[:2].tolist(), own.gram, own.context))
    assert np.abs(machine.walk(own.gram[0], own.first, lanes) - formula).max() < 1e-9
    if order > 2:
        assert (machine.fails[1:] < np.arange(1, len(machine.fails))).all() and len(np.unique(machine.fails)) > 1  # failures lead to shorter contexts


def test_every_state_is_a_distribution():
    """Arcs, failures and one unknown token of each state sum to one."""
    rng = random.Random(4)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    out = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    own, counts, note = one_block([" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in ids] + ["unknown"], [*ids, out])
    machine = backoff_lm.Automaton(own, counts, backoff_lm.strengths(note, 3), *note[:2].tolist())
    tokens = np.unique(own.gram[0])
    for state in range(len(machine.fails)):
        _, cost = machine.step(np.full(len(tokens), state), tokens)
        assert abs((10.0**cost).sum() - 1) < 1e-9


def test_strengths_come_from_training_counts(rows):
    own, counts, note = one_block([t for _, t in rows], [i for i, _ in rows])
    _, expected = language_model(rows, coarse=False)
    assert backoff_lm.strengths(note, 3) == pytest.approx(expected, rel=0.1)
    texts = [t if zlib.crc32(str(i).encode()) % 7 != 2 else "other words altogether" for i, t in rows]
    assert (one_block(texts, [i for i, _ in rows])[2] == note).all()  # held-out texts change nothing


def test_language_model_of_nothing(spark):
    empty = backoff_lm.score(H.frame(spark, [(1, None), (None, "x"), (2, "")])).collect()
    assert sorted(r["n_tokens"] for r in empty) == [1, 1, 2]
    assert backoff_lm.score(H.frame(spark, [(1, "x")]).where("false")).collect() == []


# ---------------------------------------------------------------- 10


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    pool, bad = H.vocabulary(rng, 400), ["zonk", "grubbel", "vexo"]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(pool) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 9))]
        y = int(rng.random() < 0.2)
        if y:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(bad)}{rng.choice(['', 'ing', '!'])}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, y))
    return rows, labels, bad


def test_toxicity(spark):
    rows, labels, bad = toxic_corpus()
    df = H.frame(spark, rows + [(5000, None), (5001, ""), (None, "zonk")])
    table = spark.createDataFrame(labels + [(5000, None), (None, 1), labels[0]], "doc_id long, toxic int")
    train = table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = toxicity.train(df, train)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    y = dict(labels)
    held = [i for i in y if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] == 0 and len(got) == len(rows) + 3
    right = [i for i in held if (got[i] >= toxicity.THRESHOLD) == bool(y[i])]
    assert len(right) >= 0.97 * len(held)
    spans = toxicity.locate(df, model).collect()
    text = dict(rows)
    hits = [text[r["doc_id"]].encode()[r["start"] : r["end"]].decode() for r in spans if r["doc_id"] in text]
    assert hits and sum(any(b in h for b in bad) for h in hits) >= 0.95 * len(hits)
    kept = {r["doc_id"] for r in toxicity.accepted(df, model).collect()}
    assert kept - {None} == {i for i, s in got.items() if s < toxicity.THRESHOLD and i is not None}
    assert toxicity.score(df.where("false"), model).collect() == []
    none = toxicity.train(df, table.where("false"))
    assert all(r["score"] == 0 for r in toxicity.score(df, none).collect() if r["doc_id"] in (5000, 5001))


def test_noisy_or_by_brute_force(spark):
    """Scores recomputed sentence by sentence, with hashes of single words."""
    import re

    rows, labels, _ = toxic_corpus(300)
    model = toxicity.train(H.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(model.known.tolist(), model.weight.tolist()))

    def hashed(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return textscan.Words(np.array([0, len(data)]), data).hashes(data, lower=True)

    def score(text):
        left = 1.0
        for sentence in re.split(r"(?<=[.!?\n])", text):
            found = set()
            for word in H.words(sentence):
                word = word.strip(".,;:!?\"'()[]{}*#$%&<>|").encode()
                if word:
                    found |= set(hashed(word.decode()).tolist())
                    for size in toxicity.PREFIXES:
                        if len(word) > size:
                            data = np.frombuffer(word[:size], np.uint8)
                            own = textscan.Words.__new__(textscan.Words)
                            own.start, own.end = np.array([0]), np.array([size])
                            found |= set(textscan.mix(own.hashes(data, lower=True) + np.uint64(size)).tolist())
            known = [weight[h] for h in found if h in weight]
            if known:
                left *= 1 - 1 / (1 + math.exp(-sum(known) - model.bias))
        return 1 - left

    extra = [(1000, "A zonk. Vexo grubbel! zonking\nzonk"), (1001, "plain")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(H.frame(spark, rows + extra), model).collect()}
    assert all(got[i] == pytest.approx(score(t), abs=1e-9) for i, t in rows + extra) and got[1000] > 0.9


def test_toxicity_trains_on_whole_texts(spark):
    """The offending words stand after 20,000 characters only."""
    rng = random.Random(4)
    pool = H.vocabulary(rng, 400)
    text = lambda y: ". ".join(" ".join(rng.choice(pool) for _ in range(8)) for _ in range(700)) + (". zonk." if y else ".")
    rows = [(i, text(i % 3 == 0)) for i in range(90)]
    assert all(t.find("zonk") > 20_000 for i, t in rows if i % 3 == 0)
    model = toxicity.train(H.frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(H.frame(spark, rows + [(900, "a zonk b."), (901, "a b.")]), model).collect()}
    assert all((s >= toxicity.THRESHOLD) == (i % 3 == 0) for i, s in got.items() if i < 901) and got[901] < toxicity.THRESHOLD


def test_toxicity_of_a_long_clean_text(spark):
    """Thousands of sentences without an offending word don't add up to a rejection, and one with such a word still counts."""
    rows, labels, _ = toxic_corpus()
    model = toxicity.train(H.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = " ".join(t for (_, t), (_, y) in zip(rows, labels) if not y) * 3
    assert clean.count(".") > 6_000
    df = H.frame(spark, [(1, clean), (2, clean + " A zonk."), (3, clean * 4)])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert got[1] < toxicity.THRESHOLD and got[3] < toxicity.THRESHOLD and got[2] >= toxicity.THRESHOLD
    assert {r["doc_id"] for r in toxicity.accepted(df, model).collect()} == {1, 3}


def test_very_long_and_equal_texts(spark, small_blocks):
    """A text of a million words among short ones, and a hundred rows that are one text."""
    rng = random.Random(14)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c"), *[(k, "one text in a hundred rows, of more than thirteen words and of more than fifty bytes") for k in range(10, 110)]]
    df = H.frame(spark, rows)
    removed = {r["doc_id"]: r["n_removed"] for r in window_dedup.window_dedup(df).collect()}
    assert removed[1] == 0 and removed[2] == 200_000 and removed[10] == 0 and removed[11] == 17 == removed[109]
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(df).collect()}
    assert groups[2] == 1 and groups[3] == 3 and {groups[k] for k in range(10, 110)} == {10}
    scores = {r["doc_id"]: r for r in backoff_lm.score(df).collect()}
    assert scores[1]["n_tokens"] == 200_001 and len({scores[k]["score"] for k in range(10, 110)}) == 1
    judged = {r["doc_id"]: r for r in line_rules.line_rules(df).collect()}
    assert judged[1]["n_words"] == 200_000 and judged[10]["n_frequent_lines"] == 1


def test_document_of_nothing(spark):
    """Every operator takes one empty document and one without words."""
    df = H.frame(spark, [(1, ""), (2, " \n ")])
    assert hashlib.sha256(b"").hexdigest() and base64.b64decode("") == b""
    assert [r["n_words"] for r in line_rules.line_rules(df).collect()] == [0, 0]
    assert {len(H.words(r["kept_text"])) for r in window_dedup.window_dedup(df).collect()} == {0}
    assert {r["component_id"] for r in jaccard_join.jaccard_join(df).collect()} == {1, 2}
    assert isinstance(pa.array([]), pa.Array)
