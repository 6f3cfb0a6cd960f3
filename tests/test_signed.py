"""Signatures, addresses, references, markup, file and relay sources, and the ingestion stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell import __main__ as jobs
from tidewell import service
from tidewell.functions import events, markup
from tidewell.operators import state
from tidewell.sources import files, relay, schemas
from tidewell.streaming import collection, ingest

NOW = 1_800_000_000


def test_published_vector():
    # BIP-340 test vector 0.
    public, message = "F9308A019258C31049344F85F89D5229B531C845836F99B08601F113BCE036F9", bytes(32)
    signature = "E907831F80848D1069A5371B402410364BDF1C5F8307B0084C55F1CE2DCA821525F66A4A85EA8B71E482A74F382D2CE5EBEEE8FDB2172F477DF4900D310536C0"
    assert events.schnorr_verify(message, bytes.fromhex(public), bytes.fromhex(signature))
    assert not events.schnorr_verify(message[:-1] + b"\1", bytes.fromhex(public), bytes.fromhex(signature))


def signed(secret=3, **fields):
    return events.sign_event({"created_at": NOW - 5, "kind": 1, "tags": [], "content": "grüße"} | fields, secret)


def test_tampering():
    good = signed()
    assert events.verify_event(good)
    for change in ({"content": "x"}, {"id": "0" * 64}, {"sig": "0" * 128}, {"pubkey": "F" * 64}, {"created_at": None}, {"sig": good["sig"] + "\n"}):
        assert not events.verify_event(good | change)
    assert not events.verify_event({})


def test_bech32():
    # A published example of the encoding.
    assert events.npub("7e7e9c42a91bfef19fa929e5fda1b72e0ebc1a4c1141673e2794234d86addf4e") == "npub10elfcs4fr0l0r8af98jlmgdh9c8tcxjvz9qkw038js35mp4dma8qzvjptg"
    with pytest.raises(ValueError):
        events.npub("00")


def test_thread_refs(spark):
    a, b, c = "a" * 64, "b" * 64, "c" * 64
    cases = [
        ([["e", a, "", "root"], ["e", b, "", "reply"], ["e", c]], (a, b)), ([["e", a], ["e", b], ["e", c]], (a, c)), ([["e", a, "", "root"]], (a, a)),
        ([["e", b, "", "reply"]], (b, b)), ([["e", "bad"], ["p", a], ["e"]], (None, None)), ([], (None, None)), (None, (None, None)), ([["e", a, "", "mention"]], (None, None)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags array<array<string>>")
    got = {r["i"]: (r["r"]["root"], r["r"]["reply"]) for r in df.select("i", events.thread_refs(F.col("tags")).alias("r")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_markup():
    assert markup.render("#tag\n# Head") == "<p>#tag</p>\n<h1>Head</h1>"
    assert "<script" not in markup.render("<script>alert(1)</script> [x](javascript:alert(1))") and "javascript" not in markup.render("[x](javascript:y)")
    assert markup.render("see https://a.b/c_(d), ok").count('href="https://a.b/c_(d)"') == 1
    assert markup.render("(https://a.b)") == '<p>(<a href="https://a.b" rel="noopener noreferrer">https://a.b</a>)</p>'
    assert markup.render("```\n# <x> https://a.b\n```") == "<pre><code># &lt;x&gt; https://a.b</code></pre>"
    assert markup.render("![](u) ![cat](u)") == "<p>[image.png] [image: cat]</p>" and markup.render(None) == ""


def test_markup_blocks():
    assert markup.render("> a\n> > b\n> - c\nd") == "<blockquote><p>a</p>\n<blockquote><p>b</p></blockquote>\n<ul><li>c</li></ul></blockquote>\n<p>d</p>"
    assert markup.render("1. one\n2. two\n   - in *two*\n     more\n\n- x\n- y") == "<ol><li>one</li><li>two\n<ul><li>in <em>two</em>\n<p>more</p></li></ul></li></ol>\n<ul><li>x</li><li>y</li></ul>"
    assert markup.render("Title\n===\nSub\n---\n\n---\na  \nb\nc") == "<h1>Title</h1>\n<h2>Sub</h2>\n<hr>\n<p>a<br>\nb\nc</p>"
    assert markup.render("    <b>\n\tx\n\n## H ##\n~~~\nopen <i>") == "<pre><code>&lt;b&gt;\nx</code></pre>\n<h2>H</h2>\n<pre><code>open &lt;i&gt;</code></pre>"
    assert markup.render("> ```\n> # <x>\n> ```") == "<blockquote><pre><code># &lt;x&gt;</code></pre></blockquote>"
    deep = markup.render("\n".join(">" * k + " q" for k in range(1, 60)))
    assert deep.count("<blockquote>") == deep.count("</blockquote>") == 59
    assert 0 < markup.render(">" * 20_000).count("<blockquote>") < 100 and markup.render("\n".join(" " * k + "- x" for k in range(2000)))


def test_blocklist(spark, tmp_path):
    path = tmp_path / "block.txt"
    with pytest.raises(FileNotFoundError):
        files.blocklist(spark, str(path))
    path.write_text("# note\n  abc  \n\nabc\n")
    assert [r[0] for r in files.blocklist(spark, str(path)).collect()] == ["abc"]


def test_list_members(spark):
    key, secret = "ab" * 32, 11
    author = signed(secret)["pubkey"]
    event = {"kind": 30000, "tags": [["d", "spam"], ["p", key], ["p", key], ["p", "x"], ["p"]]}

    def members(own):
        rows = spark.createDataFrame([(json.dumps(own), own["pubkey"], own["kind"], own["tags"])], "json string, pubkey string, kind int, tags array<array<string>>")
        return {r[0] for r in files.list_members(rows, "spam", author).collect()}

    assert members(signed(secret, **event)) == {key}
    bad = [signed(secret, **event | {"kind": 1}), signed(12, **event), signed(secret, **event | {"tags": [["d", "other"]]}), signed(secret, **event | {"tags": [["d", "spam"], ["d", "spam"]]}), signed(secret, **event) | {"content": "changed"}]
    for own, fault in zip(bad, ("kind", "author", "name", "name", "signature")):
        with pytest.raises(Exception, match=f"list spam isn't usable: .*{fault}"):
            members(own)


def frames(n, end=True):
    rows = [json.dumps(["EVENT", "s", {"id": f"{i:02d}", "pubkey": "k", "created_at": 100 - i, "kind": 1}]) for i in range(n)]
    return rows + ([json.dumps(["EOSE", "s"])] if end else [json.dumps(["NOTICE", "slow"])])


def test_frames_and_cursor():
    assert relay.gather(frames(3)).reason == "end" and len(relay.gather(frames(3)).events) == 3 and relay.gather([]).reason == "silence"
    assert relay.gather(frames(3, end=False)).reason == "refused" and relay.gather(frames(50), 200).reason == "size"
    assert relay.next_cursor(None, [{"created_at": 5}], True, 2) == (5, True) and relay.next_cursor(5, [{"created_at": 5}], True, 1) == (5, True)
    assert relay.next_cursor(9, [{"created_at": 5}], True, 1) == (5, False)
    assert relay.spend(1) == (0, True) and relay.spend(0) == (0, False) and relay.spend(2, 3) == (2, False)


def test_list_source(spark, tmp_path):
    event = signed(11, kind=30000, tags=[["d", "spam"], ["p", "ab" * 32]])
    (tmp_path / "spam.jsonl").write_text(json.dumps(["EVENT", "s", event]) + "\n" + json.dumps(["EOSE", "s"]))
    (tmp_path / "none.jsonl").write_text(json.dumps(["EOSE", "s"]))
    spark.dataSource.register(relay.ListSource)
    read = lambda **k: spark.read.format("moderation_list").options(folder=str(tmp_path), **k).load()
    rows = read(relays="spam,none")
    assert [(r["relay"], r["kind"]) for r in rows.collect()] == [("spam", 30000)]
    parsed = rows.select("json", F.from_json("json", files.EVENT).alias("e")).select("json", "e.*")
    assert [r[0] for r in files.list_members(parsed, "spam", event["pubkey"]).collect()] == ["ab" * 32]
    with pytest.raises(Exception, match="more than 50 bytes"):
        read(relays="spam", bytes="50").collect()
    ticks = iter([0.0, 1.0, 99.0])
    with pytest.raises(TimeoutError):
        relay.first_event(frames(5), 12, 10_000, lambda: next(ticks))


class Broken(relay.Recorded):
    """A transport that a test names: the relay stops in the middle."""

    def frames(self, name, until, limit, asked=None):
        yield from list(super().frames(name, until, limit, asked))[:2]


def test_transport_is_chosen_by_name(spark, tmp_path):
    (tmp_path / "wss_one.jsonl").write_text("\n".join(frames(7)))
    spark.dataSource.register(relay.RelaySource)
    rows = spark.read.format("relay").options(folder=str(tmp_path), relays="wss://one", transport="tests.test_signed:Broken").load().collect()
    assert [(r["id"], r["reason"]) for r in rows] == [("00", "silence"), ("01", "silence"), (None, "silence")]


def test_relay_source(spark, tmp_path):
    (tmp_path / "wss_one.jsonl").write_text("\n".join(frames(7)))
    spark.dataSource.register(relay.RelaySource)
    options = {"folder": str(tmp_path), "relays": "wss://one"}
    assert spark.read.format("relay").options(**options).load().count() == 7
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = spark.readStream.format("relay").options(**options, limit="3", requests="9").load()
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
    running.processAllAvailable()
    running.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [f"{i:02d}" for i in range(7)]


def test_stream_of_events(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    root = signed(content="root")
    reply = signed(4, content="reply", tags=[["e", root["id"], "", "root"]])
    lines = [
        root, root, reply, signed(5, content="AKIA" + "A" * 16), signed(6, created_at=NOW + 9), signed(7) | {"content": "changed"},
        signed(8, kind=0, created_at=NOW - 9, content="{}"), signed(8, kind=0, created_at=NOW - 7, content='{"name": "n"}'), signed(9),
    ]
    (source / "a.jsonl").write_text("\n".join(json.dumps(e, ensure_ascii=False) for e in lines) + "\nbroken\n")
    folder = str(tmp_path / "state")
    ingest.collect(spark, str(source), folder, str(tmp_path / "mark"), NOW, blocked=[signed(9)["pubkey"]])
    tables = ingest.stored(spark, folder)
    kept = {r["text"]: r for r in tables["posts"].collect()}
    assert set(kept) == {"root", "reply"} and kept["reply"]["parent_id"] == f"nostr:{root['id']}"
    assert kept["root"]["author_name"] == root["pubkey"][:12] and kept["root"]["url"].endswith(root["id"])
    assert [r["content"] for r in tables["metadata"].collect()] == ['{"name": "n"}']
    rows = files.events(spark, str(source))
    counts = {r["verdict"]: r["n"] for r in ingest.report(ingest.judged(rows, NOW, [signed(9)["pubkey"]], [], [{}])).collect()}
    assert counts == {"accept": 4, "secret:aws access key": 1, "outside": 1, "invalid": 2, "blocklist": 1}
    # The same filters as a list and as a table.
    asked = spark.createDataFrame([(1, None, [root["pubkey"]], [1], None, None), (2, [reply["id"]], None, None, None, None)], "filter long, ids array<string>, authors array<string>, kinds array<long>, since long, until long")
    found = [{(r["id"], r["verdict"]) for r in ingest.judged(rows, NOW, filters=f).collect()} for f in (asked, [{"authors": [root["pubkey"]], "kinds": [1]}, {"ids": [reply["id"]]}])]
    assert found[0] == found[1] and (signed(9)["id"], "mismatched") in found[0]


def test_merge_labels_edges_and_names(spark):
    """One batch into empty tables, then a second one: labels become warnings, a new list replaces all edges, a profile names its posts."""
    a, b = "ab" * 32, "cd" * 32
    first = [
        signed(3, kind=3, tags=[["p", a], ["p", b], ["p", "bad"]], created_at=NOW - 50), signed(3, kind=0, content='{"display_name": "Ann"}'),
        signed(3, content="same words"), signed(3, content="same words", created_at=NOW - 6), signed(4, content="x", tags=[["content-warning", ""]]),
        signed(5, content=" ".join(["https://a.b/c"] * 6)), signed(6, content="z" * 70_000),
    ]
    second = [signed(3, kind=3, tags=[["p", b]], created_at=NOW - 40), signed(3, kind=3, tags=[["p", a]], created_at=NOW - 60), first[2], signed(7, kind=7)]

    def batch(tables, events):
        frame = spark.createDataFrame([(json.dumps(e, ensure_ascii=False),) for e in events], "value string")
        return ingest.judged(ingest.parsed(frame), NOW), tables

    events, tables = batch(schemas.empty(spark), first)
    one = ingest.merged(tables, events, NOW)
    assert {tuple(r) for r in one["follows"].collect()} == {(first[0]["pubkey"], a), (first[0]["pubkey"], b)}
    posts = {r["source_id"]: r for r in one["posts"].collect()}
    assert posts[first[2]["id"]]["author_name"] == "Ann" and posts[first[4]["id"]]["author_name"] == first[4]["pubkey"][:12] and len(posts[first[6]["id"]]["text"]) == 65_549
    found = {(r["canonical_id"][6:], r["category"], r["reason"]) for r in one["warnings"].collect()}
    assert found == {
        (first[2]["id"], "spam", "auto-flagged: spam duplicate-content"), (first[3]["id"], "spam", "auto-flagged: spam duplicate-content"),
        (first[4]["id"], "author-cw", "author: unspecified"), (first[5]["id"], "spam", "auto-flagged: spam link-farm"),
    }
    assert {(r["label"], r["n"]) for r in ingest.label_report(events).collect()} == {("author-cw", 1), ("spam", 1)}
    events, tables = batch(one, second)
    two = ingest.merged(tables, events, NOW)
    assert {tuple(r) for r in two["follows"].collect()} == {(first[0]["pubkey"], b)} and two["posts"].count() == 5
    assert {(r["action"], r["n"]) for r in ingest.changes(one["posts"], two["posts"]).collect()} == {("unchanged", 5)}
    with pytest.raises(Exception, match="not a metadata kind: 7"):
        ingest.metadata_of(events.where("kind = 7")).collect()


def test_collection_pass(spark, tmp_path):
    root = events.sign_event({"created_at": NOW - 100, "kind": 3, "tags": [], "content": ""}, 21)["pubkey"]
    friend, far = signed(22)["pubkey"], signed(23)["pubkey"]
    parent = signed(24, content="the parent", created_at=NOW - 90)
    stream = [
        signed(21, kind=3, tags=[["p", friend]], created_at=NOW - 100), signed(22, kind=3, tags=[["p", far]], created_at=NOW - 99), signed(22, kind=0, content='{"name": "Friend"}', created_at=NOW - 98),
        signed(22, kind=10002, tags=[["r", "wss://two/"], ["r", "wss://three", "read"], ["r", "nonsense"]], created_at=NOW - 97),
        signed(22, content="a reply", tags=[["e", parent["id"], "", "reply"]], created_at=NOW - 80), *[signed(22, content=f"post {i}", created_at=NOW - 1000 - i) for i in range(7)],
        signed(23, content="from afar", created_at=NOW - 70), parent, signed(22, content="AKIA" + "B" * 16, created_at=NOW - 60),
    ]
    lists = {"spam": signed(30, kind=30000, tags=[["d", "spam"], ["p", far]], created_at=NOW - 9), "nsfw": signed(30, kind=30000, tags=[["d", "nsfw"]], created_at=NOW - 9)}
    write = lambda name, rows: (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(["EVENT", "s", e]) for e in rows) + "\n" + json.dumps(["EOSE", "s"]))
    write("wss_one", stream)
    for name, event in lists.items():
        write(name, [event])
    settings = collection.Settings(root=root, relays=["wss://one", "wss://gone"], options={"folder": str(tmp_path), "limit": "4"}, list_author=signed(30)["pubkey"], requests=30)
    folder = str(tmp_path / "state")
    done = collection.one_pass(spark, folder, settings, NOW, blocked=[])
    tables = ingest.stored(spark, folder)
    texts = {r["text"] for r in tables["posts"].collect()}
    assert {"a reply", "the parent", "from afar", "post 0"} <= texts and not any("AKIA" in t for t in texts)
    assert {tuple(r) for r in tables["follows"].collect()} == {(root, friend), (friend, far)}
    assert ("auto-flagged: spam curated list",) in {(r["reason"],) for r in tables["warnings"].collect()}
    assert 0 < done["requests_used"] <= 30 and done["verdicts"]["secret:aws access key"] == 1 and any("wss://gone" in g for g in done["gaps"])
    answer = lambda target: service.respond(spark, folder, root, target, NOW)
    code, page = answer("/?mode=new")
    assert code == 200 and page["results"][0]["author"] and page["results"][0]["profile_url"].startswith("https://njump.me/npub1") and not page["has_next"]
    by_text = {r["preview"]: r for r in page["results"]}
    assert by_text["a reply"]["author"] == "Friend" and by_text["a reply"]["full_html"] == "<p>a reply</p>" and by_text["a reply"]["parent_excerpt"] == "the parent"
    code, page = answer("/?mode=discovery&reach=2")
    assert {r["score"] for r in page["results"]} >= {"1 hop · you follow", "2 hops · connection 2.00"} and page["link"].startswith("mode=discovery")
    code, page = answer("/?q=reply&go=1")
    assert [r["preview"] for r in page["results"]] == ["a reply"] and page["results"][0]["score"].startswith("match ")
    assert answer("/?q=%22open")[1]["error"] and answer("/search?q=x") == (301, {"location": "/?q=x"}) and answer("/nowhere")[0] == 404
    code, page = answer(f"/context?id={by_text['a reply']['canonical_id']}")
    assert [r["text"] for r in page["ancestors"]] == ["the parent"] and page["ends"] == [] and answer("/context?id=x")[0] == 404
    assert answer("/status")[1]["sources"][0]["posts"] == len(texts)
    assert done["relays"] == ["wss://one", "wss://gone", "wss://two"]
    status = tables["status"].first()
    assert status["source"] == "nostr" and json.loads(status["detail"])["requests_used"] == done["requests_used"]
    assert {(r["name"], r["attempted_at"]) for r in tables["lists"].collect()} == {("spam", NOW), ("nsfw", NOW)}
    older = min(int(t.split()[1]) for t in texts if t.startswith("post"))
    again = collection.one_pass(spark, folder, settings, NOW + 60, blocked=[friend])
    tables = ingest.stored(spark, folder)
    assert {r["author_id"] for r in tables["posts"].collect()} == {far, parent["pubkey"]} and older == 0  # a blocked author goes, stored posts too
    assert {r["attempted_at"] for r in tables["lists"].collect()} == {NOW} and again["lists"] == {"spam": "not due", "nsfw": "not due"}
    waits = []
    assert len(list(collection.run(spark, folder, settings, lambda: NOW + 31 * 86400, passes=2, every=600, wait=waits.append))) == 2
    assert waits == [600] and ingest.stored(spark, folder)["posts"].count() == 0  # all have left the window


def embedder(posts):
    return posts.select("canonical_id", F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))


def test_jobs(spark, tmp_path, capsys):
    own = jobs.parser()
    for bad in (["serve", "--state", "s", "--root", "x"], ["collect", "--state", "s", "--root", "ab" * 32, "--relays", "r", "--interval", "5"]):
        with pytest.raises(SystemExit):
            jobs.checked(own.parse_args(bad), own)
    frame = spark.createDataFrame([(json.dumps(signed(3, content="x")),)], "value string")
    tables = ingest.merged(schemas.empty(spark), ingest.judged(ingest.parsed(frame), NOW), NOW)
    state.publish_all(tables, str(tmp_path / "state"))
    schemas.views(tables)
    assert spark.sql("select count(*) from posts").first()[0] == 1
    base = ["--state", str(tmp_path / "state"), "--vectors", str(tmp_path / "vectors")]
    jobs.main(["embed", *base, "--embedder", "tests.test_signed:embedder", "--now", str(NOW)])
    jobs.main(["verify", *base])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines == [{"n": 1, "least": 5.0, "most": 5.0, "finite": True}] * 2
