"""The queries and the pipeline as registered, stage by stage against brute force."""

from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import helpers as H
from tidewell.llm import byte_bpe, toxicity
from tidewell.llm.queries import remainder

OWN = [n for n in entry.queries() if n.startswith("op")]


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OWN) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "mixing", "byte-level BPE"]


@pytest.mark.parametrize("name", OWN)
def test_whole_tables(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    table = "embeddings" if name.startswith(("op1_", "op11_", "op13_")) else "documents"
    assert df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    clean = steps["toxicity"](spark, docs, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert clean.columns == columns and {i for i, _ in rows} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    _, component = H.jaccard(rows)
    single = steps["n-gram Jaccard join"](spark, clean, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert single.columns == columns and sorted(i for i, _ in rows) == sorted(i for i, c in component.items() if i == c)
    cut = steps["substring dedup"](spark, single, sf_dir).cache()
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert cut.columns == columns and got == {i: (t, len(t)) for i, (_, _, t) in H.window_dedup(rows).items()}
    mixed = steps["mixing"](spark, cut, sf_dir).cache()
    assert mixed.columns == columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    last = steps["byte-level BPE"](spark, mixed, sf_dir).collect()
    own = byte_bpe.Codec(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    expected = Counter((r["doc_id"], own.encode(r["text"])) for r in mixed.collect())
    assert Counter((r["doc_id"], bytes(r["ids_le"])) for r in last) == expected and all(r["decodes"] for r in last)
    assert all(len(np.frombuffer(bytes(r["ids_le"]), "<u4")) == r["n_tokens"] for r in last)


def test_repeated_and_nameless_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "A b c d e f g", None, None, None), (None, "a b c d e f g", "en", "s", 1), (None, None, "en", "s", None), (3, None, "en", None, 0)], H.DOCS)
    got = sorted((str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()))
    assert got == ["1", "3", "None", "None"]
    assert corpus_pipeline.cut_passages(spark, docs, sf_dir).count() == 6
    out = corpus_pipeline.tokenise(spark, corpus_pipeline.mix_sources(spark, docs, sf_dir), sf_dir).collect()
    assert all(r["decodes"] for r in out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).collect() == []


def test_id_with_two_texts(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = H.frame(spark, [(5, a), (5, b), (5, b + " more"), (5, b), (7, b), (2, a), (6, c), (6, "x"), (6, "y"), (6, "y")])
    got = sorted((r["doc_id"], r["text"][:2]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert got == [(2, "a0"), (5, "b0"), (6, "c0"), (6, "x"), (6, "y")]


def test_stages_read_what_was_written(spark, sf_dir, monkeypatch):
    """Every stage after the first sees a Parquet file, so that what it evaluates twice is the same twice."""
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        assert docs.select("draw").collect() == docs.select("draw").collect() if "draw" in docs.columns else True
        return docs.select("doc_id").selectExpr("doc_id", "uuid() as draw").unionByName(docs.selectExpr("doc_id", "uuid() as draw"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    corpus_pipeline.run(spark, sf_dir)
    assert len({tuple(f) for f in seen}) == 3 and all("documents.parquet" not in f for files in seen[1:] for f in files)
