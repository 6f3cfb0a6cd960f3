"""Stages that turn raw documents into a tokenised training mix.

1. toxicity: documents whose noisy-or score reaches the threshold go; the model learns from the labels
   that op10 may learn from.
2. n-gram Jaccard join: of each group of near-duplicates the document with the smallest id stays.
   Rows that share an id are told apart by their texts: of equal or linked ones one row stays; rows
   without an id all stay.
3. substring dedup: repeated passages are cut out; the text becomes the remaining words, n_chars their
   length. A document of which nothing is left stays, empty.
4. mixing: every document as often as the mix takes it.
5. byte-level BPE: the ids of every row's text, and whether decoding them gives the text back.

Edge cases: a null or empty text is never toxic, is in no group, loses nothing, counts no words and has no ids; of equal texts the smallest id
stays; rows that tie in every column are one in stage 2; very long texts are taken whole in every stage; an empty table
gives an empty result; columns beyond those of documents pass the stages that return rows untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, jaccard_join, mixing, toxicity, window_dedup
from tidewell.llm.queries import read, remainder
from tidewell.llm.shared import cut, discard, stored

#: Smaller than for the operator alone: the executors have run the other stages before.
BPE_MEMO = 60_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = docs.withColumn("__text_hash", F.xxhash64("text"))
    groups = cut(
        jaccard_join.jaccard_join(marked, carry=["__text_hash"]).where("doc_id is not null")
        .select("doc_id", "component_id", "group", "carry.__text_hash")
    )
    row = ["doc_id", "__text_hash"]
    stay = marked.join(groups.where("doc_id <> component_id").select(row).distinct(), row, "left_anti")
    again = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.take(1):
        # Of an id's rows one of each group stays, and one of each text outside of groups.
        first = groups.join(again, "doc_id", "left_semi").groupBy("doc_id", "group", F.expr("if(group is null, __text_hash, null)").alias("alone")).agg(
            F.min("__text_hash").alias("__text_hash")
        )
        single = stay.join(first.select(row), row, "left_semi").dropDuplicates(row)
        stay = stay.join(again, "doc_id", "left_anti").unionByName(single)
    return stay.select(docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cleaned = window_dedup.window_dedup(docs, carry=rest).select(
        "doc_id", F.col("kept_text").alias("text"), "carry.*", F.length("kept_text").cast("long").alias("n_chars")
    )
    return cleaned.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__text_hash", F.xxhash64("text"))
    return byte_bpe.round_trip(texts, ranks, pattern, carry=["lang", "source", "n_chars", "__text_hash"], memo=BPE_MEMO).select(
        "doc_id", "lang", "source", "n_chars",
        F.floor(F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        "ids_le", (F.xxhash64("decoded") == F.col("__text_hash")).alias("decodes"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenise),
]

#: SQL can express neither the trained model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet and read again as the next one's documents; what the one before read is removed then."""
    docs, name = read(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = stored(docs, f"{name}/{k}.parquet")
        if k > 1:
            discard(spark, f"{name}/{k - 1}.parquet")
        docs = stage(spark, docs, sf_dir)
    return docs
