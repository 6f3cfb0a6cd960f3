"""Ingestion: events are judged, labelled and merged into the stored tables by one commit.

Everything is a plan from the latest commit and a batch of events to the next one, so a failed batch changes nothing, and a
batch that comes twice changes nothing either. Posts and their labels lie by day, what belongs to an account by buckets of its key:
a batch reads and rewrites the days and buckets of its own events, whatever else is stored (``planned``).
``merged`` is the same for whole tables in memory, as a collection pass needs it between its rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.events import thread_refs, verified, warning_reason
from ..operators import commits, daily, enrich, moderation, state, sweeps
from ..operators.window import WINDOW
from ..sources import schemas
from ..sources.files import EVENT

METADATA_KINDS = (0, 3, 10002)
SPAM_LIST, NSFW_LIST = "spam", "nsfw"
POST_URL = "https://njump.me/"
#: Parts of the tables that lie by account.
BUCKETS = 64
#: (author_id, text_hash, canonical_id, created_at) of stored posts: where repeated texts are looked up.
TEXTS = "texts"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events (json, and the event's fields) of JSON texts."""
    return lines.select(F.col(column).alias("json"), F.from_json(column, EVENT).alias("e")).select("json", "e.*")


def _marked(events: DataFrame, key: str, entries: DataFrame, name: str) -> DataFrame:
    """Adds whether ``key`` is among the entries: a left join, which Spark broadcasts where its size allows."""
    return events.join(entries.select(F.col("entry").alias(key), F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def entries(spark: SparkSession, values: Sequence[str] | DataFrame | None) -> DataFrame:
    if isinstance(values, DataFrame):
        return values.select("entry").distinct()
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values or ())], "entry string")


def judged(events: DataFrame, now: int, blocked=(), curated=(), filters: list[dict] | DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """Events (json, id, pubkey, created_at, kind, tags, content) with a verdict and labels.

    ``blocked`` (keys and ids) and ``curated`` (keys) are tables with a column ``entry``, or short lists; so are ``filters``, as a table
    the columns of ``sweeps.matching``. Late and future events are told by the clock given, not by a watermark; ``window`` is how many
    seconds before it a post may lie.
    """
    spark = events.sparkSession
    barred, listed = entries(spark, blocked), entries(spark, curated)
    rows = _marked(_marked(_marked(events, "pubkey", barred, "__author"), "id", barred, "__event"), "pubkey", listed, "__nsfw")
    if isinstance(filters, DataFrame):
        rows = _marked(rows, "id", sweeps.matching(events, filters).select(F.col("id").alias("entry")).distinct(), "__asked")
        asked = F.col("__asked")
    else:
        asked = moderation.matches_filters(filters or [{}])
    everything = F.concat_ws(" ", "content", F.flatten(F.coalesce("tags", F.array().cast("array<array<string>>"))))
    post = F.col("kind") == 1
    word = moderation.verdict(
        F.coalesce(verified("json"), F.lit(False)), asked, everything, post & (F.col("__author") | F.col("__event")), post & F.col("__nsfw")
    )
    inside = F.col("created_at").between(now - window, now)
    labels = F.array_compact(
        F.array(
            F.when(warning_reason(F.col("tags")).isNotNull(), F.lit("author-cw")),
            F.when(moderation.explicit(F.col("content")), F.lit("explicit")),
            F.when(moderation.link_farm(F.col("content")), F.lit("spam")),
        )
    )
    return rows.withColumn("verdict", F.when(~inside & post & (word == "accept"), "outside").otherwise(word)).withColumn("labels", labels).drop("__author", "__event", "__nsfw", "__asked")


def metadata_of(events: DataFrame) -> DataFrame:
    """Metadata rows of accepted events; only the known kinds are metadata, any other raises."""
    fault = F.concat(F.lit("not a metadata kind: "), F.coalesce(F.col("kind").cast("string"), F.lit("null")))
    kind = F.when(F.col("kind").isin(*METADATA_KINDS), F.col("kind")).otherwise(F.raise_error(fault).cast("int"))
    relay = F.col("relay") if "relay" in events.columns else F.lit(None).cast("string")
    return events.select("pubkey", kind.alias("kind"), "created_at", F.col("id").alias("event_id"), "tags", "content", F.col("json").alias("event_json"), relay.alias("relay"))


def ingest_name(profile, author):
    """Name at ingestion: the profile's display name or name, else the key's first 12 letters."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(filled(F.get_json_object(profile, "$.display_name")), filled(F.get_json_object(profile, "$.name")), F.substring(author, 1, 12))


def posts_of(events: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Accepted kind-1 events as posts: clipped text, address, references, and the name that the stored profile gives."""
    refs = thread_refs(F.col("tags"))
    point = lambda c: F.when(c.isNotNull(), F.concat(F.lit("nostr:"), c))
    rows = events.where("kind = 1")
    if metadata is None:
        rows = rows.withColumn("profile", F.lit(None).cast("string"))
    else:
        rows = rows.join(metadata.where("kind = 0").select("pubkey", F.col("content").alias("profile")), "pubkey", "left")
    return rows.select(
        F.concat(F.lit("nostr:"), "id").alias("canonical_id"), F.lit("nostr").alias("source"), F.col("id").alias("source_id"), F.col("pubkey").alias("author_id"),
        ingest_name(F.col("profile"), F.col("pubkey")).alias("author_name"), enrich.clip(F.col("content")).alias("text"), "created_at",
        F.concat(F.lit(POST_URL), "id").alias("url"), point(refs["reply"]).alias("parent_id"), point(refs["root"]).alias("root_id"),
    )


def _reasons(posts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(canonical_id, reason): link farms, and posts whose text is repeated."""
    farms = posts.where(moderation.link_farm(F.col("text")))
    return farms.select("canonical_id", F.lit("link-farm").alias("reason")).union(repeated.select("canonical_id", F.lit("duplicate-content")))


def spam_labels(posts: DataFrame, stored: DataFrame) -> DataFrame:
    """(canonical_id, reason): link farms, and texts that their author has also posted under another id."""
    both = stored.join(posts.select("canonical_id"), "canonical_id", "left_anti").select("canonical_id", "author_id", "text").unionByName(posts.select("canonical_id", "author_id", "text"))
    return _reasons(posts, moderation.duplicates(both).where("n_duplicates > 0").join(posts.select("canonical_id"), "canonical_id", "left_semi"))


def warnings_of(events: DataFrame, posts: DataFrame, stored: DataFrame, spammers: DataFrame, now: int) -> DataFrame:
    """(canonical_id, category, reason, created_at, seq) for accepted posts: the author's, explicit terms, spam, and listed authors."""
    return _labels(events, posts, spam_labels(posts, stored), spammers, now)


def _labels(events: DataFrame, posts: DataFrame, spam_reasons: DataFrame, spammers: DataFrame, now: int) -> DataFrame:
    rows = events.where("kind = 1").withColumn("canonical_id", F.concat(F.lit("nostr:"), "id"))
    told = rows.withColumn("said", warning_reason(F.col("tags"))).where("said is not null").select("canonical_id", F.lit("author-cw").alias("category"), F.concat(F.lit("author: "), "said").alias("reason"))
    frank = rows.where(moderation.explicit(F.col("content"))).select("canonical_id", F.lit("explicit"), F.lit("auto-flagged: explicit"))
    reasons = spam_reasons.groupBy("canonical_id").agg(F.min("reason").alias("reason"))
    spam = reasons.select("canonical_id", F.lit("spam"), F.concat(F.lit("auto-flagged: spam "), "reason"))
    listed = posts.join(spammers.select(F.col("entry").alias("author_id")), "author_id", "left_semi").select("canonical_id", F.lit("spam-list"), F.lit("auto-flagged: spam curated list"))
    return reduce(DataFrame.union, (told, frank, spam, listed)).withColumn("created_at", F.lit(now).cast("long")).withColumn("seq", F.lit(1))


def report(events: DataFrame) -> DataFrame:
    """(verdict, n): ids counted once a rule, broken copies each."""
    return events.groupBy("verdict").agg(F.count_distinct(F.coalesce("id", F.xxhash64("json").cast("string"))).alias("n"))


def label_report(events: DataFrame) -> DataFrame:
    """(label, n): accepted posts of each label, each id once however many relays sent it."""
    rows = events.where("verdict = 'accept' and kind = 1")
    return rows.select("id", F.explode("labels").alias("label")).groupBy("label").agg(F.count_distinct("id").alias("n"))


def members(lists: DataFrame, name: str) -> DataFrame:
    """(entry) of a stored list."""
    return lists.where(F.col("name") == name).select(F.explode("members").alias("entry")).distinct()


def merged(tables: dict[str, DataFrame], events: DataFrame, now: int, blocked=()) -> dict[str, DataFrame]:
    """The next tables after a batch of judged events: posts, metadata, follows and warnings. Each id counts once."""
    spark = events.sparkSession
    taken = events.where("verdict = 'accept'").dropDuplicates(["id"])
    fresh_meta = metadata_of(taken.where(F.col("kind").isin(*METADATA_KINDS)))
    metadata = state.merge_latest(tables["metadata"], fresh_meta, ["pubkey", "kind"], "created_at", "event_id")
    fresh = posts_of(taken, metadata)
    found = warnings_of(taken, fresh, tables["posts"], members(tables["lists"], SPAM_LIST), now)
    warnings = state.warnings_upsert(tables["warnings"].withColumn("seq", F.lit(0)), found)
    barred = entries(spark, blocked)
    posts = state.upsert(tables["posts"], fresh, "canonical_id")
    posts = moderation.purge(posts, barred.withColumnRenamed("entry", "author_id"), barred.select(F.concat(F.lit("nostr:"), "entry").alias("canonical_id")))
    clean = ~F.coalesce(moderation.secret(F.col("text")).isNotNull(), F.lit(False))
    held = ~F.coalesce(moderation.secret(F.col("event_json")).isNotNull(), F.lit(False))
    kept, warned = state.expire(posts.where(clean), warnings, now)
    metadata = metadata.where(held)
    return tables | {"posts": kept, "metadata": metadata, "follows": state.edges(metadata.where("kind = 3")), "warnings": warned}


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(action, n): posts by what the merge did to them."""
    compared = [c for c in new.columns if c not in ("canonical_id", "author_name")]
    return state.upsert_actions(old, new, "canonical_id", compared).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def bucket(account: str):
    return F.pmod(F.xxhash64(account), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select(commits.PART).distinct().collect())  # BUCKETS at most


def text_keys(posts: DataFrame) -> DataFrame:
    return posts.select("author_id", F.xxhash64("text").alias("text_hash"), "canonical_id", "created_at", bucket("author_id").alias(commits.PART))


def opened(spark: SparkSession, folder: str) -> tuple[commits.Snapshot, dict[str, DataFrame]]:
    """(latest commit, its tables); a store begins with empty tables."""
    base = commits.snapshot(spark, folder)
    return base, schemas.empty(spark) | {n: base.read(n).drop(commits.PART) for n in schemas.TABLES if n in base.tables}


def stored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the latest commit; posts keep the column of their day, by which the window's are read."""
    base, tables = opened(spark, folder)
    return tables | ({"posts": base.read("posts")} if "posts" in base.tables else {})


def whole(tables: dict[str, DataFrame]) -> dict[str, commits.Write]:
    """Whole tables as a store keeps them."""
    posts = daily.split(tables["posts"].drop(commits.PART))
    writes = {
        "posts": commits.Write(posts, order=daily.ORDER), TEXTS: commits.Write(text_keys(posts)),
        "warnings": commits.Write(tables["warnings"].join(posts.select("canonical_id", commits.PART), "canonical_id")),
        "metadata": commits.Write(tables["metadata"].withColumn(commits.PART, bucket("pubkey"))),
        "follows": commits.Write(tables["follows"].withColumn(commits.PART, bucket("follower"))),
    }
    return writes | {n: commits.Write(tables[n]) for n in ("lists", "cursors", "status")}


def repeated(fresh: DataFrame, known: DataFrame, now: int) -> DataFrame:
    """(canonical_id) of fresh posts whose author has the same text under another id, stored inside the window or in the batch."""
    own, key = text_keys(fresh), ["author_id", "text_hash"]
    ids = known.where(F.col("created_at") >= now - WINDOW).select(*key, "canonical_id").union(own.select(*key, "canonical_id")).distinct()
    several = ids.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)  # sums, no group in one place
    return own.join(several, key, "left_semi").select("canonical_id")


def planned(base: commits.Snapshot, events: DataFrame, now: int, blocked=()) -> dict[str, commits.Write]:
    """The days and buckets that a batch of judged events changes, rewritten; everything else stays where it is."""
    spark, part = base.spark, commits.PART
    tables = schemas.empty(spark)
    read = lambda name, parts=None: base.read(name, parts) if name in base.tables else tables[name].withColumn(part, F.lit(None).cast("int"))
    taken, barred = events.where("verdict = 'accept'").dropDuplicates(["id"]), entries(spark, blocked)
    writes: dict[str, commits.Write] = {}

    fresh_meta = metadata_of(taken.where(F.col("kind").isin(*METADATA_KINDS))).where(~F.coalesce(moderation.secret(F.col("event_json")).isNotNull(), F.lit(False)))
    fresh_meta = fresh_meta.withColumn(part, bucket("pubkey"))
    touched = buckets_of(fresh_meta)
    metadata = state.merge_latest(read("metadata", touched), fresh_meta, ["pubkey", "kind"], "created_at", "event_id")
    if touched:
        writes["metadata"] = commits.Write(metadata, touched, alone=True)
        writes["follows"] = commits.Write(state.edges(metadata.where("kind = 3")).withColumn(part, bucket("follower")), touched, alone=True)

    fresh = taken.where("kind = 1").where(F.col("created_at").between(now - WINDOW, now))
    writers = buckets_of(fresh.select(bucket("pubkey").alias(part)))
    named = read("metadata", writers).where("kind = 0").join(fresh.select("pubkey"), "pubkey", "left_semi").unionByName(metadata.where("kind = 0"))
    fresh = posts_of(fresh, state.latest(named, ["pubkey"], "created_at", "event_id"))
    fresh = fresh.where(~F.coalesce(moderation.secret(F.col("text")).isNotNull(), F.lit(False)))
    fresh = moderation.purge(fresh, barred.withColumnRenamed("entry", "author_id"), barred.select(F.concat(F.lit("nostr:"), "entry").alias("canonical_id")))
    news = daily.merge(base, "posts", fresh, moves=False)  # an event's id fixes its time
    days = daily.days_of(daily.split(fresh).select(part))
    if days:
        authors = buckets_of(text_keys(fresh))
        known = base.read(TEXTS, authors) if TEXTS in base.tables else text_keys(fresh.limit(0))
        again = repeated(fresh, known, now)
        found = labels_of(taken, fresh, again, members(read("lists"), SPAM_LIST), now).join(daily.split(fresh).select("canonical_id", part), "canonical_id")
        held = read("warnings", days).where(F.col(part).isin(days))
        rows = state.warnings_upsert(held.drop(part).withColumn("seq", F.lit(0)), found.drop(part))
        where = held.select("canonical_id", part).union(found.select("canonical_id", part)).distinct()
        writes["warnings"] = commits.Write(rows.join(where, "canonical_id"), days if "warnings" in base.tables else None)
        kept = known.where(F.col("created_at") >= now - WINDOW).join(fresh.select("canonical_id"), "canonical_id", "left_anti")
        writes[TEXTS] = commits.Write(kept.select(*text_keys(fresh).columns).unionByName(text_keys(fresh)), authors if TEXTS in base.tables else None, alone=True)
    return writes | news


def labels_of(events: DataFrame, posts: DataFrame, repeated: DataFrame, spammers: DataFrame, now: int) -> DataFrame:
    """``warnings_of`` where the posts whose texts are repeated are known already."""
    return _labels(events, posts, _reasons(posts, repeated), spammers, now)


def collect(spark: SparkSession, folder: str, state_folder: str, checkpoint: str, now: int, blocked=(), curated=(), filters: list[dict] | None = None) -> None:
    """Replay recorded events (JSON lines) as a stream into the tables under ``state_folder``; a micro-batch is a commit, and so is what its clock lets go."""
    base, tables = opened(spark, state_folder)
    if "posts" not in base.tables or not base.tables["posts"]["split"]:
        commits.publish(base, whole(tables))

    def step(batch: DataFrame, number: int) -> None:
        events = judged(parsed(batch), now, blocked, curated, filters).persist()
        try:
            commits.commit(spark, state_folder, lambda base: planned(base, events, now, blocked))
        finally:
            events.unpersist()
        maintain(spark, state_folder, now, blocked)

    stream = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).text(folder)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def maintain(spark: SparkSession, folder: str, now: int, blocked=()) -> None:
    """What time and the block list take from a store: days outside the window, and listed authors' and ids' posts; old commits are swept."""
    barred = entries(spark, blocked)
    by_author, by_id = barred.withColumnRenamed("entry", "author_id"), barred.select(F.concat(F.lit("nostr:"), "entry").alias("canonical_id"))
    for plan in (lambda base: daily.expired(base, now), lambda base: daily.purged(base, by_author, by_id)):
        if plan(commits.snapshot(spark, folder)):
            commits.commit(spark, folder, plan)
    commits.sweep(spark, folder)


def files_of(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """A parquet stream over a folder, or over one file by its name in its folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def stream_latest(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], time: str, tie: str, state_folder: str, files: int = 1) -> DataFrame:
    """Latest-wins state of a parquet stream, one file a batch, kept as published snapshots; runs the stream and returns the last one."""

    def step(batch: DataFrame, number: int) -> None:
        base = commits.snapshot(spark, f"{state_folder}/latest")
        rows = base.read("rows").unionByName(batch) if base.number else batch
        state.publish(state.latest(rows, keys, time, tie), f"{state_folder}/latest", base)

    stream = files_of(spark, folder, schema, files)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state_folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.current(spark, f"{state_folder}/latest")


def stream_dedup(spark: SparkSession, folder: str, schema: T.StructType, key: str, time: str, delay: str, state_folder: str) -> DataFrame:
    """First sighting of each key within a watermark, written to parquet; runs the stream."""
    stream = files_of(spark, folder, schema).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    stream.dropDuplicatesWithinWatermark([key]).writeStream.format("parquet").option("path", f"{state_folder}/out").option(
        "checkpointLocation", f"{state_folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([f if f.name != time else T.StructField(time, T.TimestampType()) for f in schema.fields])).parquet(f"{state_folder}/out")
