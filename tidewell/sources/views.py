"""Post, follow, profile and warning views over the driver's parquet tables, in SQL that Spark and DuckDB share.

``{documents}``, ``{events}`` and ``{labels}`` stand for the tables: DataFrames in Spark, names in DuckDB.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: The views' fixed clock, 2024-01-31 00:00:00 UTC; operators take it as a parameter and never ask the machine.
NOW = 1706659200
DAY = 86400

POSTS = """select concat('doc:', cast(doc_id as varchar(20))) as canonical_id, source, cast(doc_id as varchar(20)) as source_id,
 cast(doc_id % (select max(user_id) + 1 from {events}) as bigint) as author_id, text,
 cast(1706659200 - (doc_id * 7919) % 2764800 as bigint) as created_at,
 case when doc_id % 10 = 0 then null
      else concat('doc:', cast(doc_id - doc_id % 10 + cast(floor((doc_id % 10 - 1) / 2.0) as bigint) as varchar(20))) end as parent_id,
 case when doc_id % 10 = 0 then null else concat('doc:', cast(doc_id - doc_id % 10 as varchar(20))) end as root_id
 from {documents}"""
FOLLOWS = """select distinct user_id as follower,
 cast((user_id * 31 + event_id * 17 + 7) % (select max(user_id) + 1 from {events}) as bigint) as followee
 from {events} where event_id % 10 = 0"""
PROFILES = "select distinct user_id as pubkey, 0 as kind from {events} where user_id % 3 <> 0"
HUBS = "select distinct follower as pubkey from (" + FOLLOWS + ") as f where follower % 5 <> 0"
WARNINGS = """select concat('doc:', cast(doc_id as varchar(20))) as canonical_id, 'author-cw' as category, 'author: unspecified' as reason from {labels} where toxic = 1
 union all
 select concat('doc:', cast(doc_id as varchar(20))), 'spam', 'auto-flagged: spam duplicate-content' from {labels} where quality = 0"""
#: Advertised relays of every user, one to three each.
RELAYS = """select distinct user_id as author_id, concat('wss://relay', cast((user_id * 7 + event_id % 3) % 13 as varchar(20)), '.example') as relay
 from {events}"""

VIEWS = {"posts": POSTS, "follows": FOLLOWS, "profiles": PROFILES, "hubs": HUBS, "warnings": WARNINGS, "relays": RELAYS}
TABLES = ("documents", "events", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame; only the tables it names are read."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


@lru_cache(maxsize=1)
def ctes() -> str:
    """The views as the start of a DuckDB WITH clause."""
    return "with recursive " + ", ".join(f"{k} as ({v.format(**{t: t for t in TABLES})})" for k, v in VIEWS.items())
