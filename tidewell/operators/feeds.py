"""The four feeds: new, relevance, conversations and social; each is one lazy plan that ends in a top-k."""

from __future__ import annotations

import re
from collections.abc import Mapping
from contextlib import suppress
from dataclasses import dataclass
from datetime import date
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, intervals, search, tree
from .postings import Postings
from .window import DAY, PAGE, eligible, lookup, page, upper

MODES = ("new", "relevance", "conversations", "discovery")


def ranked(bm25: Column) -> Column:
    """Order key that forgives the last bits of a logarithm."""
    return F.round(bm25, 12)


def new(posts: DataFrame, now: int, number: int = 0, before: int | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Newest first, then by id; ``matches`` only filters."""
    rows = eligible(posts, now, before)
    if matches is not None:
        rows = rows.join(matches, "canonical_id", "left_semi")
    return page(rows, [F.desc("created_at"), F.asc("canonical_id")], number)


def new_after(posts: DataFrame, now: int, created_at: int, canonical_id: str, before: int | None = None, matches: DataFrame | None = None) -> DataFrame:
    """The page of ``new`` that follows a row, by its key: what is before it is neither sorted nor counted, and posts that have come since shift nothing."""
    later = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("canonical_id") > canonical_id))
    return new(posts.where(F.col("created_at") <= created_at).where(later), now, 0, before, matches)


def relevance(posts: DataFrame, matches: DataFrame, now: int, number: int = 0, before: int | None = None) -> DataFrame:
    """Best score first (lowest), then newest, then by id."""
    rows = eligible(posts, now, before).join(matches, "canonical_id")
    return page(rows, [ranked(F.col("bm25")).asc(), F.desc("created_at"), F.asc("canonical_id")], number)


def threads(posts: DataFrame, now: int, before: int | None = None, matches: DataFrame | None = None) -> DataFrame:
    """One card a thread: (root_id, card_id, card_bm25, root_present, n_reply_authors, n_replies, latest_activity).

    A thread is what shares a root id, or the post itself.  The card is the newest member, or with
    ``matches`` the best match; threads without a match go, all members of the others count.  Reply
    authors are distinct (source, author) pairs of the last day before the upper end, without the
    root post and, where the root is present, its author.
    """
    end = upper(now, before)
    rows = eligible(posts, now, before).select(
        "canonical_id", "source", "author_id", "created_at", F.coalesce(F.nullif("root_id", F.lit("")), "canonical_id").alias("thread")
    )
    if matches is not None:
        rows = rows.join(matches.select("canonical_id", "bm25"), "canonical_id", "left")
        card = F.min_by(F.struct("canonical_id", "source", "bm25"), F.when(F.col("bm25").isNotNull(), F.struct(ranked(F.col("bm25")), "canonical_id")))
    else:
        rows = rows.withColumn("bm25", F.lit(None).cast("double"))
        card = F.max_by(F.struct("canonical_id", "source", "bm25"), F.struct("created_at", "canonical_id"))
    is_root = F.col("canonical_id") == F.col("thread")
    replied = (F.col("created_at") >= end - DAY) & ~is_root
    cards = rows.groupBy("thread").agg(
        card.alias("card"), F.bool_or(is_root).alias("root_present"), F.max(F.when(is_root, F.col("author_id"))).alias("root_author"),
        F.count(F.lit(1)).alias("members"), F.max("created_at").alias("latest_activity"),
    )
    if matches is not None:
        cards = cards.where(F.col("card.bm25").isNotNull())
    # Distinct first, so that nobody holds all repliers of one thread.
    repliers = rows.where(replied).select("thread", "source", "author_id").distinct()
    own = (F.col("source") == F.col("card.source")) & F.coalesce(F.col("author_id") == F.col("root_author"), F.lit(False))
    counts = repliers.join(cards.select("thread", "card", "root_author"), "thread").where(~own).groupBy("thread").agg(F.count(F.lit(1)).alias("n"))
    return cards.join(counts, "thread", "left").select(
        F.col("thread").alias("root_id"), F.col("card.canonical_id").alias("card_id"), F.col("card.bm25").alias("card_bm25"), "root_present",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_reply_authors"), (F.col("members") - F.col("root_present").cast("int")).alias("n_replies"), "latest_activity",
    )


def conversations(posts: DataFrame, now: int, number: int = 0, before: int | None = None, matches: DataFrame | None = None) -> DataFrame:
    return page(threads(posts, now, before, matches), [F.desc("n_reply_authors"), F.desc("latest_activity"), F.asc("root_id")], number)


def social(
    posts: DataFrame, follows: DataFrame, hubs: DataFrame, root: int, now: int, number: int = 0, before: int | None = None,
    order: str = "recent", reach: int = 2, matches: DataFrame | None = None,
) -> DataFrame:
    """Posts of authors within ``reach`` hops, newest first or by connection weight."""
    near = graph.reach(follows, hubs, root).where(F.col("hops") <= reach)
    rows = eligible(posts, now, before).join(near, "author_id")
    if matches is not None:
        rows = rows.join(matches, "canonical_id")
    newest = [F.desc("created_at"), F.asc("canonical_id")]
    return page(rows, [F.desc("weight"), *newest] if order == "connections" else newest, number)


def has_next(rows: DataFrame, order: list[Column], number: int) -> bool:
    """Whether a page follows the given one: one row more is counted, so a full last page has none after it.

    How many rows there are doesn't depend on their order, so none is sorted and only a number reaches the driver.
    """
    least = (number + 1) * PAGE + 1
    return rows.select(F.lit(1)).limit(least).count() == least


def page_full(pages: DataFrame) -> DataFrame:
    """(page, has_next) by a full page, for rows (page, n): what readers of fixed pages see, also after a full last one."""
    return pages.select("page", (F.col("n") == PAGE).alias("has_next"))


def match_label(bm25: Column) -> Column:
    return F.format_string("match %.1f", bm25)


def score_label(mode: str, searched: bool) -> Column:
    """The score that a card shows: nothing on new ones, the match, repliers of the day, or hops and connection."""
    match = F.concat(F.lit(" · "), match_label(F.col("bm25"))) if searched else F.lit("")
    if mode == "relevance":
        return F.concat(match_label(F.col("bm25")), F.lit(" (lower=closer)"))
    if mode == "conversations":
        return F.concat(F.col("n_reply_authors").cast("string"), F.lit(" repliers (24h)"), match)
    if mode == "discovery":
        near = F.when(F.col("hops") == 1, "1 hop · you follow").otherwise(F.format_string("%d hops · connection %.2f", "hops", "graph_score"))
        return F.concat(near, match)
    return F.lit("")


_INTEGER, _DATE = re.compile(r"\s*[+-]?\d{1,18}\s*"), re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})")


def _number(args: Mapping[str, str], name: str, default: int) -> int:
    """An integer argument, at least 0; anything else is the default."""
    text = args.get(name, "")
    return max(0, int(text)) if _INTEGER.fullmatch(text) else default


def _midnight(day: str) -> int:
    """Seconds of a YYYY-MM-DD day's start in UTC, 0 if there is no such day."""
    parts = _DATE.fullmatch(day)
    with suppress(ValueError):
        return (date(*map(int, parts.groups())) - date(1970, 1, 1)).days * DAY if parts else 0
    return 0


@dataclass(frozen=True)
class Request:
    """A feed request after defaults: unknown modes, orders and reaches fall back; reach and order matter in discovery only."""

    mode: str = "conversations"
    query: str = ""
    page: int = 0
    before: int | None = None
    order: str = "recent"
    reach: int = 2

    @classmethod
    def parse(cls, args: Mapping[str, str], now: int) -> Request:
        """``go`` (the search was submitted) makes a query a relevance search; ``date`` stands for ``before`` where that is missing."""
        query = args.get("q", "").strip()
        own = "discovery" if args.get("mode") == "social" else args.get("mode", "")
        wanted = ("relevance" if "go" in args else "", own, "relevance", "conversations")
        mode = next(m for m in wanted if m in MODES and (query or m != "relevance"))
        before = _number(args, "before", 0) or _midnight(args.get("date", ""))
        order = "connections" if args.get("order") == "connections" else "recent"
        reach = next((r for r in (1, 3) if _number(args, "reach", 2) == r), 2)
        return cls(mode, query, _number(args, "page", 0), before if 0 < before < now else None, order, reach)

    def query_string(self) -> str:
        """The canonical form of the request, as links carry it: without the page, and without what is empty."""
        names = ("q", "mode", "before", *(("reach", "order") if self.mode == "discovery" else ()))
        values = [self.query if n == "q" else getattr(self, n) for n in names]
        return "&".join(f"{n}={quote_plus(str(v))}" for n, v in zip(names, values) if v)


def feed(posts: DataFrame, follows: DataFrame, hubs: DataFrame, root: int, request: Request, now: int, index: Postings | None = None) -> DataFrame:
    """The page that a request asks for; searches read ``index`` if there is one, else all texts."""
    matches = None
    if request.query:
        clauses = search.parse(request.query)
        if index and request.mode == "relevance":
            matches = index.top(clauses, (request.page + 1) * PAGE, eligible(posts, now, request.before))
        else:
            matches = index.match(clauses) if index else search.match(posts, clauses)
    if request.mode == "new":
        return new(posts, now, request.page, request.before, matches)
    if request.mode == "relevance":
        return relevance(posts, matches, now, request.page, request.before)
    if request.mode == "conversations":
        return conversations(posts, now, request.page, request.before, matches)
    return social(posts, follows, hubs, root, now, request.page, request.before, request.order, request.reach, matches)


def context(posts: DataFrame, canonical_id: str, now: int, threads: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ancestors from the top with distance, the post, replies in pre-order with depth) of one eligible post.

    ``threads``: intervals of the eligible posts (``intervals.tour``), by which any depth is one range join; without them the tree is
    walked level by level, some thousand levels at most.
    """
    rows = eligible(posts, now)
    if threads is None:
        above, below = tree.walk_up(rows, canonical_id).where("distance > 0"), tree.preorder(posts, canonical_id, now)
    else:
        above, below = intervals.ancestors(threads, canonical_id).where("distance > 0"), intervals.replies(threads, canonical_id)
    chain = rows.join(above.select("canonical_id", "distance"), "canonical_id").orderBy(F.desc("distance"))
    return chain, lookup(posts, canonical_id, now), rows.join(below, "canonical_id").orderBy("position")


__all__ = ["MODES", "PAGE", "Request", "context", "conversations", "feed", "has_next", "new", "new_after", "page_full", "ranked", "relevance", "score_label", "social", "threads"]
