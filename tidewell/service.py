"""Requests against the stored tables: feeds, a post's context, status. Answers are JSON; the pages around them are the reader's.

``respond`` is the service; ``serve`` puts it behind the standard library's HTTP server, one request at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, enrich, feeds, intervals, search, tree
from .operators.postings import Postings
from .operators.window import PAGE, eligible
from .streaming import ingest

Answer = tuple[int, dict]


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


def feed(tables: dict[str, DataFrame], root: str, args: Mapping[str, str], now: int, index: Postings | None = None) -> Answer:
    request = feeds.Request.parse(args, now)
    hubs = tables["metadata"].where("kind = 3").select("pubkey")
    head = {"mode": request.mode, "page": request.page, "link": request.query_string(), "before": request.before}
    try:
        rows = feeds.feed(tables["posts"], tables["follows"], hubs, root, request, now, index)
    except search.QueryError as fault:
        return 200, head | {"error": str(fault), "results": [], "has_next": False}
    key = "card_id" if request.mode == "conversations" else "canonical_id"
    scored = _rows(rows.withColumn("score", feeds.score_label(request.mode, bool(request.query))))
    ids = rows.sparkSession.createDataFrame([(r[key],) for r in scored], "canonical_id string")
    shown = enrich.views(tables["posts"].join(F.broadcast(ids), "canonical_id", "left_semi"), tables["posts"], tables["warnings"], tables["metadata"], now)  # a page
    views = {r["canonical_id"]: r for r in _rows(shown)}
    thread = ("n_reply_authors", "n_replies", "latest_activity", "root_present", "root_id")
    results = [views[r[key]] | {"score": r["score"]} | ({k: r[k] for k in thread} if request.mode == "conversations" else {}) for r in scored]
    return 200, head | {"results": results, "has_next": len(results) == PAGE}


def context(tables: dict[str, DataFrame], args: Mapping[str, str], now: int) -> Answer:
    """A post with its ancestors and replies, and how the walk up ended."""
    wanted = args.get("id", "")
    if not feeds.lookup(tables["posts"], wanted, now).take(1):
        return 404, {"error": "no such post"}
    rows = eligible(tables["posts"], now)
    try:
        above, post, below = map(_rows, feeds.context(tables["posts"], wanted, now))
        ends = _rows(tree.walk_up(rows, wanted).where("missing_parent_id is not null or cycle_cut").select("missing_parent_id", "cycle_cut"))
    except PySparkException as fault:
        if "RECURSION" not in str(fault):
            raise
        threads = intervals.tour(rows)  # a thread deeper than a recursion may be
        above, post, below = map(_rows, feeds.context(tables["posts"], wanted, now, threads))
        ends = _rows(intervals.ancestors(threads, wanted).where("missing_parent_id is not null").select("missing_parent_id", F.lit(False).alias("cycle_cut")))
    return 200, {"post": post[0], "ancestors": above, "replies": below, "ends": ends}


def status(tables: dict[str, DataFrame], now: int) -> Answer:
    counts = {r["source"]: r["n"] for r in _rows(aggregates.source_counts(tables["posts"], now))}
    sources = [r | {"detail": json.loads(r["detail"]), "posts": counts.get(r["source"], 0)} for r in _rows(tables["status"].orderBy("source"))]
    return 200, {"sources": sources}


def respond(spark: SparkSession, folder: str, root: str, target: str, now: int, index: Postings | None = None) -> Answer:
    """(status, body) of a request's target, such as ``/?mode=new``; /search leads to the feed of the same arguments."""
    path, query = urlsplit(target).path, urlsplit(target).query
    if path == "/search":
        return 301, {"location": "/?" + query}
    args, tables = dict(parse_qsl(query, keep_blank_values=True)), ingest.stored(spark, folder)
    if path == "/":
        return feed(tables, root, args, now, index)
    if path == "/context":
        return context(tables, args, now)
    return status(tables, now) if path == "/status" else (404, {"error": "no such page"})


def serve(spark: SparkSession, folder: str, root: str, host: str = "127.0.0.1", port: int = 8081, clock: Callable[[], float] = time.time) -> HTTPServer:
    """A server for ``respond``; the caller runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, body = respond(spark, folder, root, self.path, int(clock()))
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            if code == 301:
                self.send_header("Location", body["location"])
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return HTTPServer((host, port), Handler)
