"""Jobs: ``serve`` answers requests, ``collect`` makes collection passes, ``embed`` brings vectors up to date, ``verify`` checks them."""

from __future__ import annotations

import argparse
import importlib
import json
import re

from pyspark.sql import SparkSession

from . import service
from .operators import commits, state, vectors
from .sources import files
from .streaming import collection, ingest

KEY = re.compile(r"[0-9a-f]{64}")


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    jobs = own.add_subparsers(dest="job", required=True)
    for name in ("serve", "collect", "embed", "verify"):
        job = jobs.add_parser(name)
        job.add_argument("--state", required=True, help="folder of the stored tables")
        if name in ("serve", "collect"):
            job.add_argument("--root", required=True, help="public key whose follows the feeds start from")
        if name in ("embed", "verify"):
            job.add_argument("--vectors", required=True, help="folder of the vectors' generations")
    jobs.choices["serve"].add_argument("--host", default="127.0.0.1")
    jobs.choices["serve"].add_argument("--port", type=int, default=8081)
    collect = jobs.choices["collect"]
    collect.add_argument("--relays", required=True, help="comma separated")
    collect.add_argument("--folder", default="", help="recorded frames, for the default transport")
    collect.add_argument("--transport", default="tidewell.sources.relay:Recorded", help="module:attribute")
    collect.add_argument("--list-author")
    collect.add_argument("--blocklist", help="file of keys and event ids")
    collect.add_argument("--requests", type=int, default=40)
    collect.add_argument("--loop", action="store_true")
    collect.add_argument("--interval", type=int, default=900)
    jobs.choices["embed"].add_argument("--embedder", required=True, help="module:attribute, a function from posts to (canonical_id, embedding)")
    jobs.choices["embed"].add_argument("--now", type=int, required=True)
    return own


def checked(args: argparse.Namespace, own: argparse.ArgumentParser) -> argparse.Namespace:
    if args.job in ("serve", "collect") and not KEY.fullmatch(args.root):
        own.error("--root is not a public key of 64 lower-case hexadecimal digits")
    if args.job == "collect" and (args.interval < 60 or args.requests < 1):
        own.error("--interval is at least 60 seconds, --requests at least 1")
    return args


def named(reference: str):
    module, _, name = reference.partition(":")
    return getattr(importlib.import_module(module), name)


def embed(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The next generation of vectors for the posts in the window; texts that haven't changed keep theirs."""
    base = commits.snapshot(spark, args.vectors)
    old = base.read("rows") if base.number else None
    fresh = vectors.refresh(old, vectors.corpus(ingest.stored(spark, args.state)["posts"], args.now), named(args.embedder))
    state.publish(fresh, args.vectors, base)
    return verify(spark, args)


def verify(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Checks of the current generation: counts, ids, dimensions, norms."""
    last = commits.snapshot(spark, args.vectors)
    if not last.number:
        raise FileNotFoundError(f"no generation in {args.vectors}")
    rows = files.checked(last.read("rows"))
    from pyspark.sql import functions as F

    return vectors.norms(rows.withColumn("all", F.lit(True)), "all").drop("all").first().asDict() if rows.take(1) else {"n": 0}


def main(argv: list[str] | None = None) -> None:
    own = parser()
    args = checked(own.parse_args(argv), own)
    spark = SparkSession.builder.appName(f"tidewell {args.job}").getOrCreate()
    if args.job == "serve":
        service.serve(spark, args.state, args.root, args.host, args.port).serve_forever()
    elif args.job == "collect":
        settings = collection.Settings(args.root, args.relays.split(","), {"folder": args.folder, "transport": args.transport}, args.list_author, args.requests)
        blocked = (lambda: files.blocklist(spark, args.blocklist)) if args.blocklist else tuple
        for report in collection.run(spark, args.state, settings, passes=None if args.loop else 1, every=args.interval, blocked=blocked):
            print(json.dumps(report, ensure_ascii=False))
    else:
        print(json.dumps((embed if args.job == "embed" else verify)(spark, args), ensure_ascii=False))


if __name__ == "__main__":
    main()
