"""Command line: init, ingest, stats, report, analyze, models. Results are JSON; errors end with 1."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mailloom", description=__doc__)
    p.add_argument("--store", default="mailstore")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    i = sub.add_parser("ingest")
    i.add_argument("paths", nargs="+")
    i.add_argument("--force", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("report")
    a = sub.add_parser("analyze")
    a.add_argument("--owner-email", required=True)
    a.add_argument("--model", default="offline")
    a.add_argument("--verifier-model")
    a.add_argument("--limit", type=int)
    a.add_argument("--max-threads-per-batch", type=int, default=8)
    a.add_argument("--max-chars-per-batch", type=int, default=80_000)
    a.add_argument("--force", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--retries", type=int, default=3)
    for command in (a, sub.add_parser("models")):
        command.add_argument("--provider", help="module:name of a callable Request -> Reply, or of a class of one; models() lists its models")
    return p


def _provider(name: str):
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "provider")
    return found() if isinstance(found, type) else found


def _run(args: argparse.Namespace, spark: SparkSession, provider) -> object:
    from mailloom.operators import reports
    from mailloom.plans import analyze, ingest
    from mailloom.sources.store import Store

    if getattr(args, "provider", None):
        provider = _provider(args.provider)
    if args.command == "models":
        if provider is None:
            raise ValueError("no provider is configured")
        return provider.models()
    store = Store(spark, args.store).init()
    if args.command == "init":
        return {"store": store.root, "status": "ready"}
    if args.command == "ingest":
        return ingest.ingest(store, args.paths, args.force)
    if args.command == "stats":
        return reports.store_stats(store.table("messages"), store.table("sources"), store.analyses()).first().asDict()
    if args.command == "report":
        return reports.quality_report(store.analyses(), store.table("runs")).first().asDict()
    return analyze.analyze(store, args.owner_email, args.model, args.verifier_model, provider, args.limit, args.max_threads_per_batch, args.max_chars_per_batch, args.force, args.dry_run, args.retries)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None, write: Callable[[str], object] = print) -> int:
    args = _parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("mailloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        write(json.dumps(_run(args, spark, provider), ensure_ascii=False, indent=2, default=str))
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
