"""Incremental ingestion of export files into the store."""

from __future__ import annotations

import itertools
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.operators.merge import held_by, latest_by_key, merge_source, not_current, with_precedence
from mailloom.sources.readers import discover, parse_files, read_files
from mailloom.sources.records import MESSAGE_SCHEMA, kind_of
from mailloom.sources.store import SCHEMAS, Store, now

#: so many files' numbers are sent to every executor at most; more are joined by a shuffle
BROADCAST_FILES = 100_000

_COLUMNS = [c.strip().split(" ")[0] for c in MESSAGE_SCHEMA.split(",")]


def _merged_at_once(messages: DataFrame, links: DataFrame, records: DataFrame, json_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sources in one pass: exact when none of them was imported before, so nothing can go stale."""
    held = held_by(links, json_sources).withColumn("is_json", F.lit(True))
    old = messages.join(held, "email_id", "left").withColumn("is_json", F.coalesce("is_json", F.lit(False))).withColumn("source_file_id", F.lit(-1).cast("long")).withColumn("source_index", F.lit(-1).cast("long"))
    every = old.unionByName(records.select(*old.columns))
    merged = with_precedence(every, ["email_id"], F.col("is_json"), [F.col("source_file_id"), F.col("source_index")])
    own = records.groupBy("email_id", "source_file_id").agg(F.max("source_index").alias("source_index"))
    return merged.select(*_COLUMNS), links.unionByName(own)


def ingest(store: Store, paths: list[str], force: bool = False, strict_csv: bool = False) -> dict[str, Any]:
    """Import new and changed files; the summary counts records, also repeated ones."""
    spark = store.spark
    store.init()
    found = discover(spark, paths)
    staging = f"staging/{uuid.uuid4().hex}"
    staged_at = f"{store.root}/{staging}"
    files = read_files(spark, found, f"{staged_at}/hidden")
    known = store.table("sources")
    digest = files.select("path", "size_bytes", "modified_at", "sha256")
    if not force:
        digest = not_current(digest, known)
    pending = digest.orderBy("path").collect()  # file names and hashes, no content
    summary: dict[str, Any] = {"files_total": len(found), "files_imported": 0, "files_skipped": len(found) - len(pending), "files_failed": 0, "messages_imported": 0, "errors": []}
    if not pending:
        store.remove(staging)
        return summary
    ids = {r["path"]: r["source_file_id"] for r in known.select("path", "source_file_id").collect()}
    seen = set(ids)
    fresh_ids = itertools.count(max(ids.values(), default=0) + 1)
    for r in pending:
        if r["path"] not in seen:
            ids[r["path"]] = next(fresh_ids)
    # until the import is committed these sources are not current, so that one cut short is taken again
    begun = [(ids[r["path"]], r["path"], r["sha256"], kind_of(r["path"]), r["size_bytes"], r["modified_at"], "importing", 0, None, None) for r in pending]
    begun = spark.createDataFrame(begun, SCHEMAS["sources"])
    store.commit(sources=known.join(begun.select("path"), "path", "left_anti").unionByName(begun))
    numbered = spark.createDataFrame([(r["path"], ids[r["path"]], kind_of(r["path"]) == "json", r["sha256"]) for r in pending], "path string, source_file_id long, is_json boolean, expected string")
    if len(pending) <= BROADCAST_FILES:
        numbered = F.broadcast(numbered)
    content = read_files(spark, [r["path"] for r in pending], f"{staged_at}/hidden").join(numbered.select("path", "expected"), "path")
    parse_files(content, strict_csv).join(numbered.drop("expected"), "path").write.parquet(f"{staged_at}/records")
    staged = spark.read.parquet(f"{staged_at}/records")
    counts = {r["path"]: r for r in staged.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("error")).collect()}
    good = [r for r in pending if counts.get(r["path"]) is None or counts[r["path"]]["error"] is None]
    records = staged.where("error is null")
    messages, links = store.table("messages"), store.table("links")
    rows = []
    for r in pending:
        c = counts.get(r["path"])
        error = c["error"] if c else None
        n = int(c["n"]) if c and not error else 0
        rows.append((ids[r["path"]], r["path"], r["sha256"], kind_of(r["path"]), r["size_bytes"], r["modified_at"], "failed" if error else "imported", n, error, None if error else now()))
        summary["messages_imported"] += n
        summary["files_failed" if error else "files_imported"] += 1
        if error:
            summary["errors"].append({"path": r["path"], "error": error})
    fresh = spark.createDataFrame(rows, SCHEMAS["sources"])
    sources = known.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)
    json_ids = known.where("kind = 'json'").select("source_file_id")
    json_ids = json_ids.unionByName(fresh.where("kind = 'json'").select("source_file_id")).distinct()
    if not any(r["path"] in seen for r in good):
        merged, linked = _merged_at_once(messages, links, records, json_ids)
    else:
        merged, linked = _folded(store, staged_at, messages, links, records, json_ids, [(ids[r["path"]], kind_of(r["path"]) == "json", r["path"] in seen) for r in good])
    store.commit(messages=merged, links=linked, sources=sources)
    store.remove(staging)
    return summary


def _folded(store: Store, scratch: str, messages: DataFrame, links: DataFrame, records: DataFrame, json_ids: DataFrame, files: list[tuple[int, bool, bool]]) -> tuple[DataFrame, DataFrame]:
    """A source seen before may drop messages, and what they leave depends on the order of imports.

    files: source id, is JSON, was seen before, in order. Only messages that these sources hold or held
    pass through the steps, and a run of new sources is one step; all others are copied once, at the end.
    """
    spark, n = store.spark, itertools.count()

    def kept(df: DataFrame) -> DataFrame:
        path = f"{scratch}/fold/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    own = spark.createDataFrame([(i,) for i, _, _ in files], "source_file_id long")
    listed = records.select("email_id", "source_file_id").join(own, "source_file_id", "left_semi")
    touched = kept(listed.select("email_id").unionByName(links.join(own, "source_file_id", "left_semi").select("email_id")).distinct())
    some, linked = kept(messages.join(touched, "email_id", "left_semi")), kept(links.join(touched, "email_id", "left_semi"))
    for old, run in itertools.groupby(files, key=lambda f: f[2]):
        steps = [[f] for f in run] if old else [list(run)]
        for step in steps:
            # ids of one run of new sources are consecutive
            incoming = records.where(F.col("source_file_id").between(step[0][0], step[-1][0]))
            if old:
                some, linked = merge_source(some, linked, incoming.select(*_COLUMNS, "source_index"), step[0][0], step[0][1], json_ids)
            else:
                some, linked = _merged_at_once(some, linked, incoming, json_ids)
            some, linked = kept(some.select(*messages.columns)), kept(linked.select(*links.columns))
    return messages.join(touched, "email_id", "left_anti").unionByName(some), links.join(touched, "email_id", "left_anti").unionByName(linked)


def registry_latest(events: DataFrame) -> DataFrame:
    """The current registry from an append-only log of source events."""
    return latest_by_key(events, ["path"], [F.col("imported_at")])
