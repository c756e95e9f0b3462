"""Upserts, source precedence and pruning over snapshots, without MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; one shuffle, combined before it."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__last"))
    return last.select(*keys, *(F.col("__last")[c].alias(c) for c in rest)).select(*df.columns)


def with_precedence(df: DataFrame, keys: list[str], preferred: Column, order: list[Column]) -> DataFrame:
    """The last row of each key among the preferred ones, or of all if none is."""
    return latest_by_key(df, keys, [preferred.cast("int"), *order])


def without_orphans(rows: DataFrame, references: DataFrame, on: str) -> DataFrame:
    return rows.join(references.select(on).distinct(), on, "left_semi")


def held_by(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The ids that some of the sources list; both have source_file_id."""
    return links.join(sources.select("source_file_id"), "source_file_id", "left_semi").select("email_id").distinct()


def not_current(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files (path, sha256) but for those imported with the same content."""
    return files.join(sources.where("status = 'imported'").select("path", "sha256"), ["path", "sha256"], "left_anti")


def merge_source(messages: DataFrame, links: DataFrame, incoming: DataFrame, source: int, is_json: bool, json_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One source's records merged into the snapshot: the new messages and the new links.

    incoming: the message columns and source_index, the last row of an id counts. A CSV record never
    replaces a message that some JSON source has. Ids that the source no longer lists lose their link;
    messages without a link go.
    """
    incoming = latest_by_key(incoming, ["email_id"], [F.col("source_index")])
    fresh = incoming.drop("source_index")
    if not is_json:
        keep = messages.select("email_id").join(held_by(links, json_sources), "email_id", "left_semi")
        fresh = fresh.join(keep, "email_id", "left_anti")
    merged = messages.join(fresh.select("email_id"), "email_id", "left_anti").unionByName(fresh)
    own = incoming.select("email_id", F.lit(source).cast("long").alias("source_file_id"), "source_index")
    linked = links.where(F.col("source_file_id") != source).unionByName(own)
    return without_orphans(merged, linked, "email_id"), linked
