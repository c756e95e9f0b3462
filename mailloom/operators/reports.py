"""Counts of the store and quality of the analyses, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = ("verified", "verified_with_gaps")


def store_stats(messages: DataFrame, sources: DataFrame, analyses: DataFrame) -> DataFrame:
    m = messages.agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("threads"))
    s = sources.agg(F.count_if(F.col("status") == "imported").alias("sources"))
    a = analyses.agg(F.count_if(F.col("status").isin(*DONE)).alias("verified_threads"))
    one = lambda d: d.withColumn("__k", F.lit(1))
    return one(m).join(one(s), "__k").join(one(a), "__k").drop("__k")


def quality_report(analyses: DataFrame, runs: DataFrame) -> DataFrame:
    """analyses: status, importance_score, factual_confidence, verified_json. runs: status."""
    def number(path: str) -> F.Column:
        return F.coalesce(F.get_json_object("verified_json", path).try_cast("bigint"), F.lit(0))

    a = analyses.select("status", "importance_score", "factual_confidence", number("$.validation.evidence_claims_checked").alias("checked"), number("$.validation.evidence_claims_valid").alias("valid"))
    per = a.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("importance_score") >= 80).alias("high"), F.sum("checked").alias("checked"), F.sum("valid").alias("valid"), F.sum("factual_confidence").alias("sure"), F.count("factual_confidence").alias("known"))
    total = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("analyzed_threads"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_importance_threads"),
        F.coalesce(F.sum("checked"), F.lit(0)).alias("evidence_claims_checked"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("evidence_claims_valid"),
        F.round(F.try_divide(F.sum("valid"), F.sum("checked")), 4).alias("evidence_pass_rate"),
        F.round(F.try_divide(F.sum("sure"), F.sum("known")), 4).alias("average_verifier_confidence"),
    )
    failed = runs.agg(F.count_if(F.col("status") == "failed").alias("failed_agent_runs"))
    return total.withColumn("__k", F.lit(1)).join(failed.withColumn("__k", F.lit(1)), "__k").drop("__k")


def packing_summary(batched: DataFrame, size: str) -> DataFrame:
    """batched: batch (null: over the limit) and size."""
    n = F.coalesce(F.max("batch") + 1, F.lit(0)).cast("long")
    return batched.agg(
        F.count("*").alias("threads_considered"), n.alias("batches"), (n * 2).alias("estimated_runs"), F.count_if(F.col("batch").isNull()).alias("oversized"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_characters"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest_thread_characters"),
    )
