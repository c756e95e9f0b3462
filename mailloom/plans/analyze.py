"""Analysis of threads: rank, build, skip, batch, call, validate, classify, save."""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mailloom.operators import prompts, provider, validate
from mailloom.operators.batches import batch_identity, greedy_batches
from mailloom.operators.reports import DONE, packing_summary
from mailloom.operators.threads import DOCUMENT, rank_threads, thread_documents
from mailloom.sources.store import LOGS, Store, now

#: bytes of a row group of the batches' documents
MEMBER_BYTES = 4 << 20
#: batches that are read, and whose answers are validated and saved, together: so many, or characters of documents, at most
VALIDATED, VALIDATED_CHARS = 128, 8 << 20


def document_size(document: Column) -> Column:
    """Code points of the document as JSON with spaced separators, as the limit counts them."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(json.dumps(json.loads(t), ensure_ascii=False))).astype("int64")

    return size(F.to_json(document, {"ignoreNullFields": "false"}))


def candidates(store: Store, owner: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """Documents to analyse with their place in the ranking; the limit counts threads before the skip."""
    messages, done = store.table("messages"), store.analyses()
    ranking = rank_threads(messages, done, owner, limit)
    keys = ranking.select("thread_id", F.struct("analysed", (-F.col("owner_sent")).alias("a"), (-F.col("owner_addressed")).alias("b"), (-F.col("message_count")).alias("c"), (-F.col("any_attachment")).alias("d")).alias("place"), "latest")
    chosen = messages.join(keys.select(F.col("thread_id").alias("conversation_id")), "conversation_id", "left_semi") if limit is not None and limit >= 0 else messages
    docs = thread_documents(chosen, owner).join(keys, "thread_id")
    if not force:
        current = done.where(F.col("status").isin(*DONE)).select("thread_id", "source_fingerprint")
        docs = docs.join(current, ["thread_id", "source_fingerprint"], "left_anti")
    return docs.select("thread_id", "source_fingerprint", "place", "latest", F.struct(*DOCUMENT).alias("document")).withColumn("size", document_size(F.col("document")))


def _object(values: Any) -> dict[str, dict]:
    """Answers by thread; the last one of a thread counts, other things are ignored."""
    threads = values.get("threads") if isinstance(values, dict) else None
    return {str(t["thread_id"]): t for t in threads or [] if isinstance(t, dict) and t.get("thread_id")} if isinstance(threads, list) else {}


def analyze(
    store: Store, owner: str, model: str = "offline", verifier_model: str | None = None, call: provider.Provider | None = None,
    limit: int | None = None, max_threads: int = 8, max_chars: int = 80_000, force: bool = False, dry_run: bool = False, retries: int = 3, sleep=time.sleep,
) -> dict[str, Any]:
    """Analyse what is new or changed; the summary counts the outcomes and lists the errors.

    The driver only makes the calls, which must not be repeated; replies are logged one by one, a small file
    each, and validated together, up to VALIDATED batches in one plan.
    """
    owner = owner.strip()
    if not owner:
        raise ValueError("owner must not be blank")
    if max_threads < 1 or max_chars < 1000:
        raise ValueError("max_threads must be at least 1 and max_chars at least 1000")
    spark = store.init().spark
    work = f"staging/{uuid.uuid4().hex}"
    at = f"{store.root}/{work}"
    try:
        candidates(store, owner, limit, force).write.parquet(f"{at}/documents")
        docs = spark.read.parquet(f"{at}/documents")
        ranked = [F.col("place"), F.desc("latest"), F.col("thread_id")]
        batched = greedy_batches(docs.select("thread_id", "size", "place", "latest"), "thread_id", "size", ranked, max_threads, max_chars, rank="rank")
        batched.write.parquet(f"{at}/batches")
        batched = spark.read.parquet(f"{at}/batches")
        plan = packing_summary(batched, "size").first().asDict()
        if dry_run:
            return {"dry_run": True} | plan
        if call is None:
            raise ValueError("a provider is needed to analyse")
        summary: dict[str, Any] = {k: plan[k] for k in ("threads_considered", "batches", "oversized")} | dict.fromkeys(("verified", "verified_with_gaps", "partial", "rejected"), 0) | {"errors": []}
        if plan["oversized"]:
            over = docs.join(batched.where("batch is null").select("thread_id"), "thread_id")
            reason = F.to_json(F.struct(F.lit("thread exceeds the size limit").alias("reason"), F.col("size").alias("character_count")))
            store.append("analyses", _rows(over.select("thread_id", "source_fingerprint", F.lit("oversized").alias("status"), reason.alias("verified_json"))))
        # in order of batch, so that reading one batch opens the few row groups that hold it
        members = docs.join(batched.where("batch is not null").select("thread_id", "batch", "rank"), "thread_id").withColumn("json", F.to_json("document", {"ignoreNullFields": "false"}))
        members.repartitionByRange("batch").sortWithinPartitions("batch", "rank").write.option("parquet.block.size", MEMBER_BYTES).parquet(f"{at}/members")
        members = spark.read.schema(members.schema).parquet(f"{at}/members")
        batch_identity(members, "batch", "rank", F.col("json"), prompts.VERSION).write.parquet(f"{at}/identities")
        # one short row a call
        identities = {r["batch"]: (r["batch_id"], r["input_sha256"]) for r in spark.read.parquet(f"{at}/identities").collect()}
        sizes = {r["batch"]: r["n"] for r in batched.where("batch is not null").groupBy("batch").agg(F.sum("size").alias("n")).collect()}
        asking = _Asking(store, owner, model, verifier_model or model, call, retries, sleep)
        for first, last in _together([sizes[b] for b in range(plan["batches"])]):
            some = members.where(F.col("batch").between(first, last))
            rows = some.orderBy("rank").select("batch", "thread_id", "json").collect()
            answers = [row for b, own in itertools.groupby(rows, key=lambda r: r["batch"]) for row in asking.batch(*identities[b], list(own), summary)]
            if answers:
                _judge(store, some, answers, summary)
        return summary
    finally:
        store.remove(work)


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of the batches that are taken together, whose documents have these sizes."""
    first = chars = 0
    for b, size in enumerate(sizes):
        if b > first and (b - first == VALIDATED or chars + size > VALIDATED_CHARS):
            yield first, b - 1
            first, chars = b, 0
        chars += size
    if sizes:
        yield first, len(sizes) - 1


def _rows(df: DataFrame) -> DataFrame:
    """With the log's other columns as nulls, and the time."""
    have = set(df.columns)
    for part in LOGS["analyses"].split(", "):
        name, kind = part.split(" ")
        if name not in have:
            df = df.withColumn(name, F.lit(now() if name == "updated_at" else None).cast(kind))
    return df


class _Asking:
    """The two calls of a batch, each logged before the next."""

    def __init__(self, store: Store, owner: str, model: str, verifier: str, call: provider.Provider, retries: int, sleep):
        self.store, self.owner, self.models, self.provider, self.retries, self.sleep = store, owner, {"extraction": model, "verification": verifier}, call, retries, sleep
        self.invocation = uuid.uuid4().hex[:8]

    def batch(self, batch_id: str, digest: str, rows: list[Row], summary: dict[str, Any]) -> list[tuple[str, str | None, str | None]]:
        """thread_id and both answers as JSON text; nothing if a call fails, so that its threads are taken again."""
        ids = [r["thread_id"] for r in rows]
        payload: dict[str, Any] = {"prompt_version": prompts.VERSION, "threads": [json.loads(r["json"]) for r in rows]}

        def log(phase: str, status: str, reply: provider.Reply | None = None, error: str | None = None) -> None:
            name = provider.model_name(reply.model) if reply and reply.model else self.models.get(phase, self.models["extraction"])
            row = (batch_id, phase, status, json.dumps(ids), digest, reply and reply.agent_id, reply and reply.id, name, reply and reply.result, error, reply and reply.duration_ms, now())
            self.store.log("runs", row)

        def ask(phase: str, prompt: str) -> dict:
            name = self.models[phase]
            reply = provider.call(self.provider, provider.Request(prompt, name, f"{prompts.VERSION}:{self.invocation}:{batch_id}:{phase}:{name}"), self.retries, self.sleep)
            log(phase, "finished", reply)
            return provider.parse_object(reply.result)

        try:
            extracted = ask("extraction", prompts.extraction(payload, self.owner))
            verified = ask("verification", prompts.verification(payload | {"extraction": extracted}, self.owner))
        except Exception as e:  # the batch fails, the others go on
            log("pipeline", "failed", error=str(e) or type(e).__name__)
            summary["rejected"] += len(ids)
            summary["errors"].append({"batch_id": batch_id, "error": str(e) or type(e).__name__})
            return []
        given = [_object(extracted), _object(verified)]
        return [(t, *(json.dumps(g[t], ensure_ascii=False) if t in g else None for g in given)) for t in ids]


def _judge(store: Store, members: DataFrame, answers: list[tuple[str, str | None, str | None]], summary: dict[str, Any]) -> None:
    """Validate the answers of several batches in one plan and save what comes of them."""
    given = store.spark.createDataFrame(answers, "thread_id string, extraction_json string, verification_json string").join(members.select("thread_id", "source_fingerprint"), "thread_id")
    messages = members.select("thread_id", F.explode("document.messages").alias("m")).select("thread_id", "m.message_id", "m.body")
    both = F.col("extraction_json").isNotNull() & F.col("verification_json").isNotNull()
    checked = validate.validate_threads(given.where(both).select("thread_id", F.col("verification_json").alias("answer")), messages)
    out = given.join(checked, "thread_id", "left")
    errors = F.coalesce("errors", F.array(F.concat("thread_id", F.lit(": no extraction or no verification"))))
    verdict = validate.status(F.col("extraction_json").isNotNull(), F.col("verification_json").isNotNull(), F.col("same_thread"), F.col("errors"), F.col("grounded"), F.col("needs_more_context"))
    out = out.withColumns({"status": verdict, "errors": errors, "verified_json": F.coalesce("whole", F.to_json(F.struct(errors.alias("errors"))))})
    path = f"staging/{uuid.uuid4().hex}"
    # written once, so that the log and the summary tell the same
    out.select("thread_id", "source_fingerprint", "status", "importance_score", "factual_confidence", "extraction_json", "verification_json", "verified_json", "errors").write.parquet(f"{store.root}/{path}")
    kept = store.spark.read.parquet(f"{store.root}/{path}")
    store.append("analyses", _rows(kept.drop("errors")))
    for r in kept.groupBy("status").count().collect():
        summary[r["status"]] += r["count"]
    summary["errors"] += [{"thread_id": r["thread_id"], "errors": list(r["errors"])} for r in kept.where(F.size("errors") > 0).select("thread_id", "errors").orderBy("thread_id").collect()]
    store.remove(path)
