"""Registered queries over the driver's tables; each runs the operators that the product runs.

Stand-ins for tables: a message is a row of conversations (its thread conv_id, its time turn, its sender
role), an HTML body pages.html, a plain body documents.text, a quote benchmark.text, an analysis a row
of labels, a registry event a row of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.functions import html, text
from mailloom.operators import batches, merge, provider, quotes_found, reports, threads, validate
from mailloom.sources.readers import normalize_records
from mailloom.sources.scratch import fresh_path, spread
from mailloom.sources.store import Store

#: quotes that are sent to every executor at most, and their characters; more are found through their words
BROADCAST_QUOTES, BROADCAST_QUOTE_CHARS = 5_000, 32 << 20


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as rows of the messages table, as far as the operators read them."""
    c = _t(spark, sf, "conversations")
    addressed = F.when(F.col("role") == "assistant", '[{"name":"","address":"user"}]').otherwise("[]")
    return c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("email_id"),
        F.lit(None).cast("string").alias("internet_message_id"),
        F.col("conv_id").alias("conversation_id"),
        "turn",
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("sender_name"),
        F.col("role").alias("sender_address"),
        addressed.alias("to_recipients_json"),
        F.lit("[]").alias("cc_recipients_json"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).otherwise("").alias("subject"),
        F.when(F.length("text") > 400, 1).otherwise(0).alias("has_attachments"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("sent_at_utc"),
        F.lit(None).cast("string").alias("received_at_utc"),
        text.body_hash(F.col("text")).alias("body_sha256"),
        F.col("text").alias("body"),
        F.col("text").alias("clean_body"),
    )


def _quoting(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that end in the text of the message before them, as replies do."""
    before = F.lag("body").over(Window.partitionBy("conversation_id").orderBy("turn"))
    m = _messages(spark, sf)
    return m.withColumn("clean_body", F.when(before.isNotNull(), F.concat("body", F.lit("\n"), before)).otherwise(F.col("body")))


def store_stats(spark, sf):
    sources = _t(spark, sf, "documents").groupBy("source").count().select(F.lit("imported").alias("status"))
    analyses = _t(spark, sf, "labels").select(F.when(F.col("quality") == 1, "verified").otherwise("partial").alias("status"))
    return reports.store_stats(_messages(spark, sf), sources, analyses)


def _ranked(spark, sf, limit=None):
    analyses = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("thread_id"))
    return threads.rank_threads(_messages(spark, sf), analyses, owner="user", limit=limit)


def thread_rank(spark, sf):
    return _ranked(spark, sf)


def thread_rank_topk(spark, sf):
    return _ranked(spark, sf, 20)


def thread_scan_order(spark, sf):
    docs = threads.thread_documents(_messages(spark, sf), "user")
    return docs.select(F.col("thread_id").alias("conversation_id"), F.posexplode("messages").alias("place", "m")).select("conversation_id", F.col("m.message_id").alias("email_id"), (F.col("place") + 1).alias("place"))


def quote_dedup(spark, sf):
    cut = threads.remove_quotes(_quoting(spark, sf).select("conversation_id", "turn", "clean_body"), "conversation_id", ["turn"], "clean_body")
    return cut.select(F.col("conversation_id").alias("conv_id"), "turn", F.col("text").alias("kept"), "removed")


def thread_fingerprint(spark, sf):
    return threads.fingerprints(_messages(spark, sf))


def _sizes(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))


def _packed(spark, sf):
    return batches.greedy_batches(_sizes(spark, sf), "conv_id", "size", [F.col("conv_id")], most=8, room=6000)


def pack_batches(spark, sf):
    return _packed(spark, sf)


def pack_summary(spark, sf):
    return reports.packing_summary(_packed(spark, sf), "size")


def batch_identity(spark, sf):
    member = _packed(spark, sf).where("batch is not null")
    return batches.batch_identity(member, "batch", "conv_id", F.concat(F.lit('{"thread_id":"'), F.col("conv_id").cast("string"), F.lit('"}')))


def thread_document(spark, sf):
    d = threads.thread_documents(_quoting(spark, sf), " user ")
    each = lambda f: F.array_join(F.transform("messages", f), ",")
    return d.select(
        "thread_id", "owner_email", "subject", "message_count", "has_unavailable_attachments", "exact_duplicate_chars_removed", "source_fingerprint",
        F.array_join(F.transform("participants", lambda p: F.concat(p["address"], F.lit("="), p["name"])), ";").alias("people"),
        each(lambda m: m["message_id"]).alias("ids"), each(lambda m: m["sender"]["address"]).alias("senders"), each(lambda m: m["has_attachments"].cast("int").cast("string")).alias("attached"),
        each(lambda m: text.body_hash(m["body"])).alias("bodies"),
    )


def participants_last_wins(spark, sf):
    m = _messages(spark, sf)
    sender = F.struct(F.col("sender_name").alias("name"), F.initcap("sender_address").alias("address"))
    who = F.concat(F.array(sender), F.from_json("to_recipients_json", threads.PEOPLE))
    p = threads.participants(m.withColumn("people", who), "conversation_id", "turn", "people")
    return p.select("thread_id", F.array_join(F.transform("participants", lambda x: F.concat(x["address"], F.lit("="), x["name"])), ";").alias("people"))


def html_to_text(spark, sf):
    p = spread(_t(spark, sf, "pages").select("page_id", "html"))
    return p.select("page_id", html.clean_body_column(F.col("html"), F.lit("html")).alias("text"))


def clean_text(spark, sf):
    return spread(_t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", html.clean_body_column(F.col("text"), F.lit("text")).alias("text"))


def evidence_normalize(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.body_hash(text.normalized_evidence(F.col("text"))).alias("normal_sha256"))


def evidence_hits(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, item_id where the normalised quote lies in the normalised text."""
    q = quotes.select("item_id", text.normalized_evidence(F.col("text")).alias("quote")).where(F.length("quote") >= text.LEAST_QUOTE)
    d = docs.select("doc_id", text.normalized_evidence(F.col("text")).alias("body"))
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("quote")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_QUOTES and size["chars"] <= BROADCAST_QUOTE_CHARS:
        return quotes_found.search(d, q)
    # whole words inside the quote must be words of the text: meet on three of them
    words = F.split("quote", " ")
    key = lambda w, at: F.xxhash64(w[at], w[at + 1], w[at + 2])
    long = q.where(F.size(words) >= 5).withColumn("key", key(words, F.lit(1)))
    w = F.split("body", " ")
    spots = F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))
    met = d.select("doc_id", F.explode(F.array_distinct(F.transform(spots, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))).alias("key"))
    pairs = met.join(long.select("key", "item_id", "quote"), "key").select("doc_id", "item_id", "quote")
    hits = pairs.join(d, "doc_id").where(F.col("body").contains(F.col("quote"))).select("doc_id", "item_id")
    # quotes of fewer words share no such key: a pass over the texts for each block of different ones
    short = q.where(F.size(words) < 5)
    once = short.groupBy("quote").agg(F.min("item_id").alias("item_id"))
    blocks = -(-once.count() // BROADCAST_QUOTES)
    for b in range(blocks):
        block = once.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == b)
        found = quotes_found.search(d, block).join(block, "item_id").drop("item_id").join(short, "quote")
        hits = hits.unionByName(found.select("doc_id", "item_id"))
    return hits


def evidence_check(spark, sf):
    return evidence_hits(_t(spark, sf, "benchmark"), _t(spark, sf, "documents"))


def body_hash(spark, sf):
    d = _t(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.body_hash(F.col("text")).alias("sha256"))
    return d.unionByName(_t(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.body_hash(F.col("html")).alias("sha256")))


def _normal(records: DataFrame, **fields: Column) -> DataFrame:
    """The records, made up of the fields, as the importer normalises them."""
    return normalize_records(records.select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("record")))


def synthetic_id(spark, sf):
    """No id: what is known of a message makes one. bodyPreview only carries the document's number."""
    d = _t(spark, sf, "documents")
    m = _normal(d, subject=F.col("source"), conversationId=F.col("lang"), receivedDateTime=F.col("n_chars"), body=F.col("text"), bodyPreview=F.col("doc_id").cast("string"))
    return m.select(F.col("body_preview").cast("long").alias("doc_id"), "email_id", "conversation_id", "received_at_utc", "body_sha256")


def flag_parse(spark, sf):
    """Flags as words, numbers and truth values; the first spelling decides even as null."""
    o = _t(spark, sf, "orders")
    word = F.when(F.col("o_orderstatus") == "F", " TRUE ").when(F.col("o_orderstatus") == "P", "Yes").otherwise("no")
    m = _normal(o, id=F.col("o_orderkey").cast("string"), isRead=word, hasAttachments=F.col("o_orderkey") % 3, has_attachments=F.lit("yes"), importance=F.col("o_orderstatus"))
    return m.groupBy("importance", F.col("is_read"), F.col("has_attachments")).agg(F.count("*").alias("n"))


def json_props(spark, sf):
    """Categories as JSON text, as text that is not JSON, and as an object, which is none."""
    e = _t(spark, sf, "events")
    listed = F.concat(F.lit('["'), F.col("event_type"), F.lit('"," ",'), F.get_json_object("props", "$.k"), F.lit("]"))
    kind = F.col("event_id") % 3
    m = _normal(e, email_id=F.col("event_id").cast("string"), categories_json=F.when(kind == 0, listed).when(kind == 1, "not json").otherwise(F.col("props")))
    return m.groupBy("categories_json").agg(F.count("*").alias("n"))


def recipients_parse(spark, sf):
    """Recipients nested, plain, as bare text and empty, and a sender; numbers as text."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = _t(spark, sf, "customer").join(n, "c_nationkey")
    pair = lambda name, address: F.struct(name.alias("name"), address.alias("address"))
    nested = F.to_json(F.array(F.struct(pair(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")), F.lower("c_name")).alias("emailAddress")), F.struct(pair(F.lit(""), F.lit("")).alias("emailAddress"))))
    plain = F.to_json(F.array(pair(F.col("n_name"), F.col("c_custkey").cast("string"))))
    m = _normal(c, id=F.col("c_custkey").cast("string"), to_recipients_json=nested, ccRecipients=plain, bcc_recipients_json=F.lit("a@b.c"), sender=F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return m.select(F.col("email_id").cast("long").alias("c_custkey"), "to_recipients_json", "cc_recipients_json", "bcc_recipients_json", "sender_name", "sender_address")


def upsert_latest(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 4).alias("value"))
    return merge.latest_by_key(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


def upsert_precedence(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return merge.with_precedence(e, ["user_id"], F.col("event_type") == "purchase", [F.col("ts"), F.col("event_id")]).drop("ts")


def source_merge(spark, sf):
    """Customers as messages, orders as the links of three sources; a CSV source is read anew, the second one is JSON.

    The source now lists the customers of one segment, under other names.
    """
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    messages = c.select(F.col("c_custkey").alias("email_id"), F.col("c_name").alias("subject"))
    number = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).cast("long")
    links = o.groupBy(F.col("o_custkey").alias("email_id"), number.alias("source_file_id")).agg(F.count("*").alias("source_index"))
    held = messages.join(links.select("email_id").distinct(), "email_id", "left_semi")
    incoming = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("email_id"), F.upper("c_name").alias("subject"), F.col("c_custkey").alias("source_index"))
    merged, linked = merge.merge_source(held, links, incoming, 1, False, spark.createDataFrame([(2,)], "source_file_id long"))
    n = linked.groupBy("email_id").agg(F.count("*").alias("sources"))
    return merged.join(n, "email_id").select("email_id", "subject", "sources")


def stale_orphan_prune(spark, sf):
    customers = _t(spark, sf, "customer").select("c_custkey", "c_name")
    recent = _t(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return merge.without_orphans(customers, recent, "c_custkey")


def has_rich_source_semi(spark, sf):
    rich = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source_file_id"))
    links = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("email_id"), F.col("o_custkey").alias("source_file_id"))
    return merge.held_by(links, rich).select(F.col("email_id").alias("o_orderkey"))


def skip_current_anti(spark, sf):
    """Documents as files; those with a good label were imported, every second one of them with other content."""
    files = _t(spark, sf, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("path"), text.body_hash(F.col("text")).alias("sha256"))
    done = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 2 == 0).alias("same"), F.when(F.col("quality") == 1, "imported").otherwise("failed").alias("status"))
    known = done.join(files.select("path", "sha256"), "path").select("path", "status", F.when(F.col("same"), F.col("sha256")).otherwise("").alias("sha256"))
    return merge.not_current(files, known).select("doc_id", "source")


def status_report(spark, sf):
    d = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    score = F.col("n_chars") % 101
    outcome = F.struct(F.struct((F.col("quality") + 1).alias("evidence_claims_checked"), F.col("toxic").alias("evidence_claims_valid")).alias("validation"))
    done = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "verified_with_gaps").otherwise("verified")).otherwise("partial")
    analyses = d.select(done.alias("status"), score.alias("importance_score"), (score / 100).alias("factual_confidence"), F.to_json(outcome).alias("verified_json"))
    runs = _t(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "failed").otherwise("finished").alias("status"))
    return reports.quality_report(analyses, runs).withColumn("status_counts", F.to_json("status_counts"))


def claim_validate(spark, sf):
    """Claims made up of benchmark passages as quotes, against documents as messages; some answers are malformed.

    Thread 1 has a score too high, 2 a score that is text, 3 a claim that is a number, 4 a confidence that is text.
    """
    docs, quotes = _t(spark, sf, "documents"), _t(spark, sf, "benchmark")
    hits = evidence_hits(quotes, docs).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    named = quotes.join(hits, "item_id", "left").select("item_id", "text", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), (F.col("item_id") % 5).cast("string").alias("thread_id"))
    # read again twice; as long as the quotes, not the documents
    path = fresh_path(spark)
    named.write.parquet(path)
    named = spark.read.schema(named.schema).parquet(path)
    m = F.col("doc_id").cast("string")
    claim = F.to_json(F.struct(
        F.concat(F.lit("c"), (F.col("item_id") % 9).cast("string")).alias("claim_id"), F.when(F.col("item_id") % 7 == 0, "guess").otherwise("fact").alias("type"), F.substring("text", 1, 20).alias("text"),
        F.array(m).alias("message_ids"), F.array(F.struct(m.alias("message_id"), F.col("text").alias("quote"))).alias("evidence_quotes"), F.lit(1.0).alias("confidence"),
    ))
    t = F.col("thread_id")
    made = named.groupBy(t).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", claim.alias("c")))), lambda x: x["c"]), ",").alias("claims"))
    answer = F.concat(
        F.lit('{"thread_id":"'), t, F.lit('","category":"task","summary":"s","needs_more_context":false,"importance_score":'), F.when(t == "1", "150").when(t == "2", '"70"').otherwise("70"),
        F.lit(',"audit":{"summary_grounded":true,"factual_confidence":'), F.when(t == "4", '"0.5"').otherwise("0.5"), F.lit('},"claims":['), F.col("claims"), F.when(t == "3", ",7").otherwise(""), F.lit("]}"),
    )
    messages = docs.select("doc_id", F.col("text").alias("body")).join(named.select("doc_id", "thread_id").distinct(), "doc_id").select("thread_id", F.col("doc_id").cast("string").alias("message_id"), "body")
    out = validate.validate_threads(made.select("thread_id", answer.alias("answer")), messages)
    verdict = validate.status(F.lit(True), F.lit(True), F.col("same_thread"), F.col("errors"), F.col("grounded"), F.col("needs_more_context"))
    return out.select("thread_id", F.col("checked").cast("long").alias("checked"), F.col("valid").cast("long").alias("valid"), F.size("errors").cast("long").alias("errors"), "importance_score", "factual_confidence", verdict.alias("status"))


def experience_pivot(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "action").when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "view", "goal").otherwise("fact")
    claim = F.to_json(F.struct(F.col("event_id").alias("claim_id"), kind.alias("type"), F.col("event_type").alias("text")))
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", claim.alias("c")))), lambda x: F.parse_json(x["c"])).alias("claims"))
    found = lists.select("user_id", validate.experience("claims").alias("x"))
    own = lambda name: F.array_join(F.transform(F.col("x")[name], lambda c: c["claim_id"].cast("string")), ",").alias(name)
    return found.select("user_id", *(own(n) for n in ("actions", "decisions", "goals")), F.size(F.map_filter("x", lambda _, v: F.size(v) > 0)).alias("kinds"))


# --- end to end ---------------------------------------------------------------------

#: conversations in one export file
EXPORT_CONVERSATIONS, EXPORT_DOCUMENTS = 200, 2_000


def _exports(spark: SparkSession, sf: str) -> str:
    """Conversations as JSON export files, documents as CSV files, in the shared folder."""
    path = fresh_path(spark)
    c = _messages(spark, sf)
    to = F.from_json("to_recipients_json", threads.PEOPLE)
    record = F.struct(
        F.col("email_id").alias("id"), F.col("conversation_id").cast("string").alias("conversationId"), F.col("sent_at_utc").alias("sentDateTime"),
        F.struct(F.struct(F.col("sender_name").alias("name"), F.concat(F.col("sender_address"), F.lit(" ")).alias("address")).alias("emailAddress")).alias("from"),
        F.transform(to, lambda x: F.struct(x.alias("emailAddress"))).alias("toRecipients"), F.concat(F.lit(" "), F.col("subject")).alias("subject"),
        F.struct(F.lit("text").alias("contentType"), F.col("body").alias("content")).alias("body"), (F.col("has_attachments") == 1).alias("hasAttachments"), F.lit("no").alias("isRead"),
        F.array("sender_address", F.lit(" ")).alias("categories"),
    )
    part = F.floor(F.col("conversation_id") / EXPORT_CONVERSATIONS)
    c.groupBy(part.alias("part")).agg(F.collect_list(record).alias("value")).write.partitionBy("part").json(f"{path}/mail")
    d = _t(spark, sf, "documents")
    row = d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("email_id"), F.col("source").alias("sender_name"), F.col("lang").alias("subject"), F.col("text").alias("body"), F.lit("text").alias("body_type"),
        F.lit("False").alias("has_attachments"), F.lit("True").alias("is_read"), F.floor(F.col("doc_id") / EXPORT_DOCUMENTS).alias("part"),
    )
    quoted = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}
    # a folder of one file each, into however many pieces the table is read
    row.repartition("part").write.partitionBy("part").options(**quoted).csv(f"{path}/table")
    return path


def _imported(spark: SparkSession, sf: str, *folders: str) -> tuple[Store, list[dict]]:
    """A store that imported the exports twice, and both summaries."""
    from mailloom.plans.ingest import ingest

    path, store = _exports(spark, sf), Store(spark, fresh_path(spark))
    return store, [ingest(store, [f"{path}/{f}" for f in folders]) for _ in range(2)]


def ingest_exports(spark, sf):
    """Files to messages: discovery, parsing, normalisation, merge and commit."""
    store, _ = _imported(spark, sf, "mail", "table")
    return store.table("messages").select(
        "email_id", "conversation_id", "sent_at_utc", "sender_name", "sender_address", "to_recipients_json", "subject", "body_type", "categories_json", "body_sha256",
        text.body_hash(F.col("clean_body")).alias("clean_sha256"), "has_attachments", "is_read",
    )


def ingest_again(spark, sf):
    """The registry and both summaries: the second import finds nothing new."""
    store, (first, second) = _imported(spark, sf, "mail", "table")
    names = ("files_total", "files_imported", "files_skipped", "files_failed", "messages_imported")
    told = spark.createDataFrame([(n, first[n], second[n]) for n in names], "name string, first long, second long")
    by_kind = store.table("sources").groupBy("kind", "status").agg(F.count("*").alias("first"), F.sum("message_count").alias("second"))
    links = store.table("links").agg(F.lit("links").alias("name"), F.count("*").alias("first"), F.count_distinct("email_id").alias("second"))
    return told.unionByName(by_kind.select(F.concat_ws(" ", "kind", "status").alias("name"), "first", "second")).unionByName(links)


def _answer(phase: str, payload: dict) -> dict:
    """A scripted model: a claim for each message, some with words that nobody wrote, some threads left out."""
    out = []
    for t in payload["threads"]:
        n = int(t["thread_id"])
        if n % 7 == 0:
            continue
        claims = [
            {
                "claim_id": f"c{k}", "type": "decision" if k % 2 == 0 else "fact", "text": "t", "message_ids": [m["message_id"]],
                "evidence_quotes": [{"message_id": m["message_id"], "quote": ("no such words " if k % 3 == 1 and n % 3 == 1 else "") + m["body"][:40]}], "confidence": 1.0,
            }
            for k, m in enumerate(t["messages"])
        ]
        score = 10 * t["message_count"]
        one = {"thread_id": t["thread_id"], "category": "task", "importance_score": str(score) if n % 5 == 0 else score, "importance_reasons": ["r"], "summary": "s", "claims": claims, "needs_more_context": n % 2 == 0, "missing_context": []}
        out.append(one | ({"audit": {"summary_grounded": True, "factual_confidence": 0.5}} if phase == "verification" else {}))
    return {"threads": out}


def analysis_run(spark, sf):
    """Import, ranking, documents, batches, calls of a scripted provider, validation and statuses in one run."""
    from mailloom.plans.analyze import analyze

    store, _ = _imported(spark, sf, "mail")
    analyze(store, "user", call=provider.OfflineProvider(_answer))
    v = lambda path: F.get_json_object("verified_json", path)
    return store.analyses().select(
        "thread_id", "status", "importance_score", "factual_confidence", v("$.validation.evidence_claims_checked").cast("long").alias("checked"), v("$.validation.evidence_claims_valid").cast("long").alias("valid"),
        F.size(F.from_json(F.coalesce(v("$.validation.errors"), v("$.errors")), "array<string>")).alias("errors"), F.coalesce(F.size(F.from_json(v("$.experience.decisions"), "array<string>")), F.lit(0)).alias("decisions"), v("$.importance_reasons").alias("reasons"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        store_stats, thread_rank, thread_rank_topk, thread_scan_order, quote_dedup, thread_fingerprint, pack_batches, pack_summary, batch_identity, thread_document, participants_last_wins, html_to_text, clean_text,
        evidence_normalize, evidence_check, body_hash, synthetic_id, flag_parse, json_props, recipients_parse, upsert_latest, upsert_precedence, source_merge, stale_orphan_prune, has_rich_source_semi, skip_current_anti,
        status_report, claim_validate, experience_pivot, ingest_exports, ingest_again, analysis_run,
    )
}
