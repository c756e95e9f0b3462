"""Threads: ranking, ordered documents, participants, fingerprints, quoted-reply removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.text import SPACE

#: removal of quoted text: least length of an earlier body, least place, most trailing, least prefix
EARLIER, PLACE, TRAILING, PREFIX = 200, 40, 80, 20


def rank_threads(messages: DataFrame, analyses: DataFrame | None = None, owner: str = "", limit: int | None = None) -> DataFrame:
    """Threads in order of attention: not yet analysed, owner wrote, owner addressed, long, attachments, recent.

    messages: conversation_id, sender_address, to_recipients_json, has_attachments, received_at_utc,
    sent_at_utc. One aggregation; the join runs on the threads, not on the messages.
    """
    o = F.lit(owner.strip().lower())
    threads = messages.groupBy(F.col("conversation_id").alias("thread_id")).agg(
        F.count("*").alias("message_count"),
        F.max(F.coalesce(F.col("has_attachments"), F.lit(0))).alias("any_attachment"),
        F.max(F.coalesce("received_at_utc", "sent_at_utc", F.lit(""))).alias("latest"),
        F.max(F.when(F.lower(F.coalesce("sender_address", F.lit(""))) == o, 1).otherwise(0)).alias("owner_sent"),
        F.max(F.when(F.instr(F.lower(F.coalesce("to_recipients_json", F.lit(""))), owner.strip().lower()) > 0, 1).otherwise(0)).alias("owner_addressed"),
    )
    if analyses is not None:
        known = analyses.select("thread_id").distinct().withColumn("analysed", F.lit(1))
        threads = threads.join(known, "thread_id", "left").withColumn("analysed", F.coalesce("analysed", F.lit(0)))
    else:
        threads = threads.withColumn("analysed", F.lit(0))
    keys: list[Column] = [F.col("analysed")]
    if owner.strip():
        keys += [F.desc("owner_sent"), F.desc("owner_addressed")]
    keys += [F.desc("message_count"), F.desc("any_attachment"), F.desc("latest"), F.col("thread_id")]
    threads = threads.orderBy(*keys)
    return threads if limit is None or limit < 0 else threads.limit(limit)


def without_quotes(earlier: Column, body: Column) -> Column:
    """struct(text, removed): body cut at verbatim earlier bodies near its end.

    earlier: array of structs that hold a body, the longest first.
    """

    def step(acc: Column, e: Column) -> Column:
        text = acc["text"]
        at = F.instr(text, e["body"])
        rest = F.regexp_replace(F.substring(text, at + F.length(e["body"]), F.length(text)), rf"\A{SPACE}+|{SPACE}+\z", "")
        prefix = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), rf"{SPACE}+\z", "")
        cut = F.struct(prefix.alias("text"), (acc["removed"] + F.length(text) - F.length(prefix)).cast("long").alias("removed"))
        # nested, so that a body that does not occur costs one search
        fits = F.when(at - 1 >= PLACE, (F.length(rest) <= TRAILING) & (F.length(prefix) >= PREFIX))
        return F.when(F.coalesce(fits, F.lit(False)), cut).otherwise(acc)

    return F.aggregate(earlier, F.struct(body.alias("text"), F.lit(0).cast("long").alias("removed")), step)


def remove_quotes(messages: DataFrame, thread: str, order: list[str], body: str) -> DataFrame:
    """Adds text and removed. A thread is gathered once; each message is folded over the long bodies before it.

    A thread has to fit in one row, as its document does.
    """
    names = [c for c in messages.columns if c != thread]
    place = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    # ties in the order are kept apart by a number, since the rest of a message may have no order
    tied = messages.withColumn("__tie", F.monotonically_increasing_id())
    threads = tied.groupBy(thread).agg(F.collect_list(F.struct(place.alias("at"), F.col("__tie").alias("tie"), F.struct(*names).alias("m"))).alias("all"))
    threads = threads.withColumn("all", F.array_sort("all", lambda x, y: _compare(F.struct(x["at"], x["tie"]), F.struct(y["at"], y["tie"]))))
    long = F.filter(F.transform("all", lambda x, i: F.struct((-F.length(x["m"][body])).alias("n"), i.alias("ord"), x["m"][body].alias("body"))), lambda e: e["n"] <= -EARLIER)
    threads = threads.withColumn("long", F.array_sort(long))
    each = F.transform("all", lambda x, i: F.struct(x["m"].alias("m"), without_quotes(F.filter("long", lambda e: e["ord"] < i), x["m"][body]).alias("cut")))
    out = threads.select(thread, F.explode(each).alias("x")).select(thread, "x.m.*", "x.cut.text", "x.cut.removed")
    return out.select(*messages.columns, "text", "removed")


def _compare(x: Column, y: Column) -> Column:
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def participants(messages: DataFrame, thread: str, order: str, people: str) -> DataFrame:
    """people: array of struct(name, address) per message; the last name given to an address counts."""
    one = messages.select(F.col(thread).alias("thread_id"), F.col(order).alias("ord"), F.posexplode(people).alias("pos", "who"))
    one = one.where("who.address <> ''")
    last = one.groupBy("thread_id", F.lower("who.address").alias("key")).agg(F.max_by("who", F.struct("ord", "pos")).alias("who"))
    return last.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "who"))), lambda x: x["who"]).alias("participants"))


def fingerprints(messages: DataFrame) -> DataFrame:
    """thread_id, fingerprint: SHA-256 of the ordered messages' hashes, ids and times."""
    m = messages.select(
        F.col("conversation_id").alias("thread_id"),
        F.struct(
            F.coalesce("sent_at_utc", "received_at_utc", F.lit("")).alias("t"),
            F.col("email_id").alias("id"),
            F.to_json(F.struct("body_sha256", F.col("email_id").alias("message_id"), "received_at_utc", "sent_at_utc"), {"ignoreNullFields": "false"}).alias("j"),
        ).alias("m"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["j"]), ",")
    return m.groupBy("thread_id").agg(F.sha2(F.concat(F.lit("["), joined, F.lit("]")).cast("binary"), 256).alias("fingerprint"))


#: fixed values: the fields of a document and of its messages, in order
DOCUMENT = ("thread_id", "source_fingerprint", "owner_email", "subject", "message_count", "has_unavailable_attachments", "participants", "exact_duplicate_chars_removed", "messages")
MESSAGE = ("message_id", "internet_message_id", "sent_at_utc", "received_at_utc", "sender", "to", "cc", "subject", "has_attachments", "body")
PEOPLE = "array<struct<name:string,address:string>>"


def thread_documents(messages: DataFrame, owner: str = "") -> DataFrame:
    """One nested document per thread from the messages table, with the columns DOCUMENT.

    Clean bodies are freed of quoted replies; the subject is the last that is not empty.
    """
    person = lambda name, address: F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(address, F.lit("")).alias("address"))
    listed = lambda c: F.coalesce(F.from_json(c, PEOPLE), F.array().cast(PEOPLE))
    m = messages.withColumn("__t", F.coalesce("sent_at_utc", "received_at_utc", F.lit("")))
    m = remove_quotes(m, "conversation_id", ["__t", "email_id"], "clean_body")
    m = m.withColumns({
        "at": F.struct(F.col("__t").alias("t"), F.col("email_id").alias("id")), "message_id": F.col("email_id"), "sender": person(F.col("sender_name"), F.col("sender_address")),
        "to": listed("to_recipients_json"), "cc": listed("cc_recipients_json"), "has_attachments": F.coalesce(F.col("has_attachments").cast("boolean"), F.lit(False)), "body": F.col("text"),
    }).withColumn("people", F.concat(F.array("sender"), "to", "cc"))
    docs = m.groupBy(F.col("conversation_id").alias("thread_id")).agg(
        F.coalesce(F.max_by("subject", F.when(F.col("subject") != "", F.col("at"))), F.lit("")).alias("subject"),
        F.count("*").alias("message_count"),
        F.bool_or("has_attachments").alias("has_unavailable_attachments"),
        F.sum("removed").alias("exact_duplicate_chars_removed"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", *MESSAGE))), lambda x: x.dropFields("at")).alias("messages"),
    )
    docs = docs.join(participants(m, "conversation_id", "at", "people"), "thread_id", "left").join(fingerprints(messages), "thread_id")
    docs = docs.withColumn("participants", F.coalesce("participants", F.array().cast(PEOPLE))).withColumnRenamed("fingerprint", "source_fingerprint")
    return docs.withColumn("owner_email", F.lit(owner.strip())).select(*DOCUMENT)
