"""Operators against plain Python versions of their rules."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailloom.functions import html, text
from mailloom.operators import batches, merge, provider, threads, validate
from mailloom.plans import queries
from mailloom.sources import records


def plain_batches(sizes, most, room):
    out, n, used, b = [], 0, 0, 0
    for s in sizes:
        if s > room:
            out.append(None)
            continue
        if n and (n >= most or used + s > room):
            b, n, used = b + 1, 0, 0
        n, used = n + 1, used + s
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_batches_over_many_blocks(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 10, 49, 50, 51, 99, 100, 101, 300]) for _ in range(157)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k long, size long").repartition(5)
    got = {x["k"]: x["batch"] for x in batches.greedy_batches(df, "k", "size", [F.col("k")], most=4, room=100, block=10).collect()}
    assert [got[k] for k in range(len(sizes))] == plain_batches(sizes, 4, 100)


def test_greedy_batches_of_nothing(spark):
    df = spark.createDataFrame([], "k long, size long")
    assert batches.greedy_batches(df, "k", "size", [F.col("k")]).count() == 0


def plain_quotes(body, earlier):
    removed = 0
    for e in sorted((x for x in earlier if len(x) >= 200), key=lambda x: -len(x)):
        at = body.find(e)
        if at >= 40 and len(body[at + len(e) :].strip()) <= 80 and len(body[:at].rstrip()) >= 20:
            removed += len(body) - len(body[:at].rstrip())
            body = body[:at].rstrip()
    return body, removed


def test_quotes_at_each_threshold(spark):
    cases = []
    for size in (199, 200):
        for at in (39, 40):
            for tail in (80, 81):
                for prefix in (19, 20, 60):
                    q = ("q" * size)[:size]
                    head = ("p" * prefix).ljust(at)[: max(at, prefix)]
                    cases.append(([q], head + q + "t" * tail))
    cases += [(["a" * 250, "a" * 300], "x" * 50 + "a" * 300), (["é😀" * 150], "y" * 45 + " " + "é😀" * 150 + " \x1c"), ([], "z")]
    rows = [(k, 0 if i == 0 else i, b) for k, (es, body) in enumerate(cases) for i, b in enumerate([*es, body])]
    got = threads.remove_quotes(spark.createDataFrame(rows, "t long, o long, b string"), "t", ["o"], "b").collect()
    last = {}
    for r in sorted(got, key=lambda r: r["o"]):
        last[r["t"]] = (r["text"], r["removed"])
    for k, (es, body) in enumerate(cases):
        # a thread's own message never counts as earlier
        assert last[k] == plain_quotes(body, es), k


def test_evidence(spark):
    rows = [(" A  b\x1ccd  Ef\n", "a b cd ef"), ("short", "short"), (None, ""), ("Straße weit", "strasse weit"), ("ΣΑΣ ſtill ŉ İstanbul ﬁnden", "σασ still ʼn i̇stanbul finden")]
    df = spark.createDataFrame([(a, b) for a, b in rows], "a string, b string")
    got = df.select(text.normalized_evidence(F.col("a")).alias("n"), text.evidence_in_text(F.col("b"), text.normalized_evidence(F.col("a"))).alias("hit")).collect()
    assert [r["n"] for r in got] == [b for _, b in rows]
    assert [r["hit"] for r in got] == [True, False, False, True, True]
    odd = "".join(chr(c) for c in range(0x24F) if chr(c).isprintable())
    assert spark.range(1).select(text.casefold(F.lit(odd)).alias("x")).first()["x"] == odd.casefold()


@pytest.mark.parametrize("most", [2, 100])
def test_quotes_found_either_way(spark, monkeypatch, most):
    """Few quotes are searched for in one pass, many by their words and in blocks; both as a plain search."""
    monkeypatch.setattr(queries, "BROADCAST_QUOTES", most)
    bodies = ["the quick brown fox jumps over the lazy dog", "The  quick\nbrown fox jumps", "lazy dogs everywhere", "", None, "one two three four five six seven", "x" * 50]
    quotes = ["quick brown", "quick  BROWN", "e quick brown fox jum", "lazy dog", "two three four five si", "xxxxxxxxxx", "no such quote here at all", "short", "", None, "fox jumps over the lazy", "quick brown"]
    d = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    plain = lambda t: " ".join((t or "").split()).casefold()
    want = sorted((i, k) for i, b in enumerate(bodies) for k, x in enumerate(quotes) if len(plain(x)) >= 8 and plain(x) in plain(b))
    assert sorted(tuple(r) for r in queries.evidence_hits(q, d).select("doc_id", "item_id").collect()) == want and want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><p>b</p>", "a\n\nb"),
        ("a<br>b<br/>c", "a\nb\n\nc"),
        ("<a href='cid:1'>x</a><a href='data:q'>y</a><a href='u'>z</a></a>", "xyz <u>"),
        ("<a href='1'>x<a href='2'>y</a></a>", "xy <2> <1>"),
        ("<script>a<script>b</script>c", "c"),
        ("<style>x</style><title>T</title>&amp;&copy;", "T&©"),
        ("<script>never closed <p>x</p>", ""),
        ("<div>a \t b </div>\x00\r\n\r\n\r\n<div>c</div>", "a b\n\nc"),
    ],
)
def test_clean_body_html(page, want):
    assert html.clean_body(page, "html") == want


def test_clean_body_text():
    assert html.clean_body(None) == "" and html.clean_body("a &lt; b\x0bc") == "a < b\nc"
    assert html.clean_body("   lead\n\n\n\nx  ") == "lead\n\nx" and html.clean_body("t <p>x", "text") == "t\nx"


def test_unwrap_and_normalise():
    import json

    one = {"id": "1"}
    wrapped = one
    for _ in range(3):
        wrapped = json.dumps(wrapped)
    assert records.unwrap(wrapped) == [one] and records.unwrap({"body": {"value": [one]}}) == [one] and records.unwrap([]) == []
    for bad, kind in (({"a": 1}, ValueError), (5, TypeError), ([1], TypeError), (json.dumps(wrapped), TypeError)):
        with pytest.raises(kind):
            records.unwrap(bad)
    n = records.normalize({"from": " a@b ", "toRecipients": "a@b.c", "categories": "Project", "subject": None, "hasAttachments": None, "has_attachments": "yes", "body": {"content": "x", "content_type": "text"}})
    assert n["sender_address"] == "a@b" and n["to_recipients_json"] == "[]" and n["categories_json"] == "[]" and n["has_attachments"] == 0 and n["body_type"] == "text"
    assert n["email_id"].startswith("synthetic:") and n["conversation_id"] == n["email_id"]
    assert records.normalize({"from": {"emailAddress": {}}, "sender_name": "N"})["sender_name"] is None
    assert [records.flag(x) for x in (True, 2, 0, " YES ", "no", None, "2")] == [1, 1, 0, 1, 0, 0, 0]
    assert list(records.parse_file("csv", "﻿a,b\n1,2,3\n\n4\n".encode())) == [{"a": "1", "b": "2", None: ["3"]}, {"a": "4", "b": None}]


def test_synthetic_id():
    import hashlib

    n = records.normalize({"internetMessageId": "i", "conversation_id": "c", "receivedDateTime": None, "subject": "s", "body": "b"})
    assert n["email_id"] == "synthetic:" + hashlib.sha256("\x1f".join(["i", "c", "", "s", "b"]).encode()).hexdigest()


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"emailAddress": "x", "name": " N ", "address": "a@b"}, ("N", "a@b")),  # only an object is unwrapped
        ({"emailAddress": {}, "name": "N"}, ("", "")),
        ({"emailAddress": {"name": "N", "address": 5}}, ("N", "5")),
        (" a@b ", ("", "a@b")),
        (7, ("", "")),
        (None, ("", "")),
    ],
)
def test_people(given, want):
    assert tuple(records.person(given).values()) == want


def test_lists_in_records():
    assert records.people('{"address": "a"}') == '[{"name":"","address":"a"}]' and records.people('"a@b"') == "[]" and records.people(5) == "[]"
    assert records.labels('"Red"') == '["Red"]' and records.labels("Red") == "[]" and records.labels({"a": 1}) == "[]" and records.labels([1, " ", "x"]) == '["1","x"]'


def test_answers_are_recovered():
    assert provider.parse_object('```json\n{"threads": []}\n```') == {"threads": []}
    assert provider.parse_object('so {bad} then {"a": {"b": 1}} end') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        provider.parse_object("nothing")
    with pytest.raises(TypeError):
        provider.parse_object("[1]")


def test_retries():
    waits, state = [], {"n": 0}

    def flaky(request):
        state["n"] += 1
        if state["n"] == 1:
            raise provider.ProviderError("busy", True, 99)
        return provider.Reply("{}", "error" if state["n"] == 2 else "Completed")

    assert provider.call(flaky, provider.Request("", "m", "k"), sleep=waits.append).result == "{}" and waits == [30.0, 2.0]

    calls = []

    def never(request):
        calls.append(request)
        raise provider.ProviderError("busy", True)

    with pytest.raises(provider.ProviderError):
        provider.call(never, provider.Request("", "m", "k"), retries=3, sleep=waits.append)
    assert len(calls) == 3 and waits[2:] == [1.0, 2.0]

    def refused(request):
        raise provider.ProviderError("no")

    with pytest.raises(provider.ProviderError):
        provider.call(refused, provider.Request("", "m", "k"), sleep=waits.append)


GOOD = {"claim_id": "c", "type": "fact", "text": "t", "message_ids": ["m"], "evidence_quotes": [{"message_id": "m", "quote": "quoted words"}]}
RULES = {
    "thread_id mismatch": {"thread_id": "x"}, "category": {"category": "x"}, "importance_score": {"importance_score": 7.5}, "summary": {"summary": " \t\n\u2003"}, "claims must": {"claims": None},
    "not an object": {"claims": [None]}, "no id": {"claims": [GOOD | {"claim_id": ""}]}, "repeats": {"claims": [GOOD | {"type": "x"}, GOOD]}, "unknown type": {"claims": [GOOD | {"type": "x"}]}, "no text": {"claims": [GOOD | {"text": "\u2003"}]},
    "no evidence": {"claims": [GOOD | {"evidence_quotes": []}]}, "evidence 0 is not": {"claims": [GOOD | {"evidence_quotes": [{"message_id": "m", "quote": "other words"}]}]}, "unknown message": {"claims": [GOOD | {"evidence_quotes": [{"message_id": "z", "quote": "quoted words"}]}]},
    "outside": {"claims": [GOOD | {"message_ids": ["n"]}]}, "audit must": {"audit": None}, "factual_confidence": {"audit": {"summary_grounded": True, "factual_confidence": 1.5}},
    # values of the wrong JSON type, which a cast would let pass
    "importance_score must": {"importance_score": "70"}, "summary must": {"summary": 5}, "must be a number": {"audit": {"summary_grounded": True, "factual_confidence": "0.9"}}, "an integer": {"importance_score": True}, "evidence 1 is not an object": {"claims": [GOOD | {"evidence_quotes": [*GOOD["evidence_quotes"], 3]}]},
}


def _validated(spark, answers, bodies=("m", "n")):
    import json

    df = spark.createDataFrame([(n, json.dumps(a)) for n, a in answers.items()], "thread_id string, answer string")
    messages = spark.createDataFrame([(n, m, "Some QUOTED  words") for n in answers for m in bodies], "thread_id string, message_id string, body string")
    return {r["thread_id"]: r for r in validate.validate_threads(df, messages).collect()}


BASE = {"category": "task", "importance_score": 5, "summary": "s", "claims": [GOOD], "audit": {"summary_grounded": True, "factual_confidence": 0.5, "notes": ["kept"]}, "importance_reasons": ["kept too"]}


def test_each_validation_rule(spark):
    import json

    out = _validated(spark, {"ok": BASE | {"thread_id": "ok"}} | {name: BASE | {"thread_id": name} | change for name, change in RULES.items()})
    assert out["ok"]["errors"] == [] and (out["ok"]["checked"], out["ok"]["valid"]) == (1, 1)
    whole = json.loads(out["ok"]["whole"])
    assert whole["audit"] == BASE["audit"] and whole["importance_reasons"] == ["kept too"] and whole["claims"] == [GOOD] and whole["validation"] == {"evidence_claims_checked": 1, "evidence_claims_valid": 1, "errors": []}
    assert set(whole["experience"]) == set(validate.EXPERIENCE_FIELDS.values())
    for name in RULES:
        assert any(name in e for e in out[name]["errors"]), (name, out[name]["errors"])
    assert out["thread_id mismatch"]["errors"] == ["thread_id mismatch: thread_id mismatch"] and out["thread_id mismatch"]["whole"] is None


def test_a_malformed_claim_spoils_only_itself(spark):
    wrong = [{"message_id": "m", "quote": "words nobody wrote"}] * 2
    out = _validated(spark, {"t": BASE | {"thread_id": "t", "claims": [7, GOOD, GOOD | {"claim_id": "d", "evidence_quotes": wrong}, GOOD | {"claim_id": 5, "message_ids": "m"}]}})["t"]
    assert (out["checked"], out["valid"]) == (4, 1)
    assert out["errors"] == ["t: claim 0 is not an object", "t: claim 2 evidence 0 is not in the message", "t: claim 2 evidence 1 is not in the message", "t: claim 3 has evidence outside its message_ids"]


def test_answers_that_are_no_answers(spark):
    df = spark.createDataFrame([("a", None), ("b", "no json"), ("c", "[1]")], "thread_id string, answer string")
    out = validate.validate_threads(df, spark.createDataFrame([], "thread_id string, message_id string, body string")).collect()
    assert {(r["same_thread"], r["whole"], r["valid"]) for r in out} == {(False, None, 0)}


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, False, "y"), ("b", 1, False, "p"), ("b", 2, False, "q")], "k string, seq long, j boolean, v string")
    assert {r["v"] for r in merge.latest_by_key(df, ["k"], [F.col("seq")]).collect()} == {"y", "q"}
    assert {r["v"] for r in merge.with_precedence(df, ["k"], F.col("j"), [F.col("seq")]).collect()} == {"x", "q"}


def test_participants_last_name_counts(spark):
    df = spark.createDataFrame([("t", 1, [("A", "x@y"), ("B", "z@y")]), ("t", 2, [("C", "X@y"), ("", "")])], "t string, o long, p array<struct<name:string,address:string>>")
    got = threads.participants(df, "t", "o", "p").first()["participants"]
    assert [tuple(x) for x in got] == [("C", "X@y"), ("B", "z@y")]


def test_ranking(spark):
    rows = [("auto", "bot@x", "[]", 0, "2024-03-01"), ("multi", "a@x", "[]", 0, "2024-02-01"), ("multi", "b@x", "[]", 0, "2024-02-02"), ("owner", "Me@X", "[]", 0, "2020-01-01")]
    m = spark.createDataFrame(rows, "conversation_id string, sender_address string, to_recipients_json string, has_attachments int, received_at_utc string").withColumn("sent_at_utc", F.lit(None).cast("string"))
    assert [r["thread_id"] for r in threads.rank_threads(m, owner="me@x").collect()] == ["owner", "multi", "auto"]
    assert [r["thread_id"] for r in threads.rank_threads(m, limit=1).collect()] == ["multi"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 120), max_size=40), st.integers(1, 9))
def test_next_batch_start(sizes, most):
    import numpy as np

    sizes = [min(s, 100) for s in sizes]
    nxt, at, starts = batches._next(np.array(sizes, np.int64), most, 100), 0, []
    while at < len(sizes):
        starts.append(at)
        at = int(nxt[at])
    want = plain_batches(sizes, most, 100)
    assert starts == [k for k in range(len(sizes)) if k == 0 or want[k] != want[k - 1]]


def test_references_without_semicolon():
    # as browsers and html.parser read them; the SQL of html_to_text only knows references that end in a semicolon
    assert html.clean_body("<title>a &amp;&amp;&amp</title>", "html") == "a &&&" and html.clean_body("<p>&copy 1 &lt</p>") == "© 1 <"
