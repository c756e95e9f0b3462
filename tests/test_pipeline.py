"""End to end: import, ranking, analysis with a scripted provider, reports."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from mailloom.cli import main
from mailloom.operators import provider as P
from mailloom.operators import reports
from mailloom.plans.analyze import analyze
from mailloom.plans.ingest import ingest
from mailloom.sources.readers import parse_files, read_files
from mailloom.sources.store import Store


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def put_csv(path, rows):
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        w = csv.DictWriter(f, list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return str(path)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store")).init()


GRAPH = {
    "id": "g1", "conversationId": "t1", "sentDateTime": "2024-01-01T00:00:00Z", "from": {"emailAddress": {"name": "Ann", "address": "ann@x.org"}},
    "toRecipients": [{"emailAddress": {"name": "Bob", "address": "bob@x.org"}}], "subject": " Hi ", "hasAttachments": False, "isRead": True,
    "body": {"contentType": "html", "content": "<p>Hello &amp; welcome</p><script>x()</script><a href='http://e.org'>link</a>"},
}


def test_graph_page(store, tmp_path):
    put(tmp_path / "p.json", json.dumps(json.dumps({"value": [GRAPH]})))
    got = ingest(store, [str(tmp_path / "p.json")])
    assert (got["files_imported"], got["messages_imported"], got["files_failed"]) == (1, 1, 0)
    m = store.table("messages").first()
    assert m["body"] == GRAPH["body"]["content"] and m["subject"] == "Hi" and m["sender_address"] == "ann@x.org"
    assert m["clean_body"] == "Hello & welcome\nlink <http://e.org>"
    assert json.loads(m["to_recipients_json"]) == [{"name": "Bob", "address": "bob@x.org"}] and (m["has_attachments"], m["is_read"]) == (0, 1)
    assert reports.store_stats(store.table("messages"), store.table("sources"), store.analyses()).first().asDict() == {"messages": 1, "threads": 1, "sources": 1, "verified_threads": 0}


def test_csv_flags_skip_and_bad_files(store, tmp_path):
    put_csv(tmp_path / "a.csv", [{"email_id": "c1", "conversation_id": "t", "body": "one\ntwo \"q\"", "body_type": "text", "has_attachments": "False", "is_read": "True"}])
    put(tmp_path / "bad.json", "[1]")
    got = ingest(store, [str(tmp_path)])
    assert (got["files_total"], got["files_imported"], got["files_failed"]) == (2, 1, 1) and got["errors"][0]["path"].endswith("bad.json")
    m = store.table("messages").first()
    assert (m["has_attachments"], m["is_read"], m["body"]) == (0, 1, 'one\ntwo "q"')
    again = ingest(store, [str(tmp_path)])
    assert (again["files_skipped"], again["files_failed"]) == (1, 1)
    assert ingest(store, [str(tmp_path / "a.csv")], force=True)["files_imported"] == 1
    with pytest.raises(FileNotFoundError):
        ingest(store, [put(tmp_path / "x.txt", "")])


def test_changed_source_drops_messages_and_shared_ones_stay(store, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    put(a, [{"id": "1", "body": "x"}, {"id": "2", "body": "y"}])
    put(b, [{"id": "2", "body": "z"}])
    ingest(store, [str(a), str(b)])
    put(a, [{"id": "1", "body": "x2"}])
    ingest(store, [str(a), str(b)])
    assert {(r["email_id"], r["body"]) for r in store.table("messages").collect()} == {("1", "x2"), ("2", "z")}
    put(b, [])
    ingest(store, [str(b)])
    assert [r["email_id"] for r in store.table("messages").collect()] == ["1"]


@pytest.mark.parametrize("together", [True, False])
def test_csv_never_replaces_json(store, tmp_path, together):
    j = put(tmp_path / "a.json", [{"id": "s", "body": "json"}])
    c = put_csv(tmp_path / "b.csv", [{"email_id": "s", "conversation_id": "t", "body": "csv", "body_type": "text"}])
    for paths in [[j, c]] if together else [[j], [c], [c]]:
        ingest(store, paths, force=True)
    assert [r["body"] for r in store.table("messages").collect()] == ["json"]
    assert store.table("links").count() == 2


def two_messages(store, tmp_path, extra=()):
    base = {"conversationId": "thread-1", "from": {"emailAddress": {"name": "Me", "address": "me@x.org"}}}
    put(tmp_path / "m.json", [base | {"id": "m1", "sentDateTime": "2024-01-01", "subject": "S", "body": "We decided to use option B."}, base | {"id": "m2", "sentDateTime": "2024-01-02", "body": "Option B succeeded in tests."}, *extra])
    ingest(store, [str(tmp_path / "m.json")])


def scripted(quote="use option B", more=False, **change):
    def answer(phase, payload):
        out = []
        for t in payload["threads"]:
            one = {"thread_id": t["thread_id"], "category": "decision", "importance_score": 90, "summary": "Option B.", "needs_more_context": more, "claims": [
                {"claim_id": "c1", "type": "decision", "text": "B was chosen", "message_ids": ["m1"], "evidence_quotes": [{"message_id": "m1", "quote": quote}], "confidence": 1},
                {"claim_id": "c2", "type": "outcome", "text": "B worked", "message_ids": ["m2"], "evidence_quotes": [{"message_id": "m2", "quote": "OPTION  b succeeded"}], "confidence": 1}]}
            if phase == "verification":
                one["audit"] = {"summary_grounded": True, "factual_confidence": 0.9}
            out.append(one | change)
        return {"threads": out}

    return P.OfflineProvider(answer)


def test_full_analysis(store, tmp_path):
    two_messages(store, tmp_path)
    p = scripted()
    assert analyze(store, "me@x.org", call=p)["verified"] == 1
    assert len(p.asked) == 2 and all(r.tools == () for r in p.asked)
    a = store.analyses().first()
    v = json.loads(a["verified_json"])
    assert (a["importance_score"], a["factual_confidence"]) == (90, 0.9) and [c["claim_id"] for c in v["experience"]["decisions"]] == ["c1"] and len(v["experience"]) == 10
    r = reports.quality_report(store.analyses(), store.table("runs")).first()
    assert (r["evidence_claims_checked"], r["evidence_claims_valid"], r["evidence_pass_rate"], r["average_verifier_confidence"], r["high_importance_threads"], r["failed_agent_runs"]) == (2, 2, 1.0, 0.9, 1, 0)
    assert analyze(store, "me@x.org", call=p)["threads_considered"] == 0  # unchanged and verified
    assert analyze(store, "me@x.org", call=p, force=True)["verified"] == 1


@pytest.mark.parametrize(("p", "status"), [(scripted(more=True), "verified_with_gaps"), (scripted("words nobody wrote"), "partial"), (scripted(importance_score=150), "partial"), (scripted(thread_id="other"), "rejected"), (scripted(audit="bad"), "partial"), (scripted(importance_score="high"), "partial")])
def test_statuses(store, tmp_path, p, status):
    two_messages(store, tmp_path)
    assert analyze(store, "me@x.org", call=p)[status] == 1
    assert store.analyses().first()["status"] == status


def test_invented_quote_keeps_the_other_claim(store, tmp_path):
    two_messages(store, tmp_path)
    analyze(store, "me@x.org", call=scripted("words nobody wrote"))
    v = json.loads(store.analyses().first()["verified_json"])
    assert [c["claim_id"] for c in v["claims"]] == ["c2"] and v["validation"]["evidence_claims_checked"] == 2 and "not in the message" in v["validation"]["errors"][0]


def test_dry_run_oversized_and_failures(store, tmp_path):
    two_messages(store, tmp_path, [{"id": "big", "conversationId": "big", "body": "w " * 3000}])
    got = analyze(store, "me@x.org", dry_run=True, max_chars=3000)
    assert (got["threads_considered"], got["batches"], got["estimated_runs"], got["oversized"]) == (2, 1, 2, 1)
    assert store.table("runs").count() == 0
    with pytest.raises(ValueError):
        analyze(store, " ", dry_run=True)
    with pytest.raises(ValueError):
        analyze(store, "me", max_chars=10)

    def broken(request):
        return P.Reply("no json here")

    out = analyze(store, "me@x.org", call=broken, max_chars=3000)
    assert out["rejected"] == 1 and [r["status"] for r in store.analyses().collect()] == ["oversized"]
    assert {(r["phase"], r["status"]) for r in store.table("runs").collect()} == {("extraction", "finished"), ("pipeline", "failed")}


def test_calls_take_no_jobs_of_their_own(store, tmp_path):
    def jobs(n, again=0):
        rows = [{"email_id": f"{n}m{k}", "conversation_id": f"{n}t{k:03d}", "body": "some words to quote", "body_type": "text"} for k in range(n)]
        put_csv(tmp_path / f"{n}.csv", rows)
        ingest(store, [str(tmp_path / f"{n}.csv")])
        group = f"calls-{n}"
        store.spark.sparkContext.setJobGroup(group, group)
        out = analyze(store, "me@x.org", call=scripted("some words"), max_threads=1)
        made = len(store.spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert out["batches"] == n + again and out["partial"] == n + again  # the quotes are of other messages
        return made

    few, many = jobs(2), jobs(24, 2)
    assert many < few + 24  # a read and two logs for each of the 24 made 72 more
    runs = [r["phase"] for r in store.table("runs").collect()]
    assert runs.count("extraction") == runs.count("verification") == 28


def test_cli(store, tmp_path, spark, capsys):
    out = []
    put(tmp_path / "m.json", [{"id": "1", "body": "b"}])
    run = lambda *a: main(["--store", store.root, *a], spark=spark, write=out.append)
    assert [run("init"), run("ingest", str(tmp_path / "m.json")), run("stats"), run("report"), run("analyze", "--owner-email", "o", "--dry-run")] == [0] * 5
    assert json.loads(out[2])["messages"] == 1 and json.loads(out[4])["batches"] == 1
    assert run("models") == 1 and "error" in capsys.readouterr().err


def test_watch(store, tmp_path):
    from mailloom.streaming.watch import watch

    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.json", [{"id": "1", "body": "b"}])
    watch(store, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(60)
    assert store.table("messages").count() == 1


def bodies(store):
    return {r["email_id"]: r["body"] for r in store.table("messages").collect()}


@pytest.mark.parametrize("most", [0, 100_000])
def test_awkward_file_names(store, tmp_path, monkeypatch, most):
    monkeypatch.setattr("mailloom.plans.ingest.BROADCAST_FILES", most)
    names = ["a b.json", "c [1].json", "d{x}.json", "e*.json", "f%20g.json", "_h.json", ".i.json"]
    for n in names:
        put(tmp_path / n, [{"id": n, "body": n}])
    got = ingest(store, [str(tmp_path / n) for n in names])
    assert (got["files_imported"], got["files_failed"]) == (len(names), 0)
    assert bodies(store) == {n: n for n in names}
    assert {r["path"].rsplit("/", 1)[-1] for r in store.table("sources").collect()} == set(names)
    assert ingest(store, [str(tmp_path / n) for n in names])["files_skipped"] == len(names)


def test_hidden_files_need_a_folder(store, tmp_path):
    with pytest.raises(ValueError):
        read_files(store.spark, [put(tmp_path / "_a.json", [])])


def test_file_that_changes_while_read(store, tmp_path):
    path = put(tmp_path / "a.json", [{"id": "1", "body": "x"}])
    files = read_files(store.spark, [path])
    row = parse_files(files.withColumn("expected", F.lit("0" * 64))).first()
    assert "changed" in row["error"] and row["email_id"] is None
    assert parse_files(files.withColumn("expected", F.col("sha256"))).first()["error"] is None


def test_no_moment_without_a_commit(store, tmp_path):
    ingest(store, [put(tmp_path / "a.json", [{"id": "1", "body": "x"}])])
    v, commits = store.version(), tmp_path / "store" / "commits"
    (commits / "half.tmp").write_text("{")  # a writer that died before its rename
    assert Store(store.spark, store.root).init().version() == v and bodies(store) == {"1": "x"}
    (commits / f"{v + 1:010d}.commit").write_text((commits / f"{v:010d}.commit").read_text())
    store.version = lambda: v  # a writer that does not know of it
    with pytest.raises(RuntimeError):
        store.commit()


def test_unchanged_tables_are_named_again(store, tmp_path):
    ingest(store, [put(tmp_path / "a.json", [{"id": "1", "body": "x"}])])
    before = store._tables(store.version())
    store.commit(sources=store.table("sources"))
    after = store._tables(store.version())
    assert after["messages"] == before["messages"] and after["sources"] != before["sources"]
    assert store.vacuum(keep=1) > 0 and bodies(store) == {"1": "x"}
    assert store.vacuum(keep=1) == 0
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_changed_and_new_files_together_as_one_after_the_other(spark, tmp_path):
    """New, changed, shrunk and failing sources in one import give what importing each alone gives."""
    first = {
        "b.json": [{"id": "1", "body": "b1"}, {"id": "2", "body": "b2"}, {"id": "9", "body": "b9"}],
        "d.csv": [("2", "d2"), ("3", "d3"), ("9", "d9")],
        "f.json": [{"id": "4", "body": "f4"}],
        "h.json": [{"id": "8", "body": "h8"}],
    }
    then = {
        "a.csv": [("1", "a1"), ("3", "a3"), ("5", "a5")],
        "b.json": [{"id": "1", "body": "b1x"}],
        "c.json": [{"id": "3", "body": "c3"}, {"id": "6", "body": "c6"}, {"id": "6", "body": "c6 again"}],
        "d.csv": [("3", "d3x"), ("7", "d7"), ("9", "d9x")],
        "e.json": [{"id": "5", "body": "e5"}],
        "f.json": "[1]",
        "g.csv": [("6", "g6"), ("2", "g2")],
    }

    def write(folder, files):
        folder.mkdir(exist_ok=True)
        for name, rows in files.items():
            if name.endswith("csv"):
                put_csv(folder / name, [{"email_id": i, "conversation_id": "t", "body": b, "body_type": "text"} for i, b in rows])
            else:
                put(folder / name, rows)

    found = []
    for k, together in enumerate((True, False)):
        s, folder = Store(spark, str(tmp_path / f"s{k}")).init(), tmp_path / f"in{k}"
        write(folder, first)
        ingest(s, [str(folder)])
        write(folder, then)
        for paths in [[str(folder)]] if together else [[str(folder / n)] for n in sorted(then)]:
            ingest(s, paths)
        name = {r["source_file_id"]: r["path"].rsplit("/", 1)[-1] for r in s.table("sources").collect()}
        found.append((bodies(s), sorted((r["email_id"], name[r["source_file_id"]], r["source_index"]) for r in s.table("links").collect())))
    assert found[0] == found[1]
    assert found[0][0]["4"] == "f4" and found[0][0]["8"] == "h8" and found[0][0]["6"] == "c6 again"
