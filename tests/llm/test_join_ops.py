"""Jaccard join, span dedup, top-k, URL filter, mixing, packing, components, the pipeline."""

import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from mailloom.llm import bin_packing, jaccard_join, source_mix, suffix_dedup, topk_index, url_filter
from mailloom.llm.components import connected_components

from .helpers import DOCS, awkward, awkward_rows, plain_classes, plain_spans, prose

IDS = [(i, t) for i, t, *_ in awkward_rows() if i is not None]


def near_copies(seed=0):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(g, r.choice([4, 7, 30, 120, 400])).split()
        for _ in range(r.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = f"x{r.random()}"
            rows.append((len(rows), r.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("block", [4, 128])
def test_jaccard_links_against_all_pairs(spark, block):
    rows = near_copies() + [(1000 + i, t) for i, t in IDS]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), jaccard_join.JoinSettings(block=block)).collect()
    assert {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in got} == plain_classes(rows)


def test_boilerplate_makes_no_pairs(spark):
    """Pages of one template are one component of the ties; their own words part them, and every link stays."""
    r = random.Random(5)
    rows, page, more = [], prose(77, 130), prose(78, 60)
    for k in range(400):
        own = " ".join(f"w{r.randrange(10**9)}" for _ in range(60))
        rows.append((k, f"{page} {own} {more}" if k % 2 else f"{page} {own}"))
    for k in range(20):
        rows.append((2000 + k, rows[19 * k][1].replace(" the ", " a ", 1) + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    s = jaccard_join.JoinSettings()
    sketch = jaccard_join._sketch(docs, s)
    wide = connected_components(jaccard_join._ties(sketch, s))
    largest = max(x["count"] for x in wide.groupBy("root").count().collect())
    assert largest > 200
    sets = {i: jaccard_join.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for i, t in rows}
    held = wide.collect()
    flat = spark.createDataFrame([(x["root"], x["node"], bytearray(np.unique(sets[x["node"]]).tobytes())) for x in held], "root long, doc_id long, shingles binary")
    groups = defaultdict(set)
    for x in jaccard_join.finer_groups(flat, s).collect():
        groups[x["root"]].add(x["node"])
    assert sum(len(g) ** 2 for g in groups.values()) < 40 * len(rows)
    want = plain_classes(rows)
    linked = defaultdict(set)
    for i, (_, c, n) in want.items():
        if n:
            linked[c].add(i)
    assert len(linked) == 20 and all(any(g <= h for h in groups.values()) for g in linked.values())
    got = jaccard_join.jaccard_classes(docs).collect()
    assert {x["doc_id"]: (x["text_id"], x["class_id"], x["n_links"]) for x in got} == want


def test_jaccard_by_shuffle_and_awkward(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    docs = awkward(spark)
    got = jaccard_join.jaccard_classes(docs).collect()
    assert len(got) == docs.count()
    want = plain_classes(IDS)
    assert {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None} == want
    twice = jaccard_join.jaccard_classes(docs.unionByName(docs)).where("doc_id is not null").distinct().collect()
    assert {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in twice} == want
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    s = jaccard_join.JoinSettings()
    least = jaccard_join.least_agreement(s)
    assert least[-1][0] == s.values and [m for _, m in least] == sorted(m for _, m in least)
    r = np.random.default_rng(1)
    agree = r.random((20000, s.values)) < s.threshold
    lost = np.zeros(20000, bool)
    for n, m in least:
        lost |= agree[:, :n].sum(1) < m
    assert lost.mean() < 1e-3
    far = r.random((20000, s.values)) < 0.4
    assert all((far[:, :n].sum(1) >= m).mean() < 1e-3 for n, m in least[-2:])


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(40)] + [(300, 300)] + [(r.randrange(400, 460), r.randrange(400, 460)) for _ in range(40)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_cover_order_sorts_as_deep_as_asked(symbols, depth):
    s = np.array([x + 1 for x in symbols] + [0] * (depth + 3), np.int64)
    rank = suffix_dedup.cover_order(s, depth)
    assert sorted(rank) == list(range(len(s)))
    order = np.argsort(rank)
    prefixes = [tuple(s[i : i + depth]) for i in order]
    full = [p + (0,) * (depth - len(p)) for p in prefixes]
    assert full == sorted(full)


def repeats(seed):
    r = random.Random(seed)
    shared = [prose(900 + k, 20) for k in range(4)] + ["ab" * 60, "é" * 40, "x" * 49, "y" * 50]
    rows = []
    for k in range(60):
        parts = [r.choice([prose(r.randrange(10**6), r.randrange(1, 30)), r.choice(shared), r.choice(shared)[r.randrange(5) :]]) for _ in range(r.randrange(6))]
        rows.append((k * 3 % 61, " ".join(parts)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_spans_against_every_string(spark, small):
    rows = repeats(1) + [(100 + i, t) for i, t in IDS]
    s = suffix_dedup.SpanSettings(chunk_bytes=4000, cache_bytes=700, bucket_bytes=9000, sort_bytes=2000, broadcast_bytes=0, hot_regions=3) if small else suffix_dedup.SpanSettings()
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), s, with_text=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_spans(rows)
    assert all(r["text"] is not None for r in got)


def test_a_phrase_in_countless_contexts(spark):
    """One 30-byte phrase, every time in another context, some contexts twice: spread over parts, the same result."""
    r = random.Random(8)
    context = lambda: "".join(r.choice("abcdefgh") for _ in range(24))
    some = [context() + "AAAAAAAAAA the phrase AAAAAAAA" + context() for _ in range(600)]
    rows = [(k, r.choice(some) if k % 4 == 0 else context() + "AAAAAAAAAA the phrase AAAAAAAA" + context()) for k in range(2400)]
    s = suffix_dedup.SpanSettings(hot_regions=100, bucket_bytes=1 << 20, chunk_bytes=20_000)
    want = plain_spans(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.repeated_spans(df, s).collect()} == want and sum(v[1] for v in want.values())

    # a chunk's windows of the hot fingerprint lie in many parts, equal ones in one
    buf = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    regions = suffix_dedup.Regions(buf, off, s)
    codes, at, _ = regions.codes(8)
    hot = int(np.argmax(np.bincount(at)))
    flags = {int(b): (np.packbits(np.ones(hi - lo, bool)).tobytes(), np.array([[hot - lo, 50]] if lo <= hot < hi else [], np.uint32).tobytes()) for b, lo, hi in zip(*suffix_dedup._split(codes >> np.uint64(32)), strict=True)}
    got = suffix_dedup.Shared(np.arange(len(rows)), off, buf, flags, 8, s)
    parts = got.bucket[got.bucket >> suffix_dedup.PART > 0]
    assert len(np.unique(parts)) == 50 and np.bincount(np.unique(parts, return_inverse=True)[1]).max() < 3 * len(parts) / 50
    windows = [buf[a : a + 50].tobytes() for a in got.first[got.lead][got.bucket >> suffix_dedup.PART > 0]]
    assert len(windows) == len(set(windows))


def test_the_greatest_id_is_an_id(spark):
    top = (1 << 63) - 1
    rows = [(top, "z" * 60), (None, "y" * 60), (5, "z" * 60)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {top: 60, None: 0, 5: 0}


def test_spans_read_a_few_chunks_at_a_time(spark):
    from mailloom.llm.common import BATCH_BYTES, small_batches

    size = 1 << 20
    small_batches(spark)
    docs = spark.range(40).selectExpr("id as doc_id", f"repeat(cast(id % 10 as string), {size}) as text").coalesce(1)
    chunks = suffix_dedup._chunks(docs, suffix_dedup.SpanSettings(chunk_bytes=size), ())
    file = chunks.inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in file]
    assert max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) <= suffix_dedup.GROUP

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(x) for x in b.column(0).to_pylist())])})

    got = [r["n"] for r in chunks.select("data").mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 40 * size and max(got) <= BATCH_BYTES + size


def test_spans_are_judged_in_little_memory():
    import tracemalloc

    s = suffix_dedup.SpanSettings()
    r = np.random.default_rng(5)
    entries = 120_000
    count = np.full(entries, 32, np.int64)
    text = r.integers(97, 123, (entries // 2, s.span + 31), dtype=np.uint8)
    data, key = np.concatenate([text, text]).ravel(), np.tile(np.arange(entries // 2, dtype=np.uint64), 2)
    owner = np.arange(entries)
    tracemalloc.start()
    state, mask = suffix_dedup.judged(data, count, key, owner, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 3.8 million windows: one array of their numbers has 31 MB, and all of them at once took 117
    assert not state[: entries // 2].any() and (state[entries // 2 :] == 1).all() and peak < 80e6
    assert (mask[entries // 2 :] == (1 << 32) - 1).all()


def phrases(regions, windows):
    """Regions of one 26-byte phrase, all in different contexts: bytes, counts, keys."""
    text = np.random.default_rng(5).integers(97, 107, (regions, windows + 49), dtype=np.uint8)
    text[:, windows - 1 : windows + 25] = np.frombuffer(b"the phrase of all of them.", np.uint8)
    return text, np.full(regions, windows, np.int64), np.zeros(regions, np.uint64)


def test_many_contexts_of_one_phrase_are_sorted_in_little_memory():
    import tracemalloc

    s = suffix_dedup.SpanSettings()
    text, count, key = phrases(s.hot_regions, 25)
    text[1::2, -25:] = text[::2, -25:]  # every other region shares its last window with the one before, and no more
    text[::2, 23], text[1::2, 23] = ord("x"), ord("y")
    tracemalloc.start()
    state, mask = suffix_dedup.judged(text.ravel(), count, key, np.arange(len(count)), s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 1.5 million symbols that must be sorted together took 187 MB, at each of an executor's workers
    assert peak < 90e6
    assert not state[::2].any() and (state[1::2] == 2).all() and (mask[1::2] == 1 << 24).all()


def test_parts_of_a_hot_phrase_are_small(spark, monkeypatch):
    s = suffix_dedup.SpanSettings(hot_regions=100, bucket_bytes=1 << 20, chunk_bytes=20_000)
    text, _, _ = phrases(1000, 25)
    some = np.random.default_rng(6).integers(97, 123, (5000, 26), dtype=np.uint8)
    text[:, 24:50] = some[np.argmin([suffix_dedup.Prefix(x).fixed(26)[0] for x in some])]  # which the screen picks in nearly every window
    rows = [(k, bytes(x).decode()) for k, x in enumerate(text)]
    heard = []
    plan = suffix_dedup._by_bucket

    def listening(sent, answer, schema):
        if "keys" in sent.columns:
            heard.extend(sent.selectExpr("bucket", "length(keys) div 8 as n").groupBy("bucket").sum("n").collect())
        return plan(sent, answer, schema)

    monkeypatch.setattr(suffix_dedup, "_by_bucket", listening)
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), s)
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got.collect()} == plain_spans(rows)
    parts = [n for b, n in heard if b >> suffix_dedup.PART]
    # 25000 windows, or nearly: ten parts of 2500 before
    assert sum(parts) > 20_000 and len(parts) >= 70 and max(parts) < 600


def test_chunks_and_messages_are_read_in_small_batches(spark):
    docs = spark.range(8).selectExpr("id as doc_id", "repeat(cast(id as string), 3000000) as text")
    got = suffix_dedup.repeated_spans(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    assert [r["n_removed"] for r in got.collect()] == [0] * 8


def test_spans_awkward(spark):
    docs = awkward(spark)
    got = suffix_dedup.repeated_spans(docs, with_text=True, keep=("lang", "score")).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {"clash"}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == plain_spans(IDS)
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffix_dedup.repeated_spans(same).collect()] == [0, 0]


def vectors(seed, n, dims):
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in r.normal(0, 0.2, dims)]) for k in range(n)]
    rows += [(n + k, rows[k % 5][1]) for k in range(20)]  # ties
    return rows + [(900, None), (901, []), (902, [float("nan")] * dims), (903, [None] + [0.0] * (dims - 1)), (904, [float("inf")] + [0.0] * (dims - 1)), (1000, [0.5] * (dims + 1)), (1100, [0.0] * dims), (1200, [-7.25] * dims)]


@pytest.mark.parametrize(("k", "block"), [(10, 16384), (3, 40)])
def test_top_k_against_all_products(spark, k, block):
    rows = vectors(3, 160, 9)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")
    ask = df.where("vec_id % 100 = 0")
    got = defaultdict(list)
    for r in sorted(topk_index.exact_top_k(df.repartition(3), ask, k=k, block_rows=block, query_rows=2).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for i in [i for i in q if i % 100 == 0]:
        want = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i])))[:k]
        assert got.pop(i, []) == [(j, -s) for s, j in want], i
    assert not got
    assert topk_index.exact_top_k(df.limit(0), ask.limit(0)).count() == 0


RULES = [url_filter.UrlRule("block", "net/"), url_filter.UrlRule("allow", "example.net/en/"), url_filter.UrlRule("block", "example.com/de/"), url_filter.UrlRule("allow", "org/fr/")]


def test_url_rules(spark):
    urls = ["HTTP://A.Example.NET/en/1?x#y", "http://example.net/de/1", "http://notnet/en/", "http://x.net", "http://x.net?/", "http://example.com/de/2", "http://myexample.com/de/2", "http://b.org/fr/", "http://b.org/FR/", None, "", "no scheme/net/", "a://É.NET/", "x://h/p://q/"]
    rows = [(k, u, "clash") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(url_filter.judge_urls(pages, labels, RULES).collect(), key=lambda r: r["page_id"])]
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/1", "net/", "block"), ("notnet", "/en/", None, "allow"), ("x.net", "", None, "allow"), ("x.net", "", None, "allow"), ("example.com", "/de/2", "example.com/de/", "block"),
        ("myexample.com", "/de/2", None, "allow"), ("b.org", "/fr/", "org/fr/", "allow"), ("b.org", "/FR/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("É.net", "/", "net/", "block"), ("h", "/p://q/", None, "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), labels, RULES).count() == 0


def test_url_templates(spark):
    rows, labels = [], []
    for k in range(60):
        for host, path, bad in (("h.com", f"/spam/{k}", 1), ("h.com", f"/news/{k}.html", 0), ("h.com", f"/blog/{k}.html", 0), ("h.com", f"/tag/word{chr(97 + k % 26)}x/{k}", k % 2)):
            rows.append((len(rows), f"http://{host}{path}"))
            labels.append((rows[-1][0], bad))
    rows += [(999, "http://h.com/spam/new-but-unlabelled"), (998, "http://other.com/spam/1"), (997, "http://deep.com/" + "a/" * 40)]
    df = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), RULES, url_filter.TemplateSettings(reject=0.8))
    got = {r["page_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    # the variable segment is a wildcard, like branches are one, and only the bad template is rejected
    assert got[0]["template"] == "/spam/{}" and got[1]["template"] == got[2]["template"] == "/(blog|+1)/{}.html"
    assert got[3]["template"].startswith("/tag/*/") and {got[k]["verdict"] for k in (1, 2, 3, 998, 997)} == {"allow"} and got[0]["verdict"] == "block"
    # smoothed purity, by hand
    prior = sum(b for _, b in labels) / len(labels)
    assert got[0]["bad_share"] == pytest.approx((60 + 8 * prior) / 68, abs=1e-8)
    assert got[1]["bad_share"] == pytest.approx(8 * prior / 128, abs=1e-8)


def test_a_bad_section_among_many(spark):
    sections = ["news", "sports", "about", "casino", "games", "travel", "food", "music", "film", "books"]
    rows = [(100 * i + k, f"http://h.com/{x}/{k}") for i, x in enumerate(sections) for k in range(40)]
    labels = [(p, int("casino" in u)) for p, u in rows if p % 100 < 30]
    df = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), [])
    got = {r["page_id"]: r for r in df.collect()}
    assert len(got) == 400 and all((r["verdict"] == "block") == (r["path"].startswith("/casino/")) for r in got.values())
    assert {r["template"] for r in got.values()} == {"/casino/{}", "/(about|+8)/{}"}
    # by hand: 30 of 300 labelled pages are bad
    assert got[300]["bad_share"] == pytest.approx(30.8 / 38, abs=1e-8) and got[0]["bad_share"] == pytest.approx(0.8 / 278, abs=1e-8)


def plain_templates(rows, s, prior):
    """rows: {path: (labelled, bad)} of one host. {path: (template, share of bad pages)}, node by node."""
    import itertools

    ident = r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}"
    normal = lambda p: re.sub(rf"(?<=/)([0-9]+|{ident}|(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{{12,}})(?=/|$|\.[a-zA-Z]{{1,5}}$)", "{}", p)

    def shape(x):
        cut = re.sub(rf"{ident}|(?<![a-zA-Z0-9])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{{12,}}(?![a-zA-Z0-9])|[0-9]+", "{}", x)
        return cut if "{}" in cut else "*" + (re.search(r"(\.[a-zA-Z]{1,5})?$", x)[0] if x else "")

    def share(bad, n):
        x = min(max((bad + s.prior_pages * prior) / (n + s.prior_pages), 0), 1)
        return x, x * (1 - x) / (n + s.prior_pages)

    def differs(own, group, count):
        bad, n = sum(g[1] for g in group) - own[1], sum(g[0] for g in group) - own[0]
        (a, u), (b, v) = share(own[1], own[0]), share(bad, n)
        return own[0] >= s.prior_pages and abs(a - b) > ((s.z**2 + 2 * math.log(count)) * (u + v)) ** 0.5

    paths = {}
    for p, (n, bad) in rows.items():
        old = paths.get(normal(p), (0, 0))
        paths[normal(p)] = (old[0] + n, old[1] + bad)
    template = {}

    def node(prefix, members):
        whole = [g for g in zip(*(m for m, _ in members), strict=False)]
        common = len(list(itertools.takewhile(lambda g: len(set(g)) == 1, whole)))
        prefix += "".join("/" + x for x in members[0][0][:common])
        members = [(m[common:], p) for m, p in members]
        for _, p in (x for x in members if not x[0]):
            template[p] = prefix
        members = [x for x in members if x[0]]
        if not members:
            return
        child = {}
        for m, p in members:
            child.setdefault(m[0], []).append((paths[p], shape(m[1]) if len(m) > 1 else ""))
        total = {c: (sum(x[0][0] for x in v), sum(x[0][1] for x in v)) for c, v in child.items()}
        ahead = {c: (min(x[1] for x in v), max(x[1] for x in v)) for c, v in child.items()}
        name = {c: c for c in child}
        for wild in (shape, lambda _: "*"):
            for w in {wild(c) for c in child}:
                own = [c for c in child if wild(c) == w]
                fan = len({name[c] for c in own})
                if fan >= s.fan:
                    name |= {c: w for c in own if not differs(total[c], [total[x] for x in own], fan)}
        few = {}
        for c in child:
            few.setdefault(name[c], []).append(c)
        stats = {f: (sum(total[c][0] for c in cs), sum(total[c][1] for c in cs)) for f, cs in few.items()}
        edge = {f: (min(ahead[c][0] for c in cs), max(ahead[c][1] for c in cs)) for f, cs in few.items()}
        branch = {}
        for e in set(edge.values()):
            line = sorted((f for f in few if edge[f] == e), key=lambda f: (share(stats[f][1], stats[f][0])[0], f))
            groups = []
            for f in line:
                (x, v), (y, u) = share(stats[f][1], stats[f][0]), share(*reversed(stats[groups[-1][-1]])) if groups else (0, 0)
                if not groups or x - y > s.z * (u + v) ** 0.5:
                    groups.append([])
                groups[-1].append(f)
            for g in groups:
                alone = [f for f in g if len(g) > 1 and differs(stats[f], [stats[x] for x in g], len(g))]
                rest = sorted(f for f in g if f not in alone)
                branch |= {f: f for f in alone} | {f: f"({rest[0]}|+{len(rest) - 1})" if len(rest) > 1 else f for f in rest}
        below = {}
        for m, p in members:
            below.setdefault(branch[name[m[0]]], []).append((m[1:], p))
        for b, ms in below.items():
            node(f"{prefix}/{b}", ms)

    node("", [(p[1:].split("/") if p.startswith("/") else [], p) for p in paths])
    total = {}
    for p, t in template.items():
        old = total.get(t, (0, 0))
        total[t] = (old[0] + paths[p][0], old[1] + paths[p][1])
    return {p: (template[normal(p)], share(total[template[normal(p)]][1], total[template[normal(p)]][0])[0]) for p in rows}


def test_templates_against_a_plain_tree(spark):
    r = random.Random(1)
    bits = ["news", "de", "blog", "x7", "a12b", "42", "p.html", "shop", "casino", "tag-3", "0123456789abcdef", "", "über", "9.php"]
    urls = ["/" + "/".join(r.choice(bits) for _ in range(r.choice([1, 1, 2, 2, 3]))) for _ in range(500)] + [f"/wide/w{chr(97 + k)}/{k % 5}" for k in range(20)] + [f"/ids/{chr(97 + k)}{k}z" for k in range(20)]
    urls += ["/deep" + "/d" * 40, "/deep" + "/d" * 39 + "/e", "/deep" + "/d" * 20, "", "/"]
    rows = [(k, f"http://h.com{u}") for k, u in enumerate(urls)]
    labels = [(k, int(r.random() < (0.9 if "casino" in u or "/42" in u else 0.1))) for k, u in enumerate(urls) if r.random() < 0.8]
    s = url_filter.TemplateSettings()
    got = {x["page_id"]: x for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), [], s).collect()}
    prior, bad, counts = sum(b for _, b in labels) / len(labels), dict(labels), {}
    for k, u in enumerate(urls):
        n, b = counts.get(u, (0, 0))
        counts[u] = (n + (k in bad), b + bad.get(k, 0))
    want = plain_templates(counts, s, prior)
    for k, u in enumerate(urls):
        assert got[k]["template"] == want[u][0], (u, got[k], want[u])
        assert got[k]["bad_share"] == pytest.approx(want[u][1], abs=1e-8)
    assert {x["verdict"] for x in got.values()} == {"allow", "block"}


def test_url_awkward(spark):
    """Labels given twice count with their mean; pages without a url share a template and a label; repeated pages stay."""
    rows = [(1, None), (2, "no scheme"), (3, "http://h.com/a/1"), (3, "http://h.com/a/1"), (4, "http://h.com/a/2"), (None, "http://h.com/a/3")]
    labels = [(1, 1), (1, 0), (3, 1), (3, 1), (None, 1), (4, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), []).collect()
    assert len(got) == len(rows)
    # pages 1, 3 and its repetition are labelled: 0.5, 1 and 1; two of them and an unlabelled one below /a/{}
    prior = 2.5 / 3
    shares = {r["page_id"]: r["bad_share"] for r in got}
    assert shares[1] == shares[2] == pytest.approx((0.5 + 8 * prior) / 9, abs=1e-8) and shares[3] == shares[4] == shares[None] == pytest.approx((2 + 8 * prior) / 10, abs=1e-8)


def test_a_host_worse_than_most_is_rejected(spark):
    """Against a share of one bad page in ten, four in ten among many pages are enough."""
    rows = [(k, f"http://{'h' if k % 10 else 'g'}.com/{'x' if k % 10 else 'y'}/{k}") for k in range(3000)]
    labels = [(k, int(k % 10 == 0 and k % 50 < 20 or k % 10 > 0 and k % 13 == 0)) for k, _ in rows]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), []).collect()
    assert all((r["verdict"] == "block") == (r["host"] == "g.com") and r["bad_share"] < 0.5 for r in got)


def test_raking_meets_the_targets(spark):
    r = random.Random(3)
    rows = [(k, prose(k, r.randrange(1, 60)) + r.choice(["", " @x", " | y"]), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", None]), 1) for k in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    s = source_mix.MixSettings(sweeps=30, targets={"lang": {"en": 0.4, "de": 0.35, "(none)": 0.25}})
    cells = source_mix._dims(docs, s).groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum(source_mix.token_count(F.col("text"))).alias("tokens"))
    raked = source_mix.rake(cells, s).collect()
    total = sum(c["tokens"] for c in raked)
    for lang, share in s.targets["lang"].items():
        assert sum(c["weight"] for c in raked if c["lang"] == lang) / total == pytest.approx(share, abs=1e-6)
    own = {x: sum(c["tokens"] for c in raked if c["source"] == x) / total for x in ("a", "b", "(none)")}
    norm = sum(v**0.8 for v in own.values())
    for x, v in own.items():
        assert sum(c["weight"] for c in raked if c["source"] == x) / total == pytest.approx(v**0.8 / norm, abs=1e-4)
    out = source_mix.mix_sources(docs, s).collect()
    assert len(out) == 900
    spent = sum(r["n_tokens"] * r["probability"] for r in out) / total
    assert spent == pytest.approx(s.budget, abs=1e-3) and all(0 <= r["probability"] <= 1 for r in out)
    assert sum(r["n_tokens"] for r in out if r["drawn"]) / total == pytest.approx(s.budget, abs=0.06)


def expected_margins(rows):
    """Shares of the expected sample by dimension and value, and its share of all tokens."""
    spent = sum(r["n_tokens"] * r["probability"] for r in rows)
    got = defaultdict(float)
    for r in rows:
        for d in source_mix.DIMS:
            got[d, r[d] or "(none)"] += r["n_tokens"] * r["probability"] / spent
    return got, spent / sum(r["n_tokens"] for r in rows)


def wanted_margins(rows, s):
    """The tempered shares, of plain counts."""
    own = defaultdict(lambda: defaultdict(int))
    for r in rows:
        for d in source_mix.DIMS:
            own[d][r[d] or "(none)"] += r["n_tokens"]
    want = {}
    for d, values in own.items():
        powers = {v: (n / sum(values.values())) ** s.tempering[d] for v, n in values.items()}
        want |= {(d, v): p / sum(powers.values()) for v, p in powers.items()}
    return want


@pytest.mark.parametrize("budget", [0.7, 0.9])
def test_the_expected_sample_meets_the_targets(spark, budget):
    # a source with a third of all tokens, rare topics and languages: cells are drawn whole
    r = random.Random(8)
    rows = [
        (k, prose(k, 40) + r.choice([""] * 9 + [" @x", " | y"]), r.choice(["en"] * 6 + ["de", "es", None]), "hot" if k % 3 == 0 else f"s{r.randrange(6)}", 1)
        for k in range(900)
    ] + [(1000, "", "en", "s1", 1), (1001, None, "zz", "nothing", 1)]
    s = source_mix.MixSettings(budget=budget, bounded=True)
    out = source_mix.mix_sources(spark.createDataFrame(rows, DOCS), s).collect()
    got, spent = expected_margins(out)
    want = wanted_margins(out, s)
    assert len(out) == len(rows) and got == pytest.approx(want, abs=2e-6)
    own = {d: wanted_margins(out, source_mix.MixSettings(tempering=dict.fromkeys(source_mix.DIMS, 1.0)))[d] for d in want}
    assert spent == pytest.approx(min([budget] + [own[d] / want[d] for d in want if want[d]]), abs=1e-5)
    assert all(0 <= r["probability"] <= 1 for r in out) and any(r["probability"] == 1 for r in out)
    if budget == 0.9:
        docs = spark.createDataFrame(rows, DOCS)
        drawn = {r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, "").collect()}
        assert drawn == {r["doc_id"] for r in out if r["drawn"]}


def test_targets_out_of_reach_of_the_bounds_draw_less(spark):
    # each value can give its part of two thirds of the tokens, but en in b and a together only that of a half
    cells = [("en", "a")] * 9 + [("de", "a")] * 9 + [("en", "b")] * 3 + [("de", "b")] * 9
    rows = [(k, "w " * 30, *cells[k % 30], 1) for k in range(300)]
    s = source_mix.MixSettings(bounded=True, bounded_sweeps=12, targets={"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.6, "de": 0.4}})
    out = source_mix.mix_sources(spark.createDataFrame(rows, DOCS), s).collect()
    got, spent = expected_margins(out)
    assert [got[x] for x in (("source", "a"), ("lang", "en"))] == pytest.approx([0.4, 0.6], abs=1e-5) and 0.33 < spent <= 0.5 + 1e-6


def test_raking_goes_on_until_the_targets_are_met(spark):
    # nearly every text of a source is in one language, and one source has a third of the tokens
    cells = [(f"s{a}", f"l{l}", t, (100_000 if a == 0 else 10_000) * (990 if l == a % 4 else 3) * n) for a in range(20) for l in range(4) for t, n in (("prose", 9), ("listing", 1))]
    s = source_mix.MixSettings()
    raked = source_mix.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), s).collect()
    total = sum(c["tokens"] for c in raked)
    for d in source_mix.DIMS:
        own, have = defaultdict(int), defaultdict(float)
        for c in raked:
            own[c[d]] += c["tokens"]
            have[c[d]] += c["weight"] / total
        norm = sum((n / total) ** s.tempering[d] for n in own.values())
        assert have == pytest.approx({v: (n / total) ** s.tempering[d] / norm for v, n in own.items()}, abs=2e-6), d


def test_mix_awkward(spark, monkeypatch):
    docs = awkward(spark)
    got = source_mix.mix_sources(docs).collect()
    assert len(got) == docs.count() and {r["source"] for r in got} == {"a", "b", None} and all(isinstance(r["drawn"], bool) for r in got)
    monkeypatch.setattr(source_mix, "BROADCAST_CELLS", 0)
    assert sorted(map(repr, source_mix.mix_sources(docs).collect())) == sorted(map(repr, got))
    assert source_mix.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def plain_pack(lengths, s):
    """The same policy with a list of bins."""
    sizes, bins, where = sorted(s.capacities), [], {}
    left = sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        open_bins = [b for b in bins if b["size"] - b["used"] >= n]
        if open_bins:
            b = min(open_bins, key=lambda b: b["size"] - b["used"])
        else:
            costs = [((c + s.bin_cost) / (n + min(c - n, left - n, sum(x for x in lengths if x <= min(n, c - n)))), c) for c in sizes if c >= n]
            b = {"size": min(costs, key=lambda x: x[0])[1], "used": 0}
            bins.append(b)
        b["used"] += n
        left -= n
        where[i] = b
    return sum(min(c for c in sizes if c >= b["used"]) for b in bins), len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_packing_against_a_plain_one(lengths):
    s = bin_packing.PackSettings(capacities=(8, 16, 32, 64), bin_cost=1)
    bins, place, capacity = bin_packing.pack(np.array(lengths), s)
    used = defaultdict(list)
    for b, p, n, c in zip(bins, place, lengths, capacity, strict=True):
        used[b].append((p, n, c))
    for parts in used.values():
        at = 0
        for p, n, _ in sorted(parts):
            assert p == at
            at += n
        assert {c for *_, c in parts} == {min(c for c in s.capacities if c >= at)}
    assert (sum(x[0][2] for x in used.values()), len(used)) == plain_pack(lengths, s)


def test_packing_whole_tables(spark):
    rows = [(None, 5), (0, None), (1, 0), (2, 9000), (3, 4096), (3, 4096)] + [(10 + k, 100 + 37 * k % 900) for k in range(300)]
    s = bin_packing.PackSettings(shard_rows=64)
    got = bin_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("piece", F.lit("clash")), s).collect()
    assert sum(r["length"] for r in got) == sum(n or 0 for _, n in rows)
    assert sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 2) == [(0, 4096), (4096, 4096), (8192, 808)]
    assert [r["bin_id"] for r in got if r["doc_id"] in (0, 1)] == [None, None]
    bins = defaultdict(list)
    for r in got:
        if r["bin_id"]:
            bins[r["bin_id"]].append(r)
    assert all(sum(r["length"] for r in b) <= b[0]["capacity"] for b in bins.values())
    assert sum(r["length"] for r in got) / sum(b[0]["capacity"] for b in bins.values()) > 0.9
    assert bin_packing.pack_documents(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_pipeline_against_plain_stages(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near_copies(4)] + [(5000 + i, t, "de", "s", 1) for i, t in repeats(2)] + [(9000, "12 34", "en", "s", 1), (9001, None, "de", "s", 1)], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    at, seen = docs, {}
    for name, f in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(f(spark, at, ""))
        seen[name] = at
    assert [c for n in list(stages)[:4] for c in seen[n].columns] == corpus_pipeline.COLUMNS * 4
    rows = lambda n: {r["doc_id"]: r["text"] for r in seen[n].collect()}
    known, one, cut, mixed = (rows(n) for n in list(stages)[:4])
    assert 9000 not in known and 9001 not in known and len(known) > 0.9 * docs.count()
    classes = plain_classes(list(known.items()))
    assert set(one) == {i for i in known if classes[i][1] == i}
    spans = plain_spans(list(one.items()))
    assert all((cut[i].encode() == one[i].encode()) == (spans[i][1] == 0) for i in cut) and all(spans[i][0] - spans[i][1] < 4 or i in cut or not cut.get(i, "").strip() for i in one)
    assert set(mixed) <= set(cut) and all(mixed[i] == cut[i] for i in mixed)
    packed = defaultdict(int)
    for r in seen["bin_packing"].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {i: len(mixed[i].split()) for i in mixed}


def test_pipeline_awkward(spark):
    docs = awkward(spark, False)
    gone = {i for i, t, *_ in awkward_rows() if not any(c.isalpha() for c in t or "")}
    for name, f in corpus_pipeline.STAGES[:4]:
        before, docs = docs, corpus_pipeline.materialize(f(spark, docs, ""))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()} and not set(ids) & gone and len(ids) == len(set(ids)), name
        if name == "jaccard_join":
            assert {3, 6, 8} <= set(ids) and not {4, 5, 7, 13} & set(ids)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert sum(r["length"] for r in pieces) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect())
    docs = spark.createDataFrame([], DOCS)
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(f(spark, docs, ""))
        assert docs.count() == 0


def test_one_row_stays_of_repeated_rows(spark):
    text, other = prose(31, 60), prose(32, 60)
    rows = [(7, text, "en", "b", 2), (7, text, "en", "a", 5), (7, text, "en", None, 1), (7, other, "en", "a", 1), (9, text, "de", "a", 1), (8, prose(33, 60), "en", "a", 1), (None, text, "en", "a", 1), (None, text, "en", "a", 1)]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[2], rows[3], rows[5], rows[6], rows[7]], key=str)


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    from mailloom.llm import common

    monkeypatch.setattr(common, "fresh_path", lambda spark: str(tmp_path / f"t{len(list(tmp_path.iterdir()))}-{random.random()}"))
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in near_copies(4)[:40]], DOCS).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert got.count() and len([p for p in tmp_path.iterdir() if p.name != "in"]) == 1


def test_texts_of_megabytes(spark):
    """Longer than a slice and a chunk: whole texts are measured, linked, cut and packed."""
    from mailloom.llm import quality_rules
    from mailloom.llm.source_mix import token_count

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(330_000)]
    long = "\n".join(" ".join(words[k : k + 20]) + "." for k in range(0, len(words), 20))
    rows = [(1, long), (2, long + "\nshort end of it."), (3, "one short text of its own, no more.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(long) > 2_600_000
    rules = {x["doc_id"]: x for x in quality_rules.line_clean(docs).collect()}
    assert rules[1]["n_words"] == 330_000 and rules[2]["n_words"] == 330_004 and rules[1]["n_dup_lines"] == 0 and rules[1]["word_chars"] == 330_000 * 7 + 16_500
    links = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard_join.jaccard_classes(docs).collect()}
    assert links == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    cut = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.repeated_spans(docs, suffix_dedup.SpanSettings(chunk_bytes=1 << 20)).collect()}
    assert cut == {1: (0, 0), 2: (len(long), 1), 3: (0, 0)}
    packed = bin_packing.pack_documents(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"))).groupBy("doc_id").sum("length").collect()
    assert {x["doc_id"]: x["sum(length)"] for x in packed} == {1: 330_000, 2: 330_004, 3: 8}


def test_packing_spreads_null_and_repeated_ids(spark):
    rows = [(None, 50 + k % 7) for k in range(400)] + [(9, 60) for _ in range(400)] + [(20 + k, 70) for k in range(400)]
    got = bin_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens long"), bin_packing.PackSettings(shard_rows=200)).collect()
    assert len(got) == len(rows)
    shards = defaultdict(int)
    for x in got:
        shards[x["bin_id"].split("-")[0]] += 1
    assert len(shards) == 6 and max(shards.values()) < 300


def test_sql_of_queries(spark):
    import os

    from mailloom.llm.oracles import ORACLES
    from mailloom.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        got = queries()[name](spark, sf).select(*names).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall())), name
