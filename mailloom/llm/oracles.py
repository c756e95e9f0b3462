"""SQL that states the results of this subpackage's queries, where SQL can."""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 10
"""


def source_mix_sql() -> str:
    """The raking and the budget, unrolled."""
    from .source_mix import DIMS, MixSettings

    s = MixSettings()
    topic = "case " + " ".join(f"when regexp_matches(text, '{p.replace(chr(92) * 2, chr(92))}') then '{n}'" for n, p in s.topics) + f" else '{s.other_topic}' end"
    steps = [
        f"""d as materialized (select doc_id, source, lang, coalesce(source, '(none)') as s, coalesce(lang, '(none)') as l, {topic} as t,
          cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as k from documents)""",
        "c as materialized (select s, l, t, sum(k)::double as tokens from d group by all)",
        "total as materialized (select sum(tokens) as total from c)",
    ]
    short = dict(zip(DIMS, "slt", strict=True))
    for d, c in short.items():
        steps.append(f"m_{c} as materialized (select {c}, share / sum(share) over () as target from (select {c}, pow(sum(tokens) / greatest((select total from total), 1), {s.tempering[d]}) as share from c group by {c}))")
    last = "w0"
    steps.append("w0 as materialized (select *, tokens as weight from c)")
    n = 0
    for _ in range(s.sweeps):
        for c in short.values():
            n += 1
            steps.append(f"w{n} as materialized (select s, l, t, tokens, case when have > 0 then weight * target * (select total from total) / have else 0 end as weight from (select *, sum(weight) over (partition by {c}) as have from {last}) join m_{c} using ({c}))")
            last = f"w{n}"
    steps.append(f"g as materialized (select *, case when tokens > 0 then weight / tokens else 0 end as per from {last})")
    steps.append("f0 as materialized (select 0.0::double as f)")
    for i in range(s.fills):
        steps.append(f"f{i + 1} as materialized (select case when sum(case when per * f >= 1 then 0 else weight end) > 0 then ({s.budget} * sum(tokens) - sum(case when per * f >= 1 then tokens else 0 end)) / sum(case when per * f >= 1 then 0 else weight end) else max(f) end as f from g, f{i})")
    return "with " + ",\n".join(steps) + f"""
select doc_id, source, lang, t as topic, k as n_tokens, round(least(1.0, per * f), 6) as probability,
  cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) / 4294967296.0 < least(1.0, per * f) as drawn
from d join g using (s, l, t), f{s.fills}"""



_W = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    from .quality_rules import LineRules

    r = LineRules()
    quoted = lambda x: (x.decode() if isinstance(x, bytes) else x).replace("'", "''")
    count = lambda marks: f"length(line) - length(translate(line, '{quoted(marks)}', ''))"
    return f"""with d as materialized (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_W}') as w from documents),
line as (select doc_id, pos, line, regexp_extract_all(line, '{_W}') as lw from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from d)),
judged as (select doc_id, lw, len(lw) > 0 and row_number() over (partition by doc_id, line order by pos) > 1 as dup, coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) as chars,
  len(lw) > 0 and ({count(r.noise)} > {r.noise_per_word} * len(lw) or {count(r.nav)} > {r.nav_per_word} * len(lw)
    or (len(lw) >= {r.close_from} and len(list_filter(lw, lambda x: contains('{quoted(r.closing)}', right(x, 1)))) = 0) or regexp_matches(line, '(?i){quoted(r.boilerplate)}')) as bad from line),
per_line as (select doc_id, count(*) filter (dup) as n_dup_lines, count(*) filter (bad) as n_bad_lines, coalesce(sum(chars) filter (bad), 0) as lost from judged group by 1),
win as (select doc_id, i, count(*) over (partition by doc_id, k) > 1 as again from (select doc_id, i, list_slice(w, i, i + {r.window - 1}) as k from (select doc_id, w, unnest(range(1, len(w) - {r.window - 2})) as i from d))),
rep as (select doc_id, count(distinct i + j) as n from win, range({r.window}) t(j) where again group by 1),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(rep.n, 0) as n_repeat_words from d left join rep using (doc_id)),
v as (select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, base_failed, cast(lost as double) / greatest(word_chars, 1) as lost, not base_failed and cast(lost as double) / greatest(word_chars, 1) <= {r.max_loss} as kept
from v join per_line using (doc_id)"""


#: links by counting shared shingles, classes by following them
JACCARD = f"""with recursive t as materialized (select coalesce(text, '') as text, min(doc_id) as id from documents group by 1),
w as (select id, regexp_extract_all(text, '{_W}') as w from t),
s as materialized (select distinct id, k from (select id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) end) as k from w)),
n as (select id, count(*) as n from s group by 1),
p as (select a.id as x, b.id as y, count(*) as c from s a join s b using (k) where a.id <> b.id group by 1, 2),
link as materialized (select x, y from p join n a on a.id = x join n b on b.id = y where c >= 0.8 * (a.n + b.n - c) - 1e-9),
reach as (select id as x, id as y from t union select reach.x, link.y from reach join link on link.x = reach.y),
root as (select x, min(y) as class_id from reach group by 1), deg as (select x, count(*) as n_links from link group by 1)
select d.doc_id, t.id as text_id, root.class_id, coalesce(deg.n_links, 0) as n_links
from documents d join t on t.text = coalesce(d.text, '') join root on root.x = t.id left join deg on deg.x = t.id"""

#: every string of 50 bytes, as hexadecimal digits
SPANS = """with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as materialized (select doc_id, pos, substr(h, 2 * pos - 1, 2) as x, case when 2 * pos + 98 <= len(h) then md5(substr(h, 2 * pos - 1, 100)) end as s from (select doc_id, h, unnest(range(1, len(h) // 2 + 1)) as pos from d)),
own as materialized (select s, min(doc_id) as owner from b where s is not null group by 1 having count(*) > 1),
f as materialized (select b.doc_id, pos, x, max(case when owner < b.doc_id then pos end) over (partition by b.doc_id order by pos) as begun from b left join own using (s)),
g as (select doc_id, pos, x, coalesce(pos - begun < 50, false) as g from f),
r as (select *, g and not coalesce(lag(g) over (partition by doc_id order by pos), false) as starts from g),
c as (select doc_id, count(*) filter (g) as n_removed, count(*) filter (starts) as n_spans, string_agg(x, '' order by pos) filter (not g) as left_over from r group by 1)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_over, ''))) as kept_sha256 from d left join c using (doc_id)"""

ORACLES: dict[str, str] = {"op1_jaccard_join": JACCARD, "op3_source_mix": source_mix_sql(), "op4_quality_rules": quality_rules_sql(), "op6_topk_index": TOP_K, "op9_suffix_dedup": SPANS}
