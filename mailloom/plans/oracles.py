"""SQL that states the results of the registered queries."""

from __future__ import annotations

from mailloom.functions.text import case_folds

_WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _norm(c: str) -> str:
    """White space collapsed, and full case folding by the rule of case_folds()."""
    one, more = case_folds()
    folded = f"translate(lower(trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))), '{''.join(one)}', '{''.join(one.values())}')"
    for char, full in more.items():
        folded = f"replace({folded}, '{char}', '{full}')"
    return folded


_MESSAGES = """
m as (select conv_id::varchar || '-' || turn::varchar as email_id, conv_id as conversation_id, turn, role as sender_address,
  case when role = 'assistant' then '[{"name":"","address":"user"}]' else '[]' end as to_json,
  case when length(text) > 400 then 1 else 0 end as has_attachments, lpad(turn::varchar, 6, '0') as sent, text as body, 'turn ' || turn::varchar as sender_name,
  case when turn % 3 = 0 then 's' || turn::varchar else '' end as subject from conversations)
"""
_RANK = f"""with {_MESSAGES}, t as (
  select conversation_id as thread_id, count(*) as message_count, max(has_attachments) as any_attachment, max(sent) as latest,
    max(case when lower(sender_address) = 'user' then 1 else 0 end) as owner_sent, max(case when strpos(lower(to_json), 'user') > 0 then 1 else 0 end) as owner_addressed
  from m group by 1)
select t.*, cast(case when exists (select 1 from labels l where l.quality = 1 and l.doc_id = t.thread_id) then 1 else 0 end as integer) as analysed from t"""
_PACK = """with recursive d as (select conv_id, sum(length(text))::bigint as size from conversations group by 1),
f as (select conv_id, size, row_number() over (order by conv_id) as i from d where size <= 6000),
r as (
  select f.i, f.conv_id, f.size, 1::bigint as n, f.size as c, 0::bigint as b from f where i = 1
  union all
  select f.i, f.conv_id, f.size, case when r.n >= 8 or r.c + f.size > 6000 then 1 else r.n + 1 end,
    case when r.n >= 8 or r.c + f.size > 6000 then f.size else r.c + f.size end, case when r.n >= 8 or r.c + f.size > 6000 then r.b + 1 else r.b end
  from r join f on f.i = r.i + 1),
packed as (select conv_id, size, b as batch from r union all select conv_id, size, null from d where size > 6000)
"""
_HITS = f"""q as materialized (select item_id, text, {_norm('text')} as quote from benchmark), dd as materialized (select doc_id, {_norm('text')} as body from documents),
hits as materialized (select doc_id, item_id from dd join q on length(quote) >= 8 and contains(body, quote))"""
_TRIM = rf"regexp_replace(%s, '\A{_WS}+|{_WS}+\z', '', 'g')"
_FOLD = rf"""with recursive c as (select conv_id, turn, case when lag(text) over w is not null then text || chr(10) || lag(text) over w else text end as body from conversations window w as (partition by conv_id order by turn)),
p as (select a.conv_id, a.turn, a.body, coalesce(list(e.body order by -length(e.body), e.turn) filter (e.body is not null), []) as es
  from c a left join c e on e.conv_id = a.conv_id and e.turn < a.turn and length(e.body) >= 200 group by all),
f as (select conv_id, turn, body as r, 0::bigint as x, es, 1 as i from p
  union all
  select conv_id, turn, case when ok then cand else r end, case when ok then x + length(r) - length(cand) else x end, es, i + 1
  from (select *, strpos(r, es[i]) - 1 >= 40 and length({_TRIM % "substr(r, strpos(r, es[i]) + length(es[i]))"}) <= 80 and length(cand) >= 20 as ok
    from (select *, regexp_replace(substr(r, 1, greatest(strpos(r, es[i]) - 1, 0)), '{_WS}+\z', '') as cand from f where i <= len(es))))
select conv_id, turn, r as kept, x as removed from f where i = len(es) + 1"""
_LINES = "address|article|blockquote|br|div|footer|h[1-6]|header|li|p|section|table|td|th|tr"
_HTML = rf"""with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g') as t from pages),
b as (select page_id, regexp_replace(t, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', '\2 ' || chr(1) || '\1' || chr(2), 'g') as t from a),
c as (select page_id, regexp_replace(regexp_replace(t, '(?i)</?({_LINES})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from b),
d as (select page_id, replace(replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from c),
e as (select page_id, regexp_replace(regexp_replace(replace(replace(t, chr(1), '<'), chr(2), '>'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g') as t from d)
select page_id, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '\A[ \n\t]+|[ \n\t]+\z', '', 'g') as text from e"""

_BACK = chr(92)
_LINE_ENDS = f"regexp_replace(%s, '{_BACK}r{_BACK}n?', chr(10), 'g')"
_BLANKS = f"regexp_replace(regexp_replace({_LINE_ENDS}, '[ {_BACK}t]+', ' ', 'g'), ' +{_BACK}n', chr(10), 'g')"
_CLEAN = _TRIM % f"regexp_replace({_BLANKS}, '{_BACK}n{{3,}}', chr(10) || chr(10), 'g')"
_FINGERPRINT = """sha256('[' || string_agg('{"body_sha256":"' || sha256(m.body) || '","message_id":"' || email_id || '","received_at_utc":null,"sent_at_utc":"' || sent || '"}', ',' order by sent, email_id) || ']')"""
_DOCUMENT = f"""with {_MESSAGES}, folded as ({_FOLD}),
w as (select conversation_id, turn, 0 as pos, sender_address as address, sender_name as name from m union all select conversation_id, turn, 1, 'user', '' from m where sender_address = 'assistant'),
l as (select conversation_id, lower(address) as k, arg_max(address || '=' || name, turn * 10 + pos) as v from w group by all),
who as (select conversation_id, string_agg(v, ';' order by k) as people from l group by 1),
d as (select conversation_id, coalesce(arg_max(subject, turn) filter (subject <> ''), '') as subject, count(*) as message_count, bool_or(has_attachments = 1) as has_unavailable_attachments,
    sum(removed)::bigint as exact_duplicate_chars_removed, {_FINGERPRINT} as source_fingerprint, string_agg(email_id, ',' order by sent, email_id) as ids, string_agg(sender_address, ',' order by sent, email_id) as senders,
    string_agg(has_attachments::varchar, ',' order by sent, email_id) as attached, string_agg(sha256(kept), ',' order by sent, email_id) as bodies
  from m join (select conv_id as conversation_id, turn, kept, removed from folded) f using (conversation_id, turn) group by 1)
select conversation_id as thread_id, 'user' as owner_email, d.* exclude (conversation_id), people from d join who using (conversation_id)"""
_EXPORTS = f"""with {_MESSAGES}
select email_id, conversation_id::varchar as conversation_id, sent as sent_at_utc, sender_name, sender_address, to_json as to_recipients_json, subject, 'text' as body_type,
  '["' || sender_address || '"]' as categories_json, sha256(body) as body_sha256, sha256({_CLEAN % 'body'}) as clean_sha256, has_attachments, 0 as is_read from m
union all select 'd' || doc_id::varchar, 'd' || doc_id::varchar, null, source, null, '[]', lang, 'text', '[]', sha256(text), sha256({_CLEAN % 'text'}), 0, 1 from documents"""
_AGAIN = """with n as (select (select count(distinct conv_id // 200) from conversations) as j, (select count(distinct doc_id // 2000) from documents) as c,
  (select count(*) from conversations) as mj, (select count(*) from documents) as mc)
select 'files_total' as name, j + c as first, j + c as second from n union all select 'files_imported', j + c, 0 from n union all select 'files_skipped', 0, j + c from n union all select 'files_failed', 0, 0
union all select 'messages_imported', mj + mc, 0 from n union all select 'json imported', j, mj from n union all select 'csv imported', c, mc from n union all select 'links', mj + mc, mj + mc from n"""
_ANALYSIS = f"""with c as (select conv_id, row_number() over (partition by conv_id order by lpad(turn::varchar, 6, '0')) - 1 as k, length({_norm('substr(' + _CLEAN % 'text' + ', 1, 40)')}) >= 8 and not (k % 3 = 1 and conv_id % 3 = 1) as good from conversations),
t as (select conv_id, count(*) as n, count(*) filter (good) as valid, count(*) filter (good and k % 2 = 0) as decisions, count(*) filter (not good) + case when conv_id % 5 = 0 then 1 else 0 end as errors from c group by 1)
select conv_id::varchar as thread_id, 'rejected' as status, null::integer as importance_score, null::double as factual_confidence, null::bigint as checked, null::bigint as valid, 1::integer as errors, 0::integer as decisions, null as reasons from t where conv_id % 7 = 0
union all select conv_id::varchar, case when errors > 0 then 'partial' when conv_id % 2 = 0 then 'verified_with_gaps' else 'verified' end, case when conv_id % 5 <> 0 then (10 * n)::integer end, 0.5, n, valid, errors::integer, decisions::integer, '["r"]' from t where conv_id % 7 <> 0"""

ORACLES: dict[str, str] = {
    "store_stats": """select (select count(*) from conversations) as messages, (select count(distinct conv_id) from conversations) as threads,
  (select count(distinct source) from documents) as sources, (select count(*) from labels where quality = 1) as verified_threads""",
    "thread_rank": _RANK,
    "thread_rank_topk": _RANK + " order by analysed, owner_sent desc, owner_addressed desc, message_count desc, any_attachment desc, latest desc, thread_id limit 20",
    "thread_scan_order": f"with {_MESSAGES} select conversation_id, email_id, cast(row_number() over (partition by conversation_id order by sent, email_id) as integer) as place from m",
    "quote_dedup": _FOLD,
    "thread_fingerprint": f"with {_MESSAGES} select conversation_id as thread_id, {_FINGERPRINT} as fingerprint from m group by 1",
    "pack_batches": _PACK + "select * from packed",
    "pack_summary": _PACK + """select count(*) as threads_considered, coalesce(max(batch) + 1, 0) as batches, 2 * coalesce(max(batch) + 1, 0) as estimated_runs, count(*) filter (batch is null) as oversized,
  sum(size)::bigint as source_characters, max(size) as largest_thread_characters from packed""",
    "batch_identity": _PACK + """, h as (select batch, sha256('{"prompt_version":"message-extraction-v1","threads":[' || string_agg('{"thread_id":"' || conv_id::varchar || '"}', ',' order by conv_id) || ']}') as input_sha256 from packed where batch is not null group by 1)
select batch, input_sha256, lpad((batch + 1)::varchar, 5, '0') || '-' || substr(input_sha256, 1, 12) as batch_id from h""",
    "thread_document": _DOCUMENT,
    "participants_last_wins": f"""with {_MESSAGES}, w as (
  select conversation_id, turn, 0 as pos, upper(substr(sender_address, 1, 1)) || substr(sender_address, 2) as address, 'turn ' || turn::varchar as name from m
  union all select conversation_id, turn, 1, 'user', '' from m where sender_address = 'assistant'),
l as (select conversation_id, lower(address) as k, arg_max(address || '=' || name, turn * 10 + pos) as v from w group by all)
select conversation_id as thread_id, string_agg(v, ';' order by k) as people from l group by 1""",
    "html_to_text": _HTML,
    "clean_text": f"select doc_id, {_CLEAN % 'text'} as text from documents",
    "evidence_normalize": f"select doc_id, sha256({_norm('text')}) as normal_sha256 from documents",
    "evidence_check": f"with {_HITS} select * from hits",
    "body_hash": "select 'document' as kind, doc_id as id, sha256(text) as sha256 from documents union all select 'page', page_id, sha256(html) from pages",
    "synthetic_id": """select doc_id, 'synthetic:' || sha256(chr(31) || lang || chr(31) || n_chars::varchar || chr(31) || source || chr(31) || text) as email_id, lang as conversation_id,
  n_chars::varchar as received_at_utc, sha256(text) as body_sha256 from documents""",
    "flag_parse": "select o_orderstatus as importance, cast(case when o_orderstatus in ('F', 'P') then 1 else 0 end as integer) as is_read, cast(case when o_orderkey % 3 <> 0 then 1 else 0 end as integer) as has_attachments, count(*) as n from orders group by all",
    "json_props": """select case when event_id % 3 = 0 and k is not null then '["' || event_type || '","' || k || '"]' else '[]' end as categories_json, count(*) as n
  from (select event_id, event_type, json_extract_string(props, '$.k') as k from events) group by 1""",
    "recipients_parse": """select c_custkey, '[{"name":"' || n_name || '","address":"' || lower(c_name) || '"}]' as to_recipients_json, '[{"name":"' || n_name || '","address":"' || c_custkey::varchar || '"}]' as cc_recipients_json,
  '[]' as bcc_recipients_json, null::varchar as sender_name, c_name as sender_address from customer join nation on n_nationkey = c_nationkey""",
    "upsert_latest": "select user_id, event_type, event_id, value from (select user_id, event_type, event_id, round(value, 4) as value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1",
    "upsert_precedence": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by event_type = 'purchase' desc, ts desc, event_id desc) as n from events) where n = 1",
    "source_merge": """with l as (select distinct o_custkey as id, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as s from orders),
inc as (select c_custkey as id, upper(c_name) as subject from customer where c_mktsegment = 'BUILDING'), l2 as (select * from l where s <> 1 union all select id, 1 from inc),
fresh as (select * from inc where not exists (select 1 from l where l.id = inc.id and s = 2)),
merged as (select c_custkey as id, c_name as subject from customer where c_custkey in (select id from l) and c_custkey not in (select id from fresh) union all select * from fresh)
select id as email_id, subject, sources from merged join (select id, count(*) as sources from l2 group by 1) using (id)""",
    "stale_orphan_prune": "select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderdate >= timestamp '1998-01-01')",
    "has_rich_source_semi": "select distinct o_orderkey from orders o where exists (select 1 from customer c where c.c_custkey = o.o_custkey and c_mktsegment = 'BUILDING')",
    "skip_current_anti": "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1 and doc_id % 2 = 0)",
    "status_report": """with s as (select case when quality = 1 then case when toxic = 1 then 'verified_with_gaps' else 'verified' end else 'partial' end as status, quality, toxic, n_chars % 101 as v from labels join documents using (doc_id)),
c as (select status, count(*) as n from s group by 1)
select count(*) as analyzed_threads, (select '{' || string_agg('"' || status || '":' || n::varchar, ',' order by status) || '}' from c) as status_counts, count(*) filter (v >= 80) as high_importance_threads,
  sum(quality + 1)::bigint as evidence_claims_checked, sum(toxic)::bigint as evidence_claims_valid, round(sum(toxic) / sum(quality + 1), 4) as evidence_pass_rate, round(avg(v / 100.0), 4) as average_verifier_confidence,
  (select count(*) from events where event_type = 'purchase') as failed_agent_runs from s""",
    "claim_validate": f"""with {_HITS}, src as (select item_id, min(doc_id) as doc_id from hits group by 1),
c as (select q.item_id, (q.item_id % 5)::varchar as thread_id, 'c' || (q.item_id % 9)::varchar as claim_id, q.item_id % 7 = 0 as bad_type, trim(substr(q.text, 1, 20)) = '' as blank, coalesce(s.doc_id, 0) as m, q.quote from q left join src s using (item_id)),
j as (select c.*, row_number() over (partition by thread_id, claim_id order by item_id) > 1 as again, dd.doc_id is not null and length(quote) >= 8 and contains(dd.body, quote) as found from c left join dd on dd.doc_id = c.m),
g as (select thread_id, count(*) + case when thread_id = '3' then 1 else 0 end as checked, count(*) filter (not again and not bad_type and not blank and found) as valid,
  count(*) filter (again or bad_type or blank or not found) + case when thread_id = '0' then 0 else 1 end as errors from j group by 1)
select thread_id, checked, valid, errors, cast(case thread_id when '1' then 150 when '2' then null else 70 end as integer) as importance_score, case when thread_id <> '4' then 0.5 end::double as factual_confidence,
  case when errors = 0 then 'verified' else 'partial' end as status from g""",
    "experience_pivot": "select user_id, " + ", ".join(f"coalesce(string_agg(event_id::varchar, ',' order by event_id) filter (event_type = '{k}'), '') as {n}" for k, n in (("click", "actions"), ("purchase", "decisions"), ("view", "goals")))
    + ", count(distinct event_type) filter (event_type in ('click', 'purchase', 'view'))::integer as kinds from events group by 1",
    "ingest_exports": _EXPORTS,
    "ingest_again": _AGAIN,
    "analysis_run": _ANALYSIS,
}
