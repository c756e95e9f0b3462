"""Checks of extracted claims against their sources: one row per finding, then regrouped.

The verified answer of a thread is JSON text, read as a variant: every value keeps its JSON type, a
malformed part spoils only itself, and whatever else the answer holds is passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.text import evidence_in_text, normalized_evidence

# fixed values
CLAIM_TYPES = ("action", "constraint", "decision", "exception", "fact", "goal", "outcome", "preference", "problem", "reusable_rule", "situation")
CATEGORIES = ("automated_evidence", "decision", "noise", "personal_preference", "problem_solution", "project_update", "reference", "relationship", "task")
EXPERIENCE_FIELDS = {"action": "actions", "constraint": "constraints", "decision": "decisions", "exception": "exceptions", "goal": "goals", "outcome": "outcomes", "preference": "preferences", "problem": "problems", "reusable_rule": "reusable_rules", "situation": "situations"}
SCORES, SURE = (0, 100), (0.0, 1.0)


# the pieces of the rules are SQL text, v the name of a variant or a lambda's variable


def _part(v: str, path: str = "") -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')" if path else v


def _kind(v: str, path: str = "") -> str:
    return f"coalesce(schema_of_variant({_part(v, path)}), 'VOID')"


def _is_object(v: str, path: str = "") -> str:
    return f"startswith({_kind(v, path)}, 'OBJECT')"


def _list(v: str, path: str) -> str:
    """The elements; null if it is no array."""
    return f"if(startswith({_kind(v, path)}, 'ARRAY'), try_variant_get({v}, '$.{path}', 'array<variant>'), null)"


def said(v: str, path: str) -> str:
    """A value as text; null if it is absent, empty, zero or false."""
    text = f"try_variant_get({v}, '$.{path}', 'string')"
    return f"if(if({_kind(v, path)} = 'STRING', {text} = '', {text} in ('0', '0.0', 'false', '[]', '{{}}')), null, {text})"


def _blank(text: str) -> str:
    return rf"coalesce({text}, '') rlike '(?U)^[\\s\\x1c-\\x1f]*\\z'"


def _note(bad: str, *told: str) -> str:
    """A fault, if the test holds or cannot be told."""
    return f"if(coalesce({bad}, true), concat({', '.join(told)}), null)"


def _among(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_NUMBER = "rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL)'"
_SCORE = f"if({_kind('v', 'importance_score')} = 'BIGINT', try_variant_get(v, '$.importance_score', 'int'), null)"
_SURE_KIND = _kind("v", "audit.factual_confidence")
_SURE = f"if({_SURE_KIND} {_NUMBER}, try_variant_get(v, '$.audit.factual_confidence', 'double'), null)"
_SUMMARY = f"if({_kind('v', 'summary')} = 'STRING', {said('v', 'summary')}, null)"
_T = "thread_id"
_BEFORE = [
    _note(f"{said('v', 'category')} not in ({_among(CATEGORIES)})", _T, "': unknown category'"),
    _note(f"{_SCORE} not between {SCORES[0]} and {SCORES[1]}", _T, f"': importance_score must be an integer from {SCORES[0]} to {SCORES[1]}'"),
    _note(_blank(_SUMMARY), _T, "': summary must be a text that is not empty'"),
    _note(f"{_list('v', 'claims')} is null", _T, "': claims must be an array'"),
]
_AFTER = [
    _note(f"not {_is_object('v', 'audit')}", _T, "': audit must be an object'"),
    _note(f"not {_SURE_KIND} {_NUMBER}", _T, "': factual_confidence must be a number'"),
    f"if({_SURE} not between {SURE[0]} and {SURE[1]}, concat({_T}, ': factual_confidence must lie in 0..1'), null)",
]
#: the first fault of a claim itself; an id is taken by its first claim, even if that claim fails later
_CLAIM_FAULT = [
    _note(f"not {_is_object('claim')}", "at", "' is not an object'"),
    _note(f"{said('claim', 'claim_id')} is null", "at", "' has no id'"),
    _note("array_position(ids, get(ids, pos)) <= pos", "at", "' repeats an id'"),
    _note(f"{said('claim', 'type')} not in ({_among(CLAIM_TYPES)})", "at", "' has an unknown type'"),
    _note(_blank(said("claim", "text")), "at", "' has no text'"),
    _note("coalesce(size(quotes), 0) <= 0", "at", "' has no evidence'"),
]
_EVIDENCE_FAULT = [
    _note("not whole", "at", "' evidence '", "k", "' is not an object'"),
    _note("known is null", "at", "' evidence '", "k", "' names an unknown message'"),
    _note("not found", "at", "' evidence '", "k", "' is not in the message'"),
]
_KEPT = ", ".join(f"{_part('c', f)} as {f}" for f in ("claim_id", "text", "message_ids", "evidence_quotes"))
_EXPERIENCE = "map(" + ", ".join(f"'{name}', transform(filter({{0}}, c -> {said('c', 'type').replace('{', '{{').replace('}', '}}')} = '{kind}'), c -> struct({_KEPT}))" for kind, name in EXPERIENCE_FIELDS.items()) + ")"
_NO_TEXTS = "cast(array() as array<string>)"


def _claims(head: DataFrame) -> DataFrame:
    """thread_id, pos, claim, quotes, declared ids, and the first fault of the claim itself, if it has one."""
    each = head.where("same_thread").selectExpr("thread_id", f"transform(list, c -> coalesce({said('c', 'claim_id')}, '')) as ids", "list")
    each = each.selectExpr("thread_id", "ids", "posexplode(list) as (pos, claim)")
    declared = f"transform({_list('claim', 'message_ids')}, x -> coalesce(try_variant_get(x, '$', 'string'), 'null'))"
    each = each.selectExpr("*", "concat(thread_id, ': claim ', pos) as at", f"{_list('claim', 'evidence_quotes')} as quotes", f"{declared} as declared")
    return each.selectExpr("thread_id", "pos", "claim", "at", "quotes", "declared", f"coalesce({', '.join(_CLAIM_FAULT)}) as fault")


def _evidence_faults(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """thread_id, pos, faults of the claims whose evidence fails: one a piece of evidence, by index, then the ids'."""
    pieces = claims.where("fault is null").selectExpr("thread_id", "pos", "at", "declared", "posexplode(quotes) as (k, e)")
    pieces = pieces.selectExpr("thread_id", "pos", "at", "declared", "k", f"{_is_object('e')} as whole", f"coalesce({said('e', 'message_id')}, '') as __m", f"{said('e', 'quote')} as quote")
    bodies = messages.select("thread_id", F.col("message_id").alias("__m"), F.lit(True).alias("known"), normalized_evidence(F.col("body")).alias("norm"))
    pieces = pieces.withColumn("quote", normalized_evidence(F.col("quote"))).join(bodies, ["thread_id", "__m"], "left")
    pieces = pieces.withColumn("found", evidence_in_text(F.col("quote"), F.col("norm")))
    pieces = pieces.selectExpr("thread_id", "pos", "at", "k", f"coalesce({', '.join(_EVIDENCE_FAULT)}) as f", "whole and not coalesce(array_contains(declared, __m), false) or declared is null as outside")
    per = pieces.groupBy("thread_id", "pos", "at").agg(F.expr("array_sort(collect_list(if(f is null, null, struct(k, f)))).f as faults"), F.bool_or("outside").alias("outside"))
    uncovered = f"if(outside, array(concat(at, ' has evidence outside its message_ids')), {_NO_TEXTS})"
    return per.selectExpr("thread_id", "pos", f"concat(faults, {uncovered}) as faults").where("size(faults) > 0")


def validate_threads(results: DataFrame, messages: DataFrame) -> DataFrame:
    """results: thread_id, answer (JSON text). messages: thread_id, message_id, body (quotes removed).

    Returns thread_id, claims (array of variants: those that pass, in order), checked, valid, errors in
    the order of the answer, the answer's category, score, summary, grounded, confidence and
    needs_more_context, and `whole`: the answer as JSON text with only the claims that pass, the
    experience made of them, and the outcome of the checks. An answer that is not JSON, or of another
    thread, has no whole.
    """
    head = results.selectExpr("thread_id", "answer", "try_parse_json(answer) as v").selectExpr(
        "thread_id", "answer", f"coalesce({said('v', 'thread_id')} = thread_id, false) as same_thread", f"{_list('v', 'claims')} as list",
        f"array_compact(array({', '.join(_BEFORE)})) as before", f"array_compact(array({', '.join(_AFTER)})) as after", f"{said('v', 'category')} as category", f"{_SCORE} as importance_score",
        f"{said('v', 'summary')} as summary", f"if({_SURE} is null, null, least(greatest({_SURE}, {SURE[0]}D), {SURE[1]}D)) as factual_confidence",
        f"if({_is_object('v', 'audit')}, {said('v', 'audit.summary_grounded')} is not null, false) as grounded", f"{said('v', 'needs_more_context')} is not null as needs_more_context",
    )
    claims = _claims(head)
    judged = claims.join(_evidence_faults(claims, messages), ["thread_id", "pos"], "left")
    # variants have no order, so they are sorted as text
    judged = judged.selectExpr("thread_id", "pos", "to_json(claim) as claim", f"coalesce(faults, if(fault is null, {_NO_TEXTS}, array(fault))) as faults")
    per = judged.groupBy("thread_id").agg(
        F.expr("count(*) as checked"),
        F.expr("count_if(size(faults) = 0) as valid"),
        F.expr("transform(array_sort(collect_list(if(size(faults) = 0, struct(pos, claim), null))).claim, x -> parse_json(x)) as claims"),
        F.expr("flatten(array_sort(collect_list(struct(pos, faults))).faults) as claim_errors"),
    )
    out = head.join(per, "thread_id", "left").withColumns({
        "claims": F.expr("coalesce(claims, cast(array() as array<variant>))"), "checked": F.expr("coalesce(checked, 0)"), "valid": F.expr("coalesce(valid, 0)"),
        "errors": F.expr(f"if(same_thread, concat(before, coalesce(claim_errors, {_NO_TEXTS}), after), array(concat(thread_id, ': thread_id mismatch')))"),
    })
    made = {"claims": "claims", "experience": _EXPERIENCE.format("claims"), "validation": "struct(checked as evidence_claims_checked, valid as evidence_claims_valid, errors)"}
    added = ", ".join(f"'{name}', parse_json(to_json({value}))" for name, value in made.items())
    rest = f"map_filter(from_json(answer, 'map<string,variant>'), (k, x) -> k not in ({_among(tuple(made))}))"
    return out.selectExpr(
        "thread_id", "same_thread", "category", "importance_score", "summary", "factual_confidence", "grounded", "needs_more_context", "claims", "checked", "valid", "errors",
        f"if(same_thread, to_json(map_concat({rest}, map({added}))), null) as whole",
    )


def status(has_extraction: Column, has_verification: Column, same_thread: Column, errors: Column, grounded: Column, needs_more: Column) -> Column:
    whole = F.coalesce(has_extraction & has_verification & same_thread, F.lit(False))
    return F.when(~whole, "rejected").when((F.size(errors) == 0) & grounded, F.when(needs_more, "verified_with_gaps").otherwise("verified")).otherwise("partial")


def experience(claims: str) -> Column:
    """The valid claims (a column of variants) by type, as a map of ten lists; facts have none."""
    return F.expr(_EXPERIENCE.format(claims))
