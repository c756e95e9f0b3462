"""Text functions: white space, case folding, evidence matching, hashes, as column expressions."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as str.isspace() has it: Java's Unicode \s lacks U+001C to U+001F
SPACE = r"(?U)[\s\x1c-\x1f]"
LEAST_QUOTE = 8


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", "")


@functools.cache
def case_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Where full case folding goes on after lower case: characters to one character, and to more (ß to ss)."""
    one, more = {}, {}
    for code in range(sys.maxunicode + 1):
        low = chr(code).lower()
        if len(low) == 1 and low not in one and (full := low.casefold()) != low:
            (one if len(full) == 1 else more)[low] = full
    return one, more


def _near(chars: list[str], gap: int = 256) -> str:
    """A character class of the few ranges that hold these: long unions are slow to match."""
    codes = sorted(map(ord, chars))
    starts = [k for k, c in enumerate(codes) if not k or c - codes[k - 1] > gap]
    ends = [*starts[1:], len(codes)]
    return "[" + "".join(f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(starts, ends, strict=True)) + "]"


def casefold(c: Column) -> Column:
    """Full case folding. After lower case, ß and µ two searches, the cheap one first, tell whether anything may be left to do."""
    one, more = case_folds()
    rare = _near([x for x in [*one, *more] if x not in "ßµ"])
    # one literal, each part a character and what it becomes
    rest = F.split(F.lit(" ".join(char + full for char, full in more.items())), " ")

    def fold(low: Column) -> Column:
        full = F.aggregate(rest, F.translate(low, "".join(one), "".join(one.values())), lambda done, e: F.replace(done, F.substring(e, 1, 1), F.substring(e, 2, 9)))
        return F.when(low.rlike(r"[^\x00-\xff]") & low.rlike(rare), full).otherwise(low)

    low = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    # inside of a lambda, so that the lower case is made once
    return F.get(F.transform(F.array(low), fold), F.lit(0))


def normalized_evidence(c: Column) -> Column:
    """White space collapsed and trimmed, case folded."""
    return casefold(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{SPACE}+", " ")))


def evidence_in_text(quote: Column, text: Column) -> Column:
    """Both already normalised."""
    return F.coalesce((F.length(quote) >= LEAST_QUOTE) & text.contains(quote), F.lit(False))


def body_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
