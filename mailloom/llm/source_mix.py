"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts per (source, language, topic) cell are raked until the three marginals meet their
targets. A text's inclusion probability is its cell's weight per token times one factor, at most
one; the factor is set so that the expected number of sampled tokens meets the budget. Cells that
are drawn whole then fall short of their weights, and the margins with them. With `bounded` the
probabilities themselves are raked, none above one, so that the margins of the expected sample meet
their targets; the budget is then the most that is spent, for a value can give no more tokens than
it has. A text is drawn by a hash of its id, so that the sample is stable.

Cases: a null source or language is the category `(none)`; null and empty texts have no tokens,
weight nothing, and are drawn with their cell's probability; a cell alone in its margins keeps its
weight; equal ids are drawn alike; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMS = ("source", "lang", "topic")
NONE = "(none)"
#: as many cells are sent to every executor at most; more are joined by a shuffle
BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class MixSettings:
    #: a marginal's target shares are its token shares to this power, made to sum to one
    tempering: dict[str, float] = field(default_factory=lambda: {"source": 0.8, "lang": 0.8, "topic": 0.9})
    #: or stated shares by value: dimension, value, share; values not named keep their own
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    #: the first topic whose pattern a text matches
    topics: tuple[tuple[str, str], ...] = (("licence", "[Ll]icen[sc]e"), ("contact", "@"), ("listing", "\\|"))
    other_topic: str = "prose"
    #: raking ends after a round of so many sweeps in which the margins came as near as `tolerance`, or no nearer
    sweeps: int = 8
    #: expected share of all tokens that is drawn
    budget: float = 0.7
    fills: int = 6
    #: the expected sample meets the targets, if need be below the budget
    bounded: bool = False
    #: largest miss of a margin, as a share of all weights or of the expected sample, at which raking ends
    tolerance: float = 1e-6
    #: bounded raking that has not met the targets after so many sweeps starts again with less
    bounded_sweeps: int = 40


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _dims(docs: DataFrame, s: MixSettings) -> DataFrame:
    topic = F.lit(s.other_topic)
    for name, pattern in reversed(s.topics):
        topic = F.when(F.col("text").rlike(pattern), F.lit(name)).otherwise(topic)
    return docs.withColumns({"__source": F.coalesce("source", F.lit(NONE)), "__lang": F.coalesce("lang", F.lit(NONE)), "__topic": topic})


def _targets(cells: DataFrame, s: MixSettings, total: int) -> DataFrame:
    """Adds the target share of the cell's value in each margin."""
    out = cells
    for d in DIMS:
        own = F.sum("tokens").over(Window.partitionBy(d)) / F.lit(max(total, 1))
        target = F.pow(own, F.lit(s.tempering.get(d, 1.0)))
        for value, share in s.targets.get(d, {}).items():
            target = F.when(F.col(d) == value, F.lit(float(share))).otherwise(target)
        out = out.withColumn(f"t_{d}", target)
    out = materialize(out)
    for d in DIMS:
        # the targets of a margin sum to one
        norm = out.groupBy(d).agg(F.max(f"t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
        out = out.withColumn(f"t_{d}", F.col(f"t_{d}") / F.lit(norm))
    return out


def _miss(cells: DataFrame, value: Column, whole: float) -> float:
    """The largest difference of a margin's share of the whole from its target."""
    off = [F.abs(F.sum(value).over(Window.partitionBy(d)) / F.lit(whole) - F.col(f"t_{d}")) for d in DIMS]
    return cells.select(F.greatest(*off).alias("off")).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, s: MixSettings) -> DataFrame:
    """cells: source, lang, topic, tokens. Adds weight: tokens scaled until the margins meet their targets."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = _targets(cells.withColumn("weight", F.col("tokens").cast("double")), s, total)
    miss, last = math.inf, math.inf
    while miss > s.tolerance and (miss < 0.999 * last or last == math.inf):
        last = miss
        for sweep in range(s.sweeps):
            for d in DIMS:
                have = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"t_{d}") * F.lit(float(total)) / have).otherwise(0.0))
            if sweep % 2 or sweep == s.sweeps - 1:
                out = materialize(out)
        miss = _miss(out, F.col("weight"), max(float(total), 1.0))
    return out.drop(*(f"t_{d}" for d in DIMS))


def inclusion(cells: DataFrame, s: MixSettings) -> DataFrame:
    """Adds probability: weight per token times the factor that spends the budget, at most one."""
    per = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = cells.withColumn("per_token", per)
    spend = s.budget * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = 0.0
    for _ in range(s.fills):
        full = F.col("per_token") * F.lit(factor) >= 1
        got = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not got[1]:
            break
        factor = (spend - float(got[0])) / float(got[1])
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("per_token") * F.lit(factor)))


def bounded_inclusion(cells: DataFrame, s: MixSettings) -> DataFrame:
    """Adds probability: at most one, with the targets as the margins of the expected tokens.

    A cell's probability is least(1, scale), its scale a product of a factor for each of its values.
    A sweep sets the factors x of one margin after the other so that a value's expected tokens, the
    sum of least(1, x scale) tokens, are what it needs: with the larger scales first, x is the
    greatest over the cells of (need - tokens before the cell) / (scale tokens from the cell on).
    The least scale that draws every cell is taken where a value needs all its tokens.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    empty = cells.where("tokens = 0").withColumn("probability", F.lit(0.0))
    aimed = _targets(cells.where("tokens > 0"), s, total)
    tokens = F.col("tokens")
    reach = [F.try_divide(F.sum("tokens").over(Window.partitionBy(d)) / F.lit(max(total, 1.0)), F.col(f"t_{d}")) for d in DIMS]
    # no value can give more than all its tokens
    most = aimed.select(F.least(*reach).alias("reach")).agg(F.min("reach")).first()[0]
    budget = min(s.budget, 1.0 if most is None else most)
    raked = inclusion(rake(cells.where("tokens > 0"), s), s)
    # the weights meet the targets without any bound while the largest of them stays below one
    floor = min(budget, 1.0 / (raked.agg(F.max("per_token")).first()[0] or 1.0))
    while budget > floor:
        out = aimed.withColumn("scale", F.lit(budget))
        for _ in range(s.bounded_sweeps):
            for d in DIMS:
                all_of, need = Window.partitionBy(d), F.col(f"t_{d}") * F.lit(budget * total)
                ahead = all_of.orderBy(F.desc("scale"), *DIMS).rowsBetween(Window.unboundedPreceding, -1)
                on = all_of.orderBy("scale", *(F.desc(c) for c in DIMS)).rowsBetween(Window.unboundedPreceding, 0)
                x = F.try_divide(need - F.coalesce(F.sum(tokens).over(ahead), F.lit(0)), F.sum(F.col("scale") * tokens).over(on))
                x = F.when(need >= F.sum(tokens).over(all_of) * F.lit(1 - 1e-12), F.try_divide(F.lit(1.0), F.col("scale"))).otherwise(x)
                out = out.withColumn("x", x).withColumn("scale", F.col("scale") * F.coalesce(F.max("x").over(all_of), F.lit(1.0))).drop("x")
            out = materialize(out)
            if _miss(out, F.least(F.lit(1.0), F.col("scale")) * tokens, budget * total) <= s.tolerance:
                return out.select(*cells.columns, F.least(F.lit(1.0), F.col("scale")).alias("probability")).unionByName(empty)
        # the values are out of reach together; within 0.05 of the floor that is taken
        budget = (budget + floor) / 2 if budget - floor > 0.1 else floor
    return raked.select(*cells.columns, F.least(F.lit(1.0), F.col("per_token") * F.lit(floor)).alias("probability")).unionByName(empty)


def mix_sources(docs: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """docs (doc_id, text, source, lang, ...) with topic, n_tokens, probability and drawn."""
    spark = docs.sparkSession
    parted = _dims(docs, s)
    cells = parted.select(*(F.col(f"__{d}").alias(d) for d in DIMS), token_count(F.col("text")).alias("k")).groupBy(*DIMS).agg(F.sum("k").alias("tokens"))
    cells = materialize(cells)
    cells = bounded_inclusion(cells, s) if s.bounded else inclusion(rake(cells, s), s)
    cells = materialize(cells.select(*(F.col(d).alias(f"__{d}") for d in DIMS), "probability"))
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    clash = [c for c in ("topic", "n_tokens", "probability", "drawn") if c in docs.columns]
    out = parted.drop(*clash).join(cells, [f"__{d}" for d in DIMS])
    out = out.withColumns({"topic": F.col("__topic"), "n_tokens": token_count(F.col("text")), "drawn": u < F.col("probability")})
    return out.select(*(c for c in docs.columns if c not in clash), "topic", "n_tokens", "probability", "drawn")
