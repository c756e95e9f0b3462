"""URL filtering: domain rules first, then a template tree of paths per host.

Paths of a host are generalised branch by branch. Segments that are numbers or identifiers become
wildcards at once; where a node has many children of one shape, or of many shapes, these become a
wildcard too, but for those with enough labelled pages whose share of bad ones differs from that of
the others; the remaining sibling branches that lead to like shapes and whose shares of bad pages do
not differ statistically, neither from the next nor from the whole, are merged. A template is rejected
when its smoothed share of bad pages is high: by itself, or against the share of all pages by more than
chance explains over so many templates.

All steps work on (host, path) counts aggregated before any shuffle by host. A step takes every node
past the segments that all its paths share, so the steps are as many as the branchings on one path,
however long it is.

Cases: a null url, or one without `://`, has an empty host and path and the verdict of the template
of empty paths; without labels nothing is rejected; a page labelled twice counts with its mean;
repeated urls get one verdict; paths of any depth are told apart to their end; extra columns are
ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release


@dataclass(frozen=True)
class UrlRule:
    """`host/path` prefix of a host, all its subdomains, and the paths that start with it."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class TemplateSettings:
    #: children of one shape below a node from which they become a wildcard
    fan: int = 8
    #: sibling branches merge when their bad shares differ by less than so many standard errors
    z: float = 1.5
    #: weight of the prior share in a template's purity, in pages; with as many labelled ones a child of a wide node is told apart
    prior_pages: float = 8.0
    #: a template is rejected from this smoothed share of bad pages
    reject: float = 0.5
    #: or if its share is so many times that of all pages, by this many standard errors more than chance over all templates
    lift: float = 2.0
    reject_z: float = 2.0


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """What stays fixed when the variable part of a segment is cut out."""
    cut = F.regexp_replace(segment, r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|(?<![a-zA-Z0-9])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{12,}(?![a-zA-Z0-9])|[0-9]+", "{}")
    return F.when(cut.contains("{}"), cut).otherwise(F.regexp_replace(segment, r"^.*?(\.[a-zA-Z]{1,5})?$", "*$1"))


def _normal(path: Column) -> Column:
    """Segments that hold nothing but a number or identifier, maybe with an extension, as {}."""
    return F.regexp_replace(path, r"(?<=/)([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{12,})(?=/|$|\.[a-zA-Z]{1,5}$)", "{}")


def _share(bad: Column, labelled: Column, s: TemplateSettings, prior: float) -> tuple[Column, Column]:
    """Smoothed share of bad pages and its variance."""
    size = labelled + F.lit(s.prior_pages)
    share = F.least(F.greatest((bad + F.lit(s.prior_pages * prior)) / size, F.lit(0.0)), F.lit(1.0))
    return share, share * (1 - share) / size


def _differs(s: TemplateSettings, prior: float, count: str, all_bad: str, all_labelled: str) -> Column:
    """Whether a row's share differs from that of its group's others; the more rows, the more may by chance."""
    own, own_var = _share(F.col("bad"), F.col("labelled"), s, prior)
    rest, rest_var = _share(F.col(all_bad) - F.col("bad"), F.col(all_labelled) - F.col("labelled"), s, prior)
    far = F.abs(own - rest) > F.sqrt((F.lit(s.z**2) + 2 * F.log(F.col(count))) * (own_var + rest_var))
    return (F.col("labelled") >= s.prior_pages) & far


_NODE = ["host", "prefix"]


def _past_common(state: DataFrame) -> DataFrame:
    """Moves the segments that all paths of a node share into its prefix; a lone path is taken to its end."""
    node = state.groupBy(*_NODE).agg(F.min("segs").alias("lo"), F.max("segs").alias("hi"))
    # the least and the greatest path share what all of them share
    apart = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    node = node.select(*_NODE, F.when(apart == 0, F.size("lo")).otherwise(apart - 1).cast("int").alias("common"))
    taken, left = F.slice("segs", F.lit(1), F.col("common")), F.slice("segs", F.col("common") + 1, F.greatest(F.size("segs"), F.lit(1)))
    onward = F.when(F.col("common") > 0, F.concat("prefix", F.lit("/"), F.array_join(taken, "/"))).otherwise(F.col("prefix"))
    return state.join(node, _NODE).select("host", onward.alias("prefix"), left.alias("segs"), "npath", "n", "labelled", "bad")


def _widened(child: DataFrame, wildcard: Column, s: TemplateSettings, prior: float) -> DataFrame:
    """Names of children become the wildcard where `fan` or more share it; children that stand out keep theirs."""
    child = child.withColumn("wild", wildcard)
    wide = child.groupBy(*_NODE, "wild").agg(F.count_distinct("name").alias("fan"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")).where(F.col("fan") >= s.fan)
    fits = F.col("fan").isNotNull() & ~_differs(s, prior, "fan", "all_bad", "all_labelled")
    child = child.join(wide, [*_NODE, "wild"], "left").withColumn("name", F.when(fits, F.col("wild")).otherwise(F.col("name")))
    return child.drop("wild", "fan", "all_labelled", "all_bad")


def _branches(state: DataFrame, s: TemplateSettings, prior: float) -> DataFrame:
    """host, prefix, seg, branch: what the next segments of the nodes' paths become."""
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    ahead = F.when(F.size("segs") > 1, _shape(F.col("segs")[1])).otherwise("")
    here = state.select(*_NODE, F.col("segs")[0].alias("seg"), ahead.alias("ahead"), "labelled", "bad")
    child = here.groupBy(*_NODE, "seg").agg(*sums, F.min("ahead").alias("lo"), F.max("ahead").alias("hi")).withColumn("shape", _shape(F.col("seg")))
    # wide nodes: many children of one shape, then many of any shape
    child = _widened(child.withColumn("name", F.col("seg")), F.col("shape"), s, prior)
    child = _widened(child, F.lit("*"), s, prior)
    few = child.groupBy(*_NODE, "name").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # like branches: names in order of share, cut where two neighbours differ, then those that differ from their whole group
    share, var = _share(F.col("bad"), F.col("labelled"), s, prior)
    few = few.withColumns({"share": share, "var": var})
    like = Window.partitionBy(*_NODE, "lo", "hi").orderBy("share", "name")
    cut = (F.col("share") - F.lag("share").over(like)) > s.z * F.sqrt(F.col("var") + F.lag("var").over(like))
    few = few.withColumn("cut", F.when(cut, 1).otherwise(0)).withColumn("grp", F.sum("cut").over(like.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*_NODE, "lo", "hi", "grp")
    few = few.withColumns({"members": F.count("*").over(inside), "all_labelled": F.sum("labelled").over(inside), "all_bad": F.sum("bad").over(inside)})
    few = few.withColumn("alone", (F.col("members") > 1) & _differs(s, prior, "members", "all_bad", "all_labelled"))
    fellows = Window.partitionBy(*_NODE, "lo", "hi", "grp", "alone")
    count, first = F.count("*").over(fellows), F.min("name").over(fellows)
    merged = F.concat(F.lit("("), first, F.lit("|+"), (count - 1).cast("string"), F.lit(")"))
    few = few.select(*_NODE, "name", F.when(F.col("alone") | (count == 1), F.col("name")).otherwise(merged).alias("branch"))
    return child.select(*_NODE, "seg", "name").join(few, [*_NODE, "name"]).select(*_NODE, "seg", "branch")


def path_templates(counts: DataFrame, s: TemplateSettings, prior: float) -> DataFrame:
    """counts: host, npath, n, labelled, bad, one row per host and path. Adds template, its bad_share and its verdict `rejected`."""
    parts = F.split(F.substring("npath", 2, 1 << 30), "/")
    state = counts.withColumn("prefix", F.lit("")).withColumn("segs", F.when(F.col("npath").startswith("/"), parts).otherwise(F.array().cast("array<string>")))
    state = state.select(*_NODE, "segs", "npath", "n", "labelled", "bad")
    steps = []
    while True:
        steps.append(materialize(_past_common(state)))
        ahead = steps[-1].where(F.size("segs") > 0)
        if not ahead.limit(1).count():
            break
        moved = ahead.withColumn("seg", F.col("segs")[0]).join(_branches(ahead, s, prior), [*_NODE, "seg"])
        state = moved.select("host", F.concat("prefix", F.lit("/"), "branch").alias("prefix"), F.slice("segs", F.lit(2), F.size("segs")).alias("segs"), "npath", "n", "labelled", "bad")
    ended = steps[0].where(F.size("segs") == 0)
    for step in steps[1:]:
        ended = ended.unionByName(step.where(F.size("segs") == 0))
    found = ended.groupBy(*_NODE).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    share, var = _share(F.col("bad"), F.col("labelled"), s, prior)
    found = materialize(found.select(*_NODE, "labelled", share.alias("bad_share"), var.alias("var")))
    tested = max(found.where("labelled > 0").count(), 1)
    surplus = F.col("bad_share") - s.lift * prior > F.sqrt(F.lit(s.reject_z**2 + 2 * math.log(tested)) * F.col("var"))
    known = F.lit(prior > 0) & (F.col("labelled") > 0)
    found = found.select(*_NODE, "bad_share", (known & ((F.col("bad_share") >= s.reject) | surplus)).alias("rejected"))
    out = materialize(ended.join(found, _NODE).select("host", "npath", F.col("prefix").alias("template"), "bad_share", "rejected"))
    for step in steps:
        release(step)
    return out


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[UrlRule], s: TemplateSettings = TemplateSettings()) -> DataFrame:
    """pages: page_id, url. labels: page_id, bad (0 or 1) of some pages. Rules win over templates."""
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("npath", _normal(F.col("path")))
    bad = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.avg("bad").alias("bad"))
    known = parted.join(bad, "page_id", "left")
    counts = materialize(known.groupBy("host", "npath").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    total = counts.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = float(total[1] or 0) / float(total[0]) if total[0] else 0.0
    templates = path_templates(counts, s, prior)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = parted.join(templates, ["host", "npath"], "left")
    method = F.when(F.col("rejected"), F.lit("block")).otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", F.round("bad_share", 9).alias("bad_share"))
