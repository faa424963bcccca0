"""URL filter: a tree of path templates per host.

Level by level, a path segment stays a branch of its own where ``SUPPORT`` pages have
it, however many its parent has; all other segments of that parent fall into one
wildcard.  Levels go on as deep as so many pages go.  Branches of one parent are
merged in order of their labelled shares of bad pages while a branch does not differ
more than chance allows from the pooled share of the group it would join.  Groups
with too few labels pool with others of their parent, then of its parent and so on.
A group is rejected when its share, smoothed towards the share of all labelled pages,
is too high.  Written rules come first.

Branches are counted and joined by shuffle.  Merging sees no branches but their sums
in bins of share and weight, whose number is bounded.

Defined results: a null url or one without ``://`` has an empty host and path and no
segments; pages without labels are judged by the branches they fall into; without
any label nothing is rejected; repeated rows count and are judged each for itself;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import url_parts

LEVELS = 4096  # segments, more than servers take in a path; what is deeper is one tail
BRANCHES = math.inf  # a branch holds at least 1 / BRANCHES of its parent's pages: no share is asked
SUPPORT = 5  # a branch holds at least so many pages
Z = 1.64  # standard errors between shares that count as different
PRIOR = 4.0  # labelled pages that the overall share is worth
PURITY = 0.6  # smoothed share of bad pages from which a branch is rejected
LABELLED = 3  # labelled pages that a rejected branch has at least
BINS = 250  # of a branch's share, with an edge at PURITY

# (host, path, verdict); the longest that fits wins.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
WILD, TAIL = "*", "**"


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def templates(pages: DataFrame, levels: int = LEVELS, branches: float = BRANCHES, support: int = SUPPORT) -> DataFrame:
    """``pages`` (host, path, ...) with parent and template of each page's path."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("segments", segments).withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    rows = materialize(rows, "urls")
    done = []
    for level in range(levels):
        here = rows.withColumn("segment", F.get("segments", F.lit(level)))
        child = here.where("segment is not null").groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"))
        child = materialize(child, "children")
        node = child.groupBy("host", "template").agg(F.sum("n").alias("total"))
        # Below a node with fewer pages no segment can have enough: wildcards to the end.
        node = materialize(node.where(F.col("total") >= support), "nodes")
        if node.isEmpty():
            break
        fair = F.col("n") >= support
        if branches != math.inf:
            fair &= F.col("n") * branches >= F.col("total")
        kept = child.where(F.col("n") >= support).join(node, ["host", "template"]).where(fair)
        kept = kept.select("host", "template", "segment", F.lit(True).alias("own"))
        done.append(here.where("segment is null").drop("segment"))
        name = F.when(F.col("own"), F.col("segment")).otherwise(WILD)
        rows = here.where("segment is not null").join(kept, ["host", "template", "segment"], "left").withColumns({
            "parent": F.col("template"), "template": F.concat("template", F.lit("/"), name),
        }).drop("segment", "own")
        rows = materialize(rows, "urls")
    else:
        level = levels
    deep = F.size("segments") > levels
    rest = F.greatest(F.least(F.size("segments"), F.lit(levels)) - level, F.lit(0))
    wild = F.lit("/" + WILD)
    rows = rows.withColumns({
        "parent": F.when(rest > 0, F.concat("template", F.repeat(wild, rest - 1))).otherwise(F.col("parent")),
        "template": F.concat("template", F.repeat(wild, rest)),
    }).withColumns({
        "parent": F.when(deep, F.col("template")).otherwise(F.col("parent")),
        "template": F.when(deep, F.concat("template", F.lit("/" + TAIL))).otherwise(F.col("template")),
    })
    for part in done:
        rows = rows.unionByName(part)
    return rows.drop("segments")


def merge_starts(bins: DataFrame, z: float) -> DataFrame:
    """(host, parent, starts): codes of the bins where a new group begins.

    ``bins`` has (host, parent, code, weight, mass: rates times weights, branches).
    """
    step = F.array_sort(F.collect_list(F.struct("code", "weight", "mass", "branches")))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("mass"))

    def join(group: Column, x: Column) -> Column:
        p, m = group["mass"] / group["weight"], group["weight"]
        q, n = x["mass"] / x["weight"], x["weight"] / x["branches"]  # the mean branch of the bin
        both = (p * m + q * n) / (m + n)
        # Rounding may carry a share of 1 past it.
        spread = F.sqrt(F.greatest(both * (1 - both), F.lit(0.0)) * (1 / m + 1 / n))
        apart = (m == 0) | (F.abs(q - p) > z * spread + 1e-12)
        return F.when(apart, F.struct(
            F.concat(group["starts"], F.array(x["code"])).alias("starts"), x["weight"].alias("weight"), x["mass"].alias("mass"),
        )).otherwise(F.struct(
            group["starts"].alias("starts"), (m + x["weight"]).alias("weight"), (group["mass"] + x["mass"]).alias("mass"),
        ))

    arrays = bins.groupBy("host", "parent").agg(step.alias("bins"))
    return arrays.select("host", "parent", F.aggregate("bins", start, join)["starts"].alias("starts"))


def branch_purity(rows: DataFrame, z: float = Z, prior: float = PRIOR, least: int = LABELLED) -> DataFrame:
    """(host, template, labelled, purity) after merging similar branches of a parent."""
    leaf = rows.groupBy("host", "parent", "template").agg(
        F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    )
    leaf = materialize(leaf, "branches")
    overall = leaf.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("share"))
    leaf = leaf.crossJoin(F.broadcast(overall))  # one row
    weight = F.col("labelled") + prior
    leaf = leaf.withColumn("rate", (F.col("bad") + prior * F.col("share")) / weight).withColumn("weight", weight)
    # Share first, then the power of two of the weight.
    code = F.floor(F.col("rate") * BINS) * 64 + F.floor(F.log2("weight"))
    leaf = leaf.withColumn("code", code.cast("int"))
    bins = leaf.groupBy("host", "parent", "code").agg(
        F.sum("weight").alias("weight"), F.sum(F.col("rate") * F.col("weight")).alias("mass"), F.count(F.lit(1)).alias("branches")
    )
    groups = bins.select("host", "parent", "code").join(merge_starts(bins, z), ["host", "parent"]).select(
        "host", "parent", "code", F.size(F.filter("starts", lambda s: s <= F.col("code"))).alias("branch")
    )
    named = materialize(leaf.join(groups, ["host", "parent", "code"]), "named")
    counts = [F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")]
    key = ["host", "parent", "branch"]
    merged = named.join(named.groupBy(*key).agg(*counts), key)
    columns = ["host", "template", "share", "all_labelled", "all_bad"]
    settled = [merged.where(F.col("all_labelled") >= least).select(*columns)]
    # What has too few labels pools with the like at its parent, then one step up.
    left = merged.where(F.col("all_labelled") < least).select(
        "host", "template", "share", "labelled", "bad", F.col("parent").alias("at")
    )
    left = materialize(left, "left")
    depth = F.length("at") - F.length(F.replace("at", F.lit("/"), F.lit("")))
    top = left.agg(F.max(depth)).first()[0]
    for level in range(-1 if top is None else top, -1, -1):
        now = left.where(depth == level)
        pooled = now.join(now.groupBy("host", "at").agg(*counts), ["host", "at"])
        enough = F.col("all_labelled") >= (least if level else 0)
        settled.append(pooled.where(enough).select(*columns))
        up = pooled.where(~enough).withColumn("at", F.regexp_replace("at", "/[^/]*$", "")).select(*left.columns)
        if level:
            left = materialize(left.where(depth < level).unionByName(up), "left")
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        "host", "template", F.col("all_labelled").alias("labelled"),
        ((F.col("all_bad") + prior * F.col("share")) / (F.col("all_labelled") + prior)).alias("purity"),
    )


def judge(pages: DataFrame, rules=RULES, purity: float = PURITY, labelled: int = LABELLED) -> DataFrame:
    """Verdicts for ``pages`` (page_id, url, bad: 0, 1 or null)."""
    host, path = url_parts(F.col("url"))
    rows = templates(pages.select("page_id", host.alias("host"), path.alias("path"), "bad"))
    found = branch_purity(rows)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("purity") >= purity) & (F.col("labelled") >= labelled), "block").otherwise("allow")
    return rows.join(found, ["host", "template"]).select(
        "page_id", "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], method).alias("verdict"), "template", "labelled",
        F.round("purity", 9).alias("purity"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad): a page is bad if the document its url numbers is labelled so.

    The number is the last run of digits of the url's path.
    """
    _, path = url_parts(F.col("url"))
    number = F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1)
    bad = ((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    one = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max(bad).alias("bad"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("number", F.when(number != "", number.cast("long")))
    return rows.join(one, "number", "left").select("page_id", "url", "bad")
