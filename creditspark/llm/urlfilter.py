"""Operator 5: URL filters by a path-template tree per host.

Fixed rules come first. For the other pages, each host's paths form a tree of
segments. A segment's shape (its digits and letters made alike) under one parent
becomes a wildcard if it varies: many different values, or mostly different ones
that hold digits. Going up, branches whose labelled bad shares do not differ (a
chi-squared test of homogeneity) are merged into their parent, so what is left
are the largest statistically uniform branches. A template is rejected if its
branch's share of bad labelled pages, smoothed towards the share of all pages, is
above that share by ``LIFT`` even at its lower bound, ``SURE_Z`` standard errors
down: a few bad labels say little, many say enough at any usual share.

Levels are aggregations and joins with small tables (a row per wildcard, open
node or rejected template, whose size is checked before it is broadcast), so a
host or template may hold any part of the pages. Below the first ``LEVELS``
levels a node is split only while its labelled pages differ, and segments that
all its pages share are passed in one step, so depth costs nothing; what is not
split any more ends in one tail segment.

Defined cases: a null url, or one without ``://``, has an empty host and path;
rows with equal page_ids are judged each; a page with several labels is bad if
one says so; without labels every template is allowed; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.shared import checked, cut

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LEVELS = 4
# A shape under one parent is a wildcard from so many different values on, if
# they are at least this share of its pages; with digits, from two on.
WILD_VALUES, WILD_SHARE, WILD_DIGITS_SHARE = 8, 0.2, 0.5
# Branches are kept apart if the test's statistic is in the upper 5 %.
APART_Z = 1.645
PRIOR_PAGES, LIFT, SURE_Z = 10.0, 1.5, 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one is asked before
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, "[0-9]+", "0"), r"\p{L}+", "a")


def _with_segment(rows: DataFrame) -> DataFrame:
    """``rows`` (host, template, segment, any others) with the segment, or the
    wildcard of its shape where that varies under its parent, at the template's
    end; a null segment ends the path."""
    rows = rows.withColumn("shape", shape(F.col("segment")))
    values = (rows.where("segment is not null").groupBy("host", "template", "shape", "segment").agg(F.count("*").alias("n"))
              .groupBy("host", "template", "shape").agg(F.count("*").alias("values"), F.sum("n").alias("n")))
    share = F.col("values") / F.col("n")
    wild = (((F.col("values") >= WILD_VALUES) & (share >= WILD_SHARE))
            | (F.col("shape").contains("0") & (F.col("values") >= 2) & (share >= WILD_DIGITS_SHARE)))
    values = checked(values.where(wild).select("host", "template", "shape", F.lit(True).alias("wild")))
    named = F.when(F.col("wild"), F.concat(F.lit("{"), F.col("shape"), F.lit("}"))).otherwise(F.col("segment"))
    grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.array(named)))
    return (rows.join(values, ["host", "template", "shape"], "left").withColumn("template", grown)
            .drop("wild", "segment", "shape"))


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    differs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, bad or null, any others) with template: the path's
    segments, of which those that vary under their parent are wildcards like
    {0}.{a}."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = cut(pages.withColumn("segments", segments).withColumn("template", F.array().cast("array<string>")))
    deepest = rows.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).head()[0]
    for level in range(min(LEVELS, deepest)):
        rows = cut(_with_segment(rows.withColumn("segment", F.get("segments", F.lit(level)))))
    rest = F.slice("segments", F.size("template") + 1, F.greatest(F.lit(0), F.size("segments") - F.size("template")))
    rows = rows.withColumn("rest", rest)
    ended = rows.where(F.size("rest") == 0)
    going = cut(rows.where(F.size("rest") > 0))
    closed = []
    while deepest > LEVELS:
        # Open nodes have good and bad pages below them: no more than there are labelled pages.
        nodes = (going.groupBy("host", "template").agg(F.min("bad").alias("lo"), F.max("bad").alias("hi"),
                                                       F.min("rest").alias("first"), F.max("rest").alias("last"))
                 .where("lo < hi").select("host", "template", _shared(F.col("first"), F.col("last")).alias("alike")))
        nodes = checked(nodes)
        if nodes.isEmpty():
            break
        joined = cut(going.join(nodes, ["host", "template"], "left"))
        closed.append(joined.where("alike is null").drop("alike"))
        # All pages below an open node share the least and the greatest rest's common
        # beginning: one step of the tree, as nothing branches within.
        common = F.array_join(F.slice("rest", F.lit(1), F.col("alike")), "/")
        open_ = joined.where("alike is not null").withColumn(
            "template", F.when(F.col("alike") > 0, F.concat("template", F.array(common))).otherwise(F.col("template")))
        open_ = open_.withColumn("segment", F.get("rest", F.col("alike")))
        open_ = open_.withColumn("rest", F.slice("rest", F.col("alike") + 2, F.greatest(F.lit(0), F.size("rest") - F.col("alike") - 1)))
        grown = cut(_with_segment(open_.drop("alike")))
        ended = ended.unionByName(grown.where(F.size("rest") == 0))
        going = cut(grown.where(F.size("rest") > 0))
    for part in (*closed, going):
        ended = ended.unionByName(part.withColumn("template", F.concat("template", F.array(F.lit("{*}")))))
    return cut(ended.drop("segments", "rest"))


def branches(counted: DataFrame) -> DataFrame:
    """``counted`` (host, template, labelled, bad) with branch: the highest
    ancestor below which the bad shares do not differ."""
    kept = counted.withColumn("branch", F.col("template"))
    # A node is whole if its children are and do not differ; leaves are whole.
    whole = counted.select("host", F.col("template").alias("node"), "labelled", "bad", F.lit(True).alias("whole"))
    deepest = counted.agg(F.coalesce(F.max(F.size("template")), F.lit(0))).head()[0]
    for level in range(deepest - 1, -1, -1):
        below = whole.where(F.size("node") > level)
        parent = F.slice("node", 1, level).alias("node")
        ends_here = whole.where(F.size("node") == level)
        children = below.select("host", parent, "labelled", "bad", "whole").unionByName(
            ends_here.select("host", "node", "labelled", "bad", "whole"))
        total = children.groupBy("host", "node").agg(
            F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min("whole").alias("all_whole"),
            F.sum(F.when(F.col("labelled") > 0, F.col("bad") * F.col("bad") / F.col("labelled"))).alias("squares"),
            F.count(F.when(F.col("labelled") > 0, 1)).alias("k"))
        p, df = F.try_divide("bad", "labelled"), F.greatest(F.col("k") - 1, F.lit(1))
        chi = F.when((F.col("bad") > 0) & (F.col("bad") < F.col("labelled")),
                     (F.col("squares") - F.col("bad") * p) / (p * (1 - p))).otherwise(0.0)
        limit = df * F.pow(1 - 2 / (9 * df) + APART_Z * F.sqrt(2 / (9 * df)), F.lit(3.0))
        same = (F.col("k") < 2) | (chi <= limit)
        nodes = cut(total.select("host", "node", "labelled", "bad", (F.col("all_whole") & F.coalesce(same, F.lit(True))).alias("whole")))
        open_ = nodes.where("whole").select("host", F.col("node").alias("up"), F.lit(True).alias("open"))
        kept = cut(kept.withColumn("up", F.slice("template", 1, level)).join(open_, ["host", "up"], "left")
                   .withColumn("branch", F.when(F.col("open") & (F.size("template") >= level), F.col("up")).otherwise(F.col("branch")))
                   .drop("up", "open"))
        whole = whole.where(F.size("node") < level).unionByName(nodes)
    return kept


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template for each row of ``pages``
    (page_id, url); ``labels`` (page_id, bad) may be of some pages."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    known = labels.where("bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).join(known, "page_id", "left")
    rows = templates(rows)
    counted = cut(rows.groupBy("host", "template").agg(
        F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    branched = branches(counted)
    whole = counted.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("share"))
    sums = branched.groupBy("host", "branch").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    share = float(whole.head()[0])
    pages_ = F.col("n") + PRIOR_PAGES
    purity = (F.col("b") + PRIOR_PAGES * share) / pages_
    sure = purity - SURE_Z * F.sqrt(purity * (1 - purity) / pages_)
    rejected = sums.where(sure > limit_of(share)).select("host", "branch", F.lit(True).alias("rejected"))
    bad = checked(branched.join(rejected, ["host", "branch"]).select("host", "template", "rejected"))
    out = rows.join(bad, ["host", "template"], "left")
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
                      F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"))


def limit_of(share: float) -> float:
    """The bad share that a rejected branch surely has, from that of all pages."""
    return min(LIFT * share, (1 + share) / 2)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and bad, from the labels of the document that a page shows: the
    last number in its path."""
    _, path = host_and_path(F.col("url"))
    shown = pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.regexp_extract(path, r"/([0-9]{1,18})[^/0-9]*/?$", 1).alias("number"))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).alias("bad"))
    return (shown.where("number <> ''").withColumn("doc_id", F.col("number").cast("long"))
            .join(known, "doc_id").select("page_id", "bad"))
