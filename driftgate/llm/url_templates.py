"""URL filter: host and path rules first, then a tree of path templates per host.

Paths are cut in segments. Level by level, under each (host, template so far):

* branches with enough labels whose share of good ones differs significantly from that of all
  other branches of their parent, whatever their number of urls, are put in bins by that share;
  adjacent bins that do not differ significantly are merged. A branch alone in its group keeps
  its name, the others are named ``~`` and the group's first one;
* of the rest, segments with a digit and those too rare below their parent become ``*``;
  branches with enough labels are one group, and those with too few to tell become ``~``.

A template's purity is its share of good labels, smoothed towards the share of all labels. A
url that no rule judges is blocked if its template's purity is too low.

Urls are first counted by host and shape (digits replaced), so the tree is built from counts
and a hot host is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch

#: Least urls and share of its parent's urls of a segment that keeps its name although its labels are like the others'.
MIN_COUNT, MIN_SHARE = 20, 0.01
#: Least labels of a branch that is compared, the z value from which two differ, and the bins
#: of the share of good labels.
MIN_LABELS, Z, BINS = 10, 2.58, 50
#: Weight of the share of all labels in a purity, and the purity below which is blocked.
WEIGHT, PURITY = 10.0, 0.5
#: Segments from this one on count as one.
DEPTH = 12


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    without it or for a null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, "host/path") rules that fits, as struct (rule, verdict);
    null if none does. A rule fits its host and all subdomains if the path starts with its."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _z(g1: Column, n1: Column, g2: Column, n2: Column) -> Column:
    """How far the share of good labels g2 / n2 lies above g1 / n1, in standard errors."""
    n1, n2 = F.greatest(n1, F.lit(1)), F.greatest(n2, F.lit(1))
    p = (g1 + g2) / (n1 + n2)
    return (g2 / n2 - g1 / n1) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n2))


def template_tree(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, n, labels, good)."""
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    segments = F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH - 1), F.array(F.array_join(F.slice(segments, DEPTH, 1 << 30), "/")))) \
        .otherwise(segments)
    tree = scratch.write(shapes.withColumn("segments", segments).withColumn("template", F.lit("")))
    all_ = shapes.agg(F.sum("labels"), F.sum("good")).first()
    prior = (all_[1] + 1.0) / (all_[0] + 2.0) if all_[0] else 1.0
    depth = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for k in range(depth):
        seg = F.get("segments", F.lit(k))
        at = tree.withColumn("seg", seg)
        parts = ["host", "template"]
        branch = scratch.write(at.filter("seg is not null").groupBy(*parts, "seg").agg(
            F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("good").alias("good")))
        parent = branch.groupBy(*parts).agg(F.sum("n").alias("pn"), F.sum("labels").alias("pl"), F.sum("good").alias("pg"))
        n, labels, good, pn, pl, pg = (F.col(c) for c in ("n", "labels", "good", "pn", "pl", "pg"))
        tested = (labels >= MIN_LABELS) & (pl - labels >= MIN_LABELS)
        differs = tested & (F.abs(_z(pg - good, pl - labels, good, labels)) >= Z)
        rare = (n < MIN_COUNT) | (n < pn * MIN_SHARE)
        kind = F.when(differs, "differs").when(F.col("seg").contains("0"), "variable").when(rare, "rare") \
            .when(labels < MIN_LABELS, "unknown").otherwise("alike")
        bin = F.when(differs, F.least(F.floor(good * BINS / F.greatest(labels, F.lit(1))), F.lit(BINS - 1))).otherwise(-1)
        b = scratch.write(branch.join(parent, parts).select(*parts, "seg", "labels", "good", kind.alias("kind"), bin.cast("int").alias("bin")))
        # At most BINS + 1 rows a parent, in order of the share of good labels; a new group where
        # it jumps. The branches that do not differ are bin -1, always a group.
        bins = b.filter("kind in ('differs', 'alike')").groupBy(*parts, "bin").agg(
            F.sum("labels").alias("labels"), F.sum("good").alias("good"), F.count("*").alias("size"), F.min("seg").alias("first"))
        by_share = Window.partitionBy(*parts).orderBy("bin")
        last = lambda c: F.lag(c).over(by_share)
        jump = (last("bin") == -1) | (_z(last("good"), last("labels"), good, labels) >= Z)
        bins = bins.withColumn("jump", F.when(jump, 1).otherwise(0))
        bins = bins.withColumn("group", F.sum("jump").over(by_share.rowsBetween(Window.unboundedPreceding, 0)))
        of_group = Window.partitionBy(*parts, "group")
        bins = bins.select(*parts, "bin", F.sum("size").over(of_group).alias("size"), F.min("first").over(of_group).alias("first"))
        known = b.filter("kind in ('differs', 'alike')").join(bins, [*parts, "bin"]).select(
            *parts, "seg", F.when(F.col("size") == 1, F.col("seg")).otherwise(F.concat(F.lit("~"), "first")).alias("name"))
        other = F.when(F.col("kind") == "variable", F.concat(F.lit("*"), F.regexp_extract("seg", r"(\.[A-Za-z]+)$", 1))) \
            .when(F.col("kind") == "rare", "*").otherwise("~")
        names = b.filter("kind not in ('differs', 'alike')").select(*parts, "seg", other.alias("name")).union(known)
        tree = scratch.write(at.join(names, ["host", "template", "seg"], "left").withColumn(
            "template", F.when(F.col("name").isNotNull(), F.concat("template", F.lit("/"), "name")).otherwise(F.col("template"))).drop("seg", "name"))
    purity = tree.groupBy("host", "template").agg(((F.sum("good") + WEIGHT * prior) / (F.sum("labels") + WEIGHT)).alias("purity"))
    return tree.select("host", "shape", "template").join(purity, ["host", "template"])


def url_filter(urls: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", label: str = "label") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row of ``urls``.

    ``label`` is true (good), false or null for each url. A null url, or one without ``://``,
    has an empty host and path and is judged like others of the kind. Repeated rows are judged
    alike, each counting; a null id stays null; an empty table gives no rows. Other columns
    play no part.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    base = urls.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(label).cast("boolean").alias("label"))
    base = scratch.write(base.withColumn("shape", F.regexp_replace("path", "[0-9]+", "0")))
    shapes = scratch.write(base.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("labels"), F.count(F.when(F.col("label"), 1)).alias("good")))
    judged = scratch.write(template_tree(shapes, scratch))
    out = base.join(judged, ["host", "shape"], "left").withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "template", "purity")
