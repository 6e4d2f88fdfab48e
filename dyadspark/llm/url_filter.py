"""URL verdicts by rules and by a tree of path templates per host.

Rules such as ``com/fr/`` fit a host, its subdomains and all paths that begin alike; the longest rule wins. Every other
url is judged by its template:

1. Numbers in a path become ``<n>``; urls are counted by (host, path) with the labels of those that have one.
2. From the root down, a segment keeps its name if it has ``SUPPORT`` labels and its share of good ones differs from its
   siblings' by a likelihood-ratio test, corrected for the number of siblings tested; all other siblings are merged into
   the wildcard ``*``. What a segment's share of its node's urls is and how deep it lies does not matter. Below nodes
   with fewer labels than that nothing can be told apart, so the rest of their paths is written as wildcards at once.
3. A template is rejected if its purity is too low. Purity is the share of good labels, smoothed towards the host's,
   which is smoothed towards that of all labels.

Only counts per node are shuffled for the tree, after partial sums, so a host with a third of all urls is no hot key.
Null urls and those without ``://`` have an empty host and path and are judged as one template; repeated rows alike.
Without labels everything that no rule blocks is allowed.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.session import stored

SUPPORT = 5  # labels of a segment that is tested
SIGNIFICANT = 2.58  # standard errors, where one segment is tested
SMOOTH = 20.0  # labels that the prior counts for
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), pattern, k)
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Segments of a path with numbers as ``<n>``."""
    return F.split(F.regexp_replace(path, "[0-9]+", "<n>"), "/")


def likelihood_ratio(good: Column, labelled: Column, all_good: Column, all_labelled: Column) -> Column:
    """Twice the log likelihood ratio of two shares, a segment's and its siblings', against one; chi-square of one degree."""
    part = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    split = lambda g, n: part(g) + part(n - g) - part(n)
    return 2 * (split(good, labelled) + split(all_good - good, all_labelled - labelled) - split(all_good, all_labelled))


def templates(counted: DataFrame) -> DataFrame:
    """(host, parts, template) for every row of (host, parts, n, good, labelled), level by level. Stored.

    The rows are distinct (host, parts); at each level their prefix grows by the segment or by a wildcard.
    """
    now = counted.withColumn("template", F.lit(""))
    for level in count():
        segment = F.get("parts", F.lit(level))
        here = now.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment"))
        child = here.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
        tested = F.count(F.when(F.col("labelled") >= SUPPORT, 1)).alias("tested")
        node = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "good", "labelled")], tested)
        both = child.join(node, ["host", "template"])
        ratio = likelihood_ratio(F.col("good"), F.col("labelled"), F.col("all_good"), F.col("all_labelled"))
        # A normal tail falls at least as fast as exp(-z^2 / 2), so this divides the level by the number of tests or more.
        differs = (F.col("labelled") >= SUPPORT) & (ratio >= SIGNIFICANT**2 + 2 * F.ln("tested"))
        only = F.col("n") == F.col("all_n")
        named = both.where(only | differs).select("host", "template", "segment", F.lit(True).alias("named"))
        step = now.withColumn("segment", segment).join(named, ["host", "template", "segment"], "left")
        label = F.when(F.col("named"), F.col("segment")).otherwise("*")
        longer = F.when(F.col("segment").isNull(), F.col("template")).otherwise(
            F.concat("template", F.lit("/" if level else ""), label)
        )
        now = stored(step.withColumn("template", longer).select(*now.columns))
        below = now.where(F.size("parts") > level + 1).groupBy("host", "template").agg(F.sum("labelled").alias("labelled"))
        most = below.agg(F.max("labelled")).first()[0]
        if most is None:
            break
        if most < SUPPORT:  # no segment further down can be tested
            rest = F.expr(f"repeat('/*', greatest(size(parts) - {level + 1}, 0))")
            return now.withColumn("template", F.concat("template", rest))
    return now


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for every page. ``labels`` has (``url``, ``good`` 0 or 1)."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    host_, path_ = host_and_path(F.col("url"))
    known = labels.where("good is not null").select(host_.alias("host"), segments(path_).alias("parts"), F.col("good").cast("long"))
    urls = rows.select("host", segments(F.col("path")).alias("parts"), F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("labelled"))
    said = known.select("host", "parts", F.lit(0).alias("n"), "good", F.lit(1).alias("labelled"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "labelled")]
    counted = stored(urls.unionByName(said).groupBy("host", "parts").agg(*sums))
    tree = templates(counted)

    total = counted.agg(*sums).first()
    base = (total["good"] + SMOOTH) / (total["labelled"] + SMOOTH) if total["labelled"] else 1.0
    smooth = lambda prior: (F.col("good") + SMOOTH * prior) / (F.col("labelled") + SMOOTH)
    hosts = counted.groupBy("host").agg(*sums).select("host", smooth(F.lit(base)).alias("host_purity"))
    purity = tree.groupBy("host", "template").agg(*sums).join(hosts, "host").select("host", "template", smooth(F.col("host_purity")).alias("purity"))
    place = stored(tree.join(purity, ["host", "template"]).select("host", "parts", "template", "purity"))
    both = rows.withColumn("parts", segments(F.col("path"))).join(place, ["host", "parts"])
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < REJECT, "block").otherwise("allow")
    found = both.withColumn("found", rule) if rules else both.withColumn("found", F.expr("cast(null as struct<rule:string,verdict:string>)"))
    return found.select(
        key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "template", "purity"
    )
