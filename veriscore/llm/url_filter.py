"""URL filters: explicit rules, and per host a tree of path templates judged by labelled purity. DataFrame functions only.

Rules: `host/path` fits the host and its subdomains where the url's path starts with the rule's; the longest that fits wins.
Where none fits, the method decides:

1. Paths become segments, all of them. Numbers and long hexadecimal words are wildcards at once.
2. Level by level, a branch's children whose labelled shares differ from that of their siblings (two-proportion test) leave it, those
   above and those below as a branch each, until no child differs; the children that stay are one wildcard, at any number of urls.
   Similar branches are one at every level.
3. A branch ends where its labels agree or its paths end; levels at which none of its paths part are passed over.
4. The same tree is grown once more over the paths of all hosts together (as the host `/`, which no url has), so each template has a
   purity wherever it occurs, smoothed towards all urls' share.
5. A branch's purity is its share of blocked among labelled urls, smoothed towards its host's share, which is smoothed towards the
   purity of the url's template over all hosts: a host without labels is judged by what its templates are elsewhere. Urls whose
   purity is at or over `reject` are blocked, others allowed.

Labels are those of a table `labels` (url, bad) where it has the url, else the rules' (a url under a block rule is bad, under an allow
rule good). No words of hosts or paths are known to it. Null urls and urls without :// have an empty host and path and are judged like any
host. Repeated rows get a row each; of a url with several labels the worst counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_split, staged

#: (rule, verdict), fixed by the contract of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Stands for all hosts together; a url's host holds no slash.
ALL = "/"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between :// and the next / ? #, lower-cased; path up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, prefix = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")


def by_rules(rules, host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        out = F.when(fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parts_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def shape(s: Column) -> Column:
    """A segment, a plain variable as wildcard."""
    ext = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    return F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), F.concat(F.lit("{n}"), ext)).when(s.rlike("^[0-9a-fA-F]{8,}$"), F.lit("{h}")).otherwise(s)


def tree_branches(nodes: DataFrame) -> DataFrame:
    """(node, host, segs, urls, branch, labelled, blocked) of nodes (node, host, segs, urls, labelled, blocked)."""
    rows = nodes.select("node", "host", "segs", "urls", "labelled", "blocked", F.xxhash64("host").alias("branch"), F.lit(0).alias("depth"))
    done = []
    while True:
        rows = staged(rows, "branches")
        n = rows.count()
        if not n:
            break
        rest = F.when(F.size("segs") > F.col("depth"), F.slice("segs", F.col("depth") + 1, F.greatest(F.size("segs") - F.col("depth"), F.lit(0))))
        totals = rows.groupBy("branch").agg(F.sum("labelled").alias("bl"), F.sum("blocked").alias("bb"), F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.count("*").alias("nodes"))
        ended = (F.col("bb") == 0) | (F.col("bb") == F.col("bl")) | F.col("lo").isNull()
        same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
        shared = F.when(F.exists(same, lambda e: ~e), F.array_position(same, False) - 1).otherwise(F.size("lo"))
        totals = staged(totals.select("branch", "bl", "bb", "nodes", ended.alias("ended"), F.greatest(shared, F.lit(1)).cast("int").alias("step")), "totals")
        # Written, so that what ends here is a scan in the union of all rounds, and the next round's plan is one of scans as well.
        placed = staged(joined_split(rows, totals, ["branch"], F.col("nodes"), n), "placed")
        done.append(placed.where("ended").select("node", "host", "segs", "urls", "branch", "labelled", "blocked"))
        going = placed.where("NOT ended").withColumn("child", F.coalesce(F.get("segs", F.col("depth")), F.lit("")))
        children = going.groupBy("branch", "child", "bl", "bb").agg(F.sum("labelled").alias("cl"), F.sum("blocked").alias("cb"))
        pooled = F.col("bb") / F.col("bl")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "cl") + F.try_divide(F.lit(1.0), F.col("bl") - F.col("cl"))))
        gap = F.try_divide("cb", "cl") - F.try_divide(F.col("bb") - F.col("cb"), F.col("bl") - F.col("cl"))
        sides = staged(children.select("branch", "child", F.when(gap > 1.96 * error, 1).when(gap < -1.96 * error, -1).otherwise(0).alias("side")), "sides")
        parts = sides.where("side <> 0").select("branch", F.lit(True).alias("parts")).distinct()
        moved = going.join(sides, ["branch", "child"]).join(parts, "branch", "left")
        rows = moved.select(
            "node", "host", "segs", "urls", "labelled", "blocked",
            F.when(F.col("parts"), F.xxhash64("branch", "depth", "side")).otherwise(F.col("branch")).alias("branch"),
            F.when(F.col("parts"), F.col("depth")).otherwise(F.col("depth") + F.col("step")).alias("depth"),
        )
    return reduce(DataFrame.unionByName, done) if done else nodes.select("node", "host", "segs", "urls", F.lit(0).cast("long").alias("branch"), "labelled", "blocked")


def tree_url_verdicts(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, reject: float = 0.8, weight: float = 5.0) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url), by the whole tree."""
    host, path = split_url(F.col("url"))
    given = by_rules(rules, F.col("host"), F.col("path"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_r", given)
    shaped = base.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("given"), F.transform(parts_of(F.col("path")), shape).alias("segs"))
    label = F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0)
    if labels is not None:
        own = labels.groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("own"))
        shaped, label = shaped.join(own, "url", "left"), F.coalesce("own", label)
    shaped = shaped.withColumn("label", label).withColumn("node", F.xxhash64("host", F.concat_ws("/", "segs"))).drop("url")
    if labels is not None:
        shaped = staged(shaped, "shaped")  # read three times, and here behind a join
    nodes = staged(shaped.groupBy("node", "host", "segs").agg(F.count("*").alias("urls"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "nodes")
    sums = nodes.agg(F.try_divide(F.sum("blocked"), F.sum("labelled")).alias("p"), F.sum("urls").alias("n")).first()
    prior, total = sums["p"] or 0.0, sums["n"] or 0
    everywhere = nodes.groupBy("segs").agg(*(F.sum(c).alias(c) for c in ("urls", "labelled", "blocked"))).select(F.xxhash64(F.lit(ALL), F.concat_ws("/", "segs")).alias("node"), F.lit(ALL).alias("host"), "segs", "urls", "labelled", "blocked")
    own = ["node", "host", "segs", "urls", "labelled", "blocked"]
    tree = staged(tree_branches(nodes.select(*own).unionByName(everywhere)), "tree")
    sides = staged(tree.groupBy("host", "branch").agg(F.sum("labelled").alias("tl"), F.sum("blocked").alias("tb"), F.count("*").alias("nodes")), "purity")
    shared = sides.where(F.col("host") == ALL).select("branch", ((F.col("tb") + weight * prior) / (F.col("tl") + weight)).alias("elsewhere"), "nodes")
    templates = tree.where(F.col("host") == ALL)
    known = joined_split(templates, shared, ["branch"], F.col("nodes"), templates.count()).select("segs", "elsewhere")
    hosts = nodes.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("labelled").alias("hl"))
    judged = sides.where(F.col("host") != ALL).join(hosts, "host")
    branches = joined_split(tree.where(F.col("host") != ALL), judged, ["host", "branch"], F.col("nodes"), tree.count())
    host_share = (F.col("hb") + weight * F.col("elsewhere")) / (F.col("hl") + weight)
    purity = (F.col("tb") + weight * host_share) / (F.col("tl") + weight)
    verdicts = branches.join(known, "segs").select("node", "host", "segs", "urls", (purity >= reject).alias("bad"))
    out = joined_split(shaped, staged(verdicts, "verdicts"), ["node", "host", "segs"], F.col("urls"), total)  # host and segments too: two nodes may have one hash
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
