"""URL rules by a sort-merge range join, in DataFrame operations only.

A host read from its end, label by label and with a closing dot, turns "this host and all below" into a prefix, and a
prefix is an interval of sorted keys. Such intervals nest or lie apart. Rules and pages are swept twice in the
order of their keys: over reversed hosts, which gives each host the rule hosts open at its place, and below each of
these over paths. A sweep keeps a stack of open rules: at each rule the ones that don't reach this far are taken
off and the rule is put on top; a page finds its rules on the stack of the latest rule before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heliograph.llm.common import ascii_lower, fresh

#: Rules that one fold of the stack runs over.
BLOCK = 256
#: Pages of one group from which they are dealt to several sweeps.
POINTS = 1_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _reversed(host: Column) -> Column:
    """A host's labels from the last to the first, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top_label(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def rule_stacks(rules: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group, key, stack): of rules (group, key, entry), one per group and key, the rules open at each one's
    start, outermost first, itself included.

    The stack is folded over sorted blocks of rules. Where a block starts, the stack is made of the prefixes
    of its first key that are rules.
    """
    item = f"struct<key:string,entry:{rules.schema['entry'].dataType.simpleString()}>"
    empty = F.array().cast(f"array<{item}>")
    number = F.row_number().over(W.partitionBy("group").orderBy("key")) - 1
    numbered = rules.withColumn("at", number).withColumn("block", F.floor(F.col("at") / block))
    heads = numbered.filter((F.col("at") % block == 0) & (F.col("at") > 0) & (F.length("key") > 0))
    cuts = heads.select("group", "block", "key", F.explode(F.sequence(F.lit(0), F.length("key") - 1)).alias("cut"))
    cuts = cuts.select("group", "block", F.substring("key", F.lit(1), F.col("cut")).alias("key"))
    carried = cuts.join(rules, ["group", "key"]).groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("key", "entry"))).alias("carried"))
    blocks = numbered.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("key", "entry"))).alias("rules"))
    blocks = blocks.join(carried, ["group", "block"], "left").withColumn("carried", F.coalesce("carried", empty))

    def step(state: Column, rule: Column) -> Column:
        still = F.filter(state["stack"], lambda open_: F.startswith(rule["key"], open_["key"]))
        stack = F.concat(still, F.array(rule))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.struct(rule["key"].alias("key"), stack.alias("stack")))).alias("out"))

    start = F.struct(F.col("carried").alias("stack"), F.array().cast(f"array<struct<key:string,stack:array<{item}>>>").alias("out"))
    return blocks.select("group", F.inline(F.aggregate("rules", start, step)["out"]))


def sweep_rows(rules: DataFrame, points: DataFrame, salts: int | None = None) -> DataFrame:
    """Rows of one sweep: rules with their stacks, and points (group, key, …), with the `salt` of a sweep.

    Points of a group are dealt to several sweeps if they are more than POINTS and more than the group's
    rules, and only to so many that the copies of the rules are no more than the points.
    """
    stacks = rule_stacks(rules)
    own = rules.groupBy("group").agg(F.count(F.lit(1)).alias("own"))
    if salts is None:
        sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(own, "group")
        dealt = sizes.select("group", F.ceil(F.col("n") / F.greatest("own", F.lit(POINTS))).cast("int").alias("sweeps"))
    else:
        dealt = own.select("group", F.lit(salts).alias("sweeps"))
    # A group without rules, or without points, drops out here. The key is made anew, so that Spark can split
    # the points of a busy group.
    dealt = dealt.select(F.struct("group").alias("own_group"), "sweeps")

    def with_sweeps(df: DataFrame) -> DataFrame:
        return df.withColumn("own_group", F.struct("group")).join(dealt, "own_group").drop("own_group")

    starts = with_sweeps(stacks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1))).drop("sweeps")
    at = with_sweeps(points).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("sweeps")).cast("int")).drop("sweeps")
    return starts.withColumn("turn", F.lit(0)).unionByName(at.withColumn("turn", F.lit(1)), allowMissingColumns=True)


def open_rules(rules: DataFrame, points: DataFrame, salts: int | None = None) -> DataFrame:
    """Points with `stack`: the rules of their group whose keys are prefixes of theirs, outermost first."""
    # One value for both: rows that lie together by group already would else not be dealt out by salt.
    sweep = W.partitionBy("sweep").orderBy("key", "turn").rowsBetween(W.unboundedPreceding, 0)
    rows = sweep_rows(rules, points, salts).withColumn("sweep", F.struct("group", "salt"))
    swept = rows.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("turn = 1")
    return swept.withColumn("stack", F.filter("stack", lambda rule: F.startswith(F.col("key"), rule["key"]))).drop("salt", "turn", "sweep")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_column: str = "url", otherwise: str = "allow", salts: int | None = None
) -> DataFrame:
    """Pages with `host`, `path`, the deciding `rule` (host and path; null if none fits) and `verdict`.

    A rule fits its host and all subdomains where the page's path starts with the rule's path. The
    longest rule wins, by length of path and host together, then by host. Of two rules with equal host
    and path, the one that allows wins. Pages without rule get `otherwise`.

    `salts` deals every group of a sweep to so many sweeps; if it isn't given, only busy groups are dealt, by
    their counted size.

    Nulls and URLs without "://" have empty host and path; rules without host or path fit nothing; empty tables give
    empty results; repeated URLs are judged once and looked up; columns of `pages` are kept, whatever
    their names, and those named like the four results are replaced.
    """
    host, path = url_parts(F.col(url_column))
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url_column}))
    h, p, h2, p2 = (fresh(pages.columns, name) for name in ("_host", "_path", "_h", "_p"))
    parted = pages.withColumn(h, host).withColumn(p, path)
    urls = parted.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct()
    named = rules.filter("host IS NOT NULL AND path IS NOT NULL").withColumn("group", _reversed(F.col("host")))
    named = named.groupBy("group", F.col("path").alias("key")).agg(F.min(F.struct("verdict", F.concat("host", "path").alias("rule"))).alias("entry"))
    ruled = named.select(_top_label(F.col("group")).alias("group"), F.col("group").alias("key"), F.lit(True).alias("entry")).distinct()
    hosts = urls.select("host").distinct().withColumn("key", _reversed(F.col("host"))).withColumn("group", _top_label(F.col("key")))
    within = open_rules(ruled, hosts, salts).select(F.col("host").alias("_host"), F.explode("stack.key").alias("group"))
    probes = urls.join(within, F.col("host") == F.col("_host")).select("group", F.col("path").alias("key"), "host")
    found = open_rules(named, probes, salts).withColumn("top", F.try_element_at("stack", F.lit(-1))["entry"]).filter("top IS NOT NULL")
    longest = F.max(F.struct(F.length("top.rule").alias("n"), F.length("group").alias("h"), F.col("top")))
    decided = found.groupBy("host", "key").agg(longest.alias("best"))
    decided = decided.select(F.col("host").alias(h2), F.col("key").alias(p2), "best.top.rule", "best.top.verdict")
    judged = parted.join(decided, (F.col(h) == F.col(h2)) & (F.col(p) == F.col(p2)), "left").drop(h2, p2)
    out = judged.withColumnRenamed(h, "host").withColumnRenamed(p, "path")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
