"""URL rules as a sort-merge range join, with built-in expressions only.

A rule's host, its labels reversed, and its path make a canonical key; the URLs a rule covers at
one host level are the interval of keys that begin with it. Rules and URL keys are sorted
together; a sweep carries the stack of rules that are open (a rule and those it nests in), and a
URL takes the longest open rule that its key begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 100_000  # URL keys of one host level that one sorted run may hold


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; '' without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(node, path, stack): each rule with the rules of its host that it nests in, itself included.

    Rules are (host, path, verdict); of rules for one (host, path) a block wins. NULL hosts or
    paths make no rule. The nesting comes from joining each proper prefix of the path.
    """
    one = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
           .select(reversed_host(F.col("host")).alias("node"), "path",
                   F.concat("host", "path").alias("rule"), "verdict"))
    prefixes = one.select("node", F.col("path").alias("own"), F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("path"))
    return (prefixes.join(one, ["node", "path"]).groupBy("node", "own")
            .agg(F.collect_list(F.struct("path", "rule", "verdict")).alias("stack"))
            .select("node", F.col("own").alias("path"), "stack"))


def match_urls(keys: DataFrame, rules: DataFrame, run: int = RUN) -> DataFrame:
    """(host, path, rule, verdict) of the distinct keys (host, path) that a rule covers.

    A key meets one level for each suffix of its host. A level with many keys is cut
    into runs by a hash, each with its own copy of the level's rules, so a hot host is
    never one sorted task.
    """
    stacks = rule_stacks(rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.reverse(F.slice(labels, i, F.size(labels))), "."))
    levels = keys.select("host", "path", F.explode(suffixes).alias("node"))
    levels = levels.join(stacks.select("node").distinct(), "node")
    runs = levels.groupBy("node").agg((F.floor(F.count("*") / F.lit(run)) + 1).cast("int").alias("runs"))
    urls = levels.join(runs, "node").select(
        "node", F.pmod(F.xxhash64("host", "path"), F.col("runs")).cast("int").alias("run"), "path",
        F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    opened = stacks.join(runs, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "path",
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    sweep = Window.partitionBy("node", "run").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (opened.unionByName(urls).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
             .filter("kind = 1"))
    open_rules = F.filter(F.col("stack"), lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(open_rules, lambda r: F.struct(
        F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return (swept.select("host", "path", longest.alias("best")).filter("best IS NOT NULL")
            .groupBy("host", "path").agg(F.max("best").alias("best"))
            .select("host", "path", "best.rule", "best.verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict of every row.

    The longest rule by characters wins, and `default` holds where none fits. A NULL URL or one
    without `://` has an empty host and path and no rule; repeated URLs are judged once and
    each row gets its verdict; an empty table or rule set is fine.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = match_urls(rows.select("host", "path").filter("host <> ''").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select(
        key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
