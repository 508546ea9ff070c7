"""URL filters by a sort-merge range join over reversed-host keys (native).

A host key is the host's labels in reverse order, each followed by a dot, so a
rule's host and all its subdomains are the keys that start with the rule's key:
one interval of the sorted keys. Two intervals of this kind nest or are
disjoint. A sweep over keys in sorted order therefore needs one stack: at an
interval's start its whole stack (itself and all that enclose it) comes into
force, and at any later key the intervals still open are those of the latest
stack that the key starts with.

The sweep runs twice: over host keys, which gives each url the rule hosts that
cover it, and over (rule host, path) keys, which gives for each of these the
longest fitting path. Keys are range partitioned with the row's id as the last
part, so a host that a third of all urls share spans many partitions; a rule is
sent to the partitions that its interval meets.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch, parallelism

#: Sorts after every key that starts with the same prefix.
LAST = "\U0010ffff"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` becomes ``com.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _stacks(prefixes: DataFrame) -> DataFrame:
    """(prefix, stack): the prefix and all others it starts with, shortest first."""
    own = prefixes.select("prefix").distinct()
    part = own.select("prefix", F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("n"))
    part = part.select("prefix", F.expr("substring(prefix, 1, n)").alias("outer_prefix"))
    outer = own.select(F.col("prefix").alias("outer_prefix"))
    return part.join(outer, "outer_prefix").groupBy("prefix").agg(
        F.sort_array(F.collect_list("outer_prefix")).alias("stack")
    )


def sweep(scratch: Scratch, name: str, points: DataFrame, key: str, ties: list[str], prefixes: DataFrame) -> DataFrame:
    """``points`` plus ``stack``: the prefixes that ``key`` starts with, shortest first.

    ``ties`` are columns that tell rows of one key apart, so that range
    partitioning can split it. Every point comes back, with an empty stack if
    no prefix fits.
    """
    spark = scratch.spark
    dealt = points.repartitionByRange(parallelism(spark), key, *ties)
    dealt = scratch.write(dealt.withColumn("bucket", F.spark_partition_id()), name)
    # One bound for each range partition.
    least = [r.least for r in dealt.groupBy("bucket").agg(F.min(key).alias("least")).collect()]
    bounds = spark.createDataFrame([(sorted(least),)], "bounds array<string>")
    at = lambda c: F.greatest(F.lit(0), F.size(F.filter("bounds", lambda b: b < c)) - 1)
    order = dealt.groupBy("bucket").agg(F.min(key).alias("least")).withColumn(
        "place", F.row_number().over(Window.orderBy("least", "bucket")) - 1
    )
    opened = (
        _stacks(prefixes)
        .crossJoin(F.broadcast(bounds))  # one row
        .withColumn("place", F.explode(F.sequence(at(F.col("prefix")), at(F.concat("prefix", F.lit(LAST))))))
        .join(F.broadcast(order.select("place", "bucket")), "place")  # a row for each range partition
        .select("bucket", F.col("prefix").alias(key), F.lit(0).alias("kind"), F.col("stack").alias("opened"))
    )
    events = dealt.withColumn("kind", F.lit(1)).unionByName(opened, allowMissingColumns=True)
    so_far = Window.partitionBy("bucket").orderBy(key, "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("opened", F.last("opened", ignorenulls=True).over(so_far)).filter("kind = 1")
    still_open = F.filter("opened", lambda p: F.startswith(F.col(key), p))
    return swept.withColumn("stack", F.coalesce(still_open, F.array().cast("array<string>"))).drop("bucket", "kind", "opened")


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains if the url's path starts with the rule's path; of those that fit
    the longest (host and path together, then host) wins; of equal rules
    ``block`` wins over ``allow``. Without one, rule is null and the verdict is
    ``default``. Rules with a null or empty host or a null path fit nothing.

    A null url, or one without ``://``, has an empty host and path. Repeated
    rows come back as often as they came. Other columns are not read. No pages
    or no rules: no rows, or ``default`` for all.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rules = (
        rules.filter("host <> '' AND path IS NOT NULL")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat(host_key(F.col("host")), F.lit("\0"), "path").alias("rule_key"),
            host_key(F.col("host")).alias("rule_host"),
            F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_size"),
        )
    )
    rules = scratch.write(rules, "rules")
    urls = pages.groupBy(F.col(page_id).alias("page_id"), F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    urls = urls.select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    hosts = rules.select(F.col("rule_host").alias("prefix"))
    covered = sweep(scratch, "by_host", urls, "key", ["page_id", "url"], hosts)
    covered = scratch.write(covered.drop("key"), "covered")
    points = covered.select("page_id", "url", "path", F.explode("stack").alias("rule_host"))
    points = points.select("page_id", "url", F.concat("rule_host", F.lit("\0"), "path").alias("key"))
    paths = rules.select(F.col("rule_key").alias("prefix"))
    fitting = sweep(scratch, "by_path", points, "key", ["page_id", "url"], paths)
    fitting = fitting.filter(F.size("stack") > 0).select("page_id", "url", F.element_at("stack", -1).alias("rule_key"))
    found = fitting.join(rules, "rule_key").select(
        "page_id", "url", F.struct(F.length("rule").alias("size"), "host_size", "rule", "verdict").alias("best")
    )
    every = covered.select("page_id", "url", "host", "path", "copies")
    best = every.unionByName(found, allowMissingColumns=True).groupBy("page_id", "url").agg(
        F.max("host").alias("host"), F.max("path").alias("path"), F.max("copies").alias("copies"), F.max("best").alias("best")
    )
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
