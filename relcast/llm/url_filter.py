"""URL rules by a sort-merge range join (DataFrame operations only).

A host is written with its labels reversed and a closing dot, so that ``a.example.net`` becomes ``net.example.a.``. All
hosts under a rule's host then start with the rule's key, and in byte order they fill the interval from ``net.`` up to
``net/`` (``/`` is the character after the dot). Intervals of rules are nested or apart. The sorted sweep meets interval
ends and hosts in key order; every interval end carries the stack of the rules that are active from there on, so a host
takes the stack of the nearest interval end at or before it. Of the rules in the stack whose path starts the url's path,
the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null and for no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(pos, stack): where rules begin and end, with the rules that are active from there on.

    ``rules`` has host, path, rule and verdict. The enclosing rules are found by joining the label prefixes of a rule's
    key with the keys, so the rules may be many; a stack holds the rules of one chain of nested hosts.
    """
    entry = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "verdict", "path")
    own = rules.select("host", "path", "rule", "verdict").dropna().distinct().groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_list(entry).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    prefixes = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("outer"))
    held = prefixes.join(own.select(F.col("key").alias("outer"), F.col("own").alias("of")), "outer")
    stacks = held.groupBy("key").agg(F.flatten(F.collect_list("of")).alias("within"), F.flatten(F.collect_list(F.when(F.col("outer") != F.col("key"), F.col("of")))).alias("around"))
    after = F.expr("concat(substring(key, 1, length(key) - 1), '/')")
    return stacks.select(F.inline(F.array(F.struct(F.col("key").alias("pos"), F.col("within").alias("stack")), F.struct(after.alias("pos"), F.col("around").alias("stack")))))


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack): the sweep. ``hosts`` has each host once, so a host of many urls is one row here.

    Range partitions are swept on their own; the stack with which one opens is the last interval end before it, taken
    from a table of one row for each partition.
    """
    points = hosts.select(host_key(F.col("host")).alias("pos"), "host")
    ends = boundaries(rules).select("pos", F.lit(None).cast("string").alias("host"), "stack")
    events = points.withColumn("stack", F.lit(None).cast(ends.schema["stack"].dataType)).unionByName(ends)
    swept = cut(events.repartitionByRange("pos").withColumn("part", F.spark_partition_id()))
    order = [F.col("pos"), F.col("host").isNotNull()]
    local = swept.withColumn("near", F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each range partition, so this window is as small as the number of partitions
    opens = swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("pos"))).alias("last"))
    opens = opens.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    return local.where("host IS NOT NULL").join(opens, "part", "left").select("host", F.coalesce("near", "open").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest rule string wins,
    then the longer rule host, then the greater rule and verdict (so block beats allow). A null url or one without
    ``://`` has empty host and path. Repeated rows and null ids stay; other columns are left out, so their names can't
    clash; null rules are no rules; an empty table gives an empty result. Only the hosts are swept and joined back, and
    that join can be split where one host has many urls.
    """
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    stacks = host_stacks(urls.select("host").distinct(), rules).withColumnRenamed("host", "of")
    best = F.array_max(F.filter("stack", lambda e: F.startswith(F.col("path"), e["path"])))
    judged = urls.join(stacks, F.col("host") == F.col("of"), "left").withColumn("best", best)
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
