"""URL filters: a sort-merge range join of urls with nested host and path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, beside, cut, join_dealt

SEP = "#"
"""Stands between the reversed host and the path of a key; neither of a url's can hold it, so a key begins with a rule's only if the hosts are equal."""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or where there is no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, "\\.")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule key, itself and the rules whose intervals it lies in, outermost first.

    A rule covers the keys that start with its own; two such intervals are nested or apart. Of rules with one key, a block wins.
    """
    keyed = rules.select(
        F.concat(_reversed_host(F.lower("host")), F.lit(SEP), F.coalesce("path", F.lit(""))).alias("key"),
        F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
        "verdict",
        F.length(F.coalesce("path", F.lit(""))).alias("path_chars"),
    ).where("key is not null and verdict is not null")
    best = keyed.groupBy("key", "path_chars").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict", "rule")).alias("r"))
    best = best.select("key", "path_chars", F.struct("key", F.length("r.rule").alias("chars"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).alias("entry"))
    prefixes = best.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("path_chars")), lambda n: F.left(F.col("key"), F.length("key") - n))).alias("prefix"))
    outer = best.select(F.col("key").alias("prefix"), "entry")
    return prefixes.join(outer, "prefix").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def url_filter(urls: DataFrame, rules: DataFrame, url: str = "url", *, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``urls`` (columns of these names, in any case, give way).

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host and all subdomains where the path starts
    with the rule's; the longest rule string wins, and of two as long the one of the longer host. Without a rule the verdict is ``default`` and rule null.
    A null url has host and path '' and no rule. No rules: every row gets the default. Repeated rows stay, an empty table gives an empty one, and
    urls are taken whole, however long.

    Keys are the reversed host (``org.example``) and the path, so a rule is an interval of keys. A url stands once in the order for
    each of its parent hosts, as many as the longest rule host has labels, its path cut to the longest rule path: nothing that rules
    can tell apart is lost, and what is sorted are the distinct keys, so a hot host or url weighs no more than others. The keys and
    the rules are sorted together by range; a sweep carries the stack of rules that are open, and each key takes the innermost
    rule of its stack that contains it. Ranges pass their last stack on to the next through a table of one row per range. When
    verdicts go back to the rows, those of a hot host are dealt to several tasks.
    """
    return beside(urls, ["host", "path", "rule", "verdict"], lambda df, at: swept_rules(df, rules, at(url), default))


def swept_rules(urls: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """The work of ``url_filter`` on rows whose columns have placeholder names."""
    spark, own = urls.sparkSession, urls.columns
    stacks = cut(rule_stacks(rules))
    labels, path_chars = stacks.agg(
        F.coalesce(F.max(F.size(F.split(F.substring_index("key", SEP, 1), "\\."))), F.lit(0)), F.coalesce(F.max(F.length(F.substring_index("key", SEP, -1))), F.lit(0))
    ).first()
    parts = urls.select(*own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    shape = lambda df, *more: df.select(*more, F.slice(F.reverse(F.split("host", "\\.")), 1, max(labels, 1)).alias("__h"), F.left("path", F.lit(path_chars)).alias("__p"))
    shapes = shape(urls.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))).distinct()
    levels = F.transform(F.sequence(F.lit(1), F.size("__h")), lambda n: F.concat(F.concat_ws(".", F.slice("__h", 1, n)), F.lit(SEP), F.col("__p")))
    keys = shapes.select(F.explode(levels).alias("key")).distinct()

    events = stacks.select("key", F.lit(0).alias("kind"), "stack").unionByName(keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(events.repartitionByRange(n, "key", "kind").withColumn("range", F.spark_partition_id()))
    last_stack = ranged.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("open"))
    everyone = ranged.select("range").distinct().join(last_stack, "range", "left")
    passed_on = everyone.select("range", F.last("open", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.select("range", "key", "kind", F.last("stack", ignorenulls=True).over(sweep).alias("open")).where("kind = 1")
    fits = F.filter(F.coalesce("open", "before"), lambda r: F.startswith(F.col("key"), r["key"]))
    # passed_on has one row per range, at most spark.sql.shuffle.partitions of them, so it may be broadcast
    innermost = swept.join(F.broadcast(passed_on), "range", "left").select("key", F.try_element_at(fits, F.lit(-1)).alias("hit")).where("hit is not null")

    by_level = shapes.select("__h", "__p", F.posexplode(levels).alias("level", "key")).join(innermost, "key")
    winner = cut(by_level.groupBy("__h", "__p").agg(F.max(F.struct("hit.chars", "level", "hit.rule", "hit.verdict")).alias("__won")))
    joined = join_dealt(shape(parts, *own, "host", "path"), winner, ["__h", "__p"])
    return joined.select(*own, "host", "path", F.col("__won.rule").alias("rule"), F.coalesce("__won.verdict", F.lit(default)).alias("verdict"))
