"""Allow and block rules on the URLs that readings refer to, as a sort-merge range join.

With the labels of a host reversed, a host and all its subdomains are one interval of keys,
and so are all paths below a path.  Rules and URLs are sorted together; a sweep over the
sorted rows keeps the stack of rules that are open.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.llm.common import column
from fairlead.session import stage

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTRY = "array<struct<key: string, rule: string, verdict: string>>"


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot: the keys of all subdomains start with a host's own."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _with_stacks(rules: DataFrame) -> DataFrame:
    """Each rule key with the stack that is open where its interval begins: itself last, the rules around it before.

    Rules around a rule are those whose key is a prefix of its own, found by equi-join.
    """
    prefixes = rules.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.expr("substring(key, 1, n)").alias("outer")
    )
    around = rules.select(F.col("key").alias("outer"), F.struct("key", "rule", "verdict").alias("entry"))
    # One entry per prefix at the most, so a stack is no deeper than its key is long.
    return prefixes.join(around, "outer").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def _sweep(points: DataFrame, stacks: DataFrame) -> DataFrame:
    """Points (row, key and more) with ``active``: the open rules at their key, innermost last.

    The last rule that begins at or before a key has all rules open there in its stack.
    Each range of the sorted rows starts with the last rule of the ranges before it.
    Equal keys are split by row number, so a frequent URL fills no range alone.
    """
    extra = [c for c in points.columns if c not in ("row", "key")]
    events = points.select("key", F.lit(1).alias("kind"), "row", *extra, F.lit(None).cast(_ENTRY).alias("stack")).unionByName(
        stacks.select("key", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True
    )
    placed = stage(events.repartitionByRange("key", "kind", "row").withColumn("range", F.spark_partition_id()), "sweep")
    ends = placed.groupBy("range").agg(F.max_by(F.when(F.col("kind") == 0, F.col("stack")), F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    # One row per range here.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumn("top", F.last("stack", ignorenulls=True).over(so_far)).filter("kind = 1").join(carried, "range")
    still_open = F.filter(F.coalesce("top", "carried"), lambda e: F.col("key").startswith(e["key"]))
    return swept.select("row", "key", *extra, F.coalesce(still_open, F.array().cast(_ENTRY)).alias("active"))


def reference_verdicts(
    readings: DataFrame, rules: DataFrame, key: str = "metric_id", url: str = "record_ref", default: str = "allow"
) -> DataFrame:
    """The rule and verdict for the URL each reading refers to: ``<key>``, host, path, rule, verdict.

    ``rules``: host, path, verdict.  A rule fits its host and all subdomains if the URL's
    path starts with the rule's; of those that fit, the longest (host and path) wins, with
    the longer host on a tie.  Without one, rule is null and the verdict is ``default``.
    The rule tables may be as large as the readings: nothing is broadcast by hand.

    A null URL, or one without ``://``, has an empty host and path and fits no rule.  Rules
    with a null or empty host are ignored, a null path is empty; of rules with the same
    host and path the greatest verdict counts.  Repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored.
    """
    base = stage(
        readings.select(F.monotonically_increasing_id().alias("row"), column(key).alias("key"), column(url).cast("string").alias("url"))
        .select("row", "key", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")),
        "urls",
    )
    named = rules.select(
        F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"),
    ).filter("host <> '' and (path = '' or startswith(path, '/'))")
    by_key = (
        named.withColumn("host_key", host_key(F.col("host")))
        .groupBy("host_key", F.concat("host_key", "path").alias("key"), F.concat("host", "path").alias("rule"))
        .agg(F.max("verdict").alias("verdict"))
    )
    hosts = by_key.select(F.col("host_key").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).distinct()

    points = base.filter("host <> ''").select("row", host_key(F.col("host")).alias("key"), "path")
    within = _sweep(points, _with_stacks(hosts))
    opened = within.select("row", "path", F.explode("active").alias("e"))
    by_host = opened.select("row", F.concat("e.key", "path").alias("key"))
    fitting = _sweep(by_host, _with_stacks(by_key.drop("host_key"))).filter("size(active) > 0").select("row", F.element_at("active", -1).alias("e"))
    best = fitting.groupBy("row").agg(
        F.max(F.struct(F.length("e.rule").alias("n"), F.length(F.regexp_extract("e.rule", "^[^/]*", 0)).alias("h"), "e.rule", "e.verdict")).alias("best")
    ).select("row", "best.rule", "best.verdict")
    return base.join(best, "row", "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
