"""URL filters by a sort-merge range join; DataFrame functions only.

A host becomes a key of its labels in reverse, each closed by a separator that
no label holds, so a rule's host and all its subdomains are one interval of
keys, and intervals are nested or apart. Rule hosts and page hosts are sorted
together by ranges of the key. A sweep along that order keeps a stack: for each
number of labels, the last rule host that opened. An entry is active as long as
the key lies within its interval; since keys are sorted, the last one opened is also the
largest so far, which makes the stack a running maximum and lets a range take
over the stack of those before it.

Only distinct hosts are swept, and only distinct (host, path) pairs are matched
against the paths of the active rules, by equi-joins on the prefixes of those
lengths that the rules have. A host that holds a third of all pages is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsieve.plans.tables import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\x01"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by the separator; the separator itself is escaped."""
    safe = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02b")), F.lit(SEPARATOR), F.lit("\x02a"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), SEPARATOR), F.lit(SEPARATOR))


def _stacks(hosts: DataFrame, rule_hosts: DataFrame) -> DataFrame:
    """(key, node): each host with every rule host whose interval holds it.

    hosts and rule_hosts have a distinct column key. Both are dealt by ranges of
    the key and swept within a range; each range starts with what the ranges before it left.
    """
    depth = F.length("key") - F.length(F.replace("key", F.lit(SEPARATOR), F.lit("")))
    levels = [r[0] for r in rule_hosts.select(depth).distinct().collect()]
    events = rule_hosts.select("key", F.lit(0).alias("kind")).union(hosts.select("key", F.lit(1).alias("kind")))
    opened = [F.when((F.col("kind") == 0) & (depth == level), F.col("key")) for level in sorted(levels)]
    dealt = materialize(
        events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "sweep"
    )
    slots = [f"open_{i}" for i in range(len(levels))]
    if not slots:
        return dealt.select("key", F.col("key").alias("node")).where("false")
    ends = dealt.groupBy("part").agg(*[F.max(c).alias(s) for c, s in zip(opened, slots)])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", *[F.max(s).over(before).alias(f"{s}_before") for s in slots])
    along = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.select("part", "key", "kind", *[F.max(c).over(along).alias(s) for c, s in zip(opened, slots)])
    stack = F.array(*[F.coalesce(s, f"{s}_before") for s in slots])
    return (
        swept.where("kind = 1")
        .join(carried, "part")
        .select("key", F.explode(F.filter(stack, lambda top: F.startswith(F.col("key"), top))).alias("node"))
    )


def judged(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages.

    rules has the columns host, path and verdict. A rule fits its host and all
    subdomains where the page's path starts with the rule's; the longest rule
    (host and path together, then the longer host) wins, and `otherwise` holds
    where none fits. A null url, or one without "://", has an empty host and
    path. Rules with a null are passed over; of rules with the same host and
    path, block wins over allow. Rows come out as often as they go in; an empty table of
    pages gives an empty result, one of rules gives `otherwise`; further columns are
    ignored.
    """
    parsed = pages.select(
        pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path")
    )
    known = (
        rules.select(
            F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("prefix"), "verdict"
        )
        .where("rule_host is not null and prefix is not null and verdict is not null")
        .groupBy("rule_host", "prefix")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("node", host_key(F.col("rule_host")))
    )
    pairs = parsed.select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    nodes = _stacks(pairs.select("key").distinct(), known.select(F.col("node").alias("key")).distinct())
    lengths = known.select("node", F.length("prefix").alias("size")).distinct()
    asked = (
        pairs.join(nodes.join(lengths, "node"), "key")
        .where(F.length("path") >= F.col("size"))
        .withColumn("prefix", F.substring("path", F.lit(1), F.col("size")))
    )
    rank = F.struct(F.length("rule_host") + F.col("size"), F.length("rule_host"))
    # written, so that the join below stands alone and a url that very many pages share can be split
    decided = materialize(
        asked.join(known, ["node", "prefix"])
        .groupBy("host", "path")
        .agg(
            F.max_by(F.struct(F.concat("rule_host", "prefix").alias("rule"), "verdict"), rank).alias("best")
        ),
        "decided",
    )
    return parsed.join(decided, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
