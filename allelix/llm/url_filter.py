"""URL filters: a sort-merge range join of hosts with nested host rules, in DataFrame functions only.

A host's labels are reversed ("net.example.www."), so a rule's host and all its subdomains are one interval of sorted
keys. Rules and distinct hosts are sorted together by ranges; a sweep over each range keeps, for every depth of
nesting, the rule opened last and drops it where its interval has ended: the stack of active nested rules. What is
open at a range's start comes from the ranges before it. Urls then take their host's stack and choose the longest rule
whose path theirs starts with.

A null url, or one without ://, has an empty host and path, meets no rule and gets the default verdict. Of two rules
of the same host and path, block wins. Rules with an empty host fit nothing. Repeated rows give repeated rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.common import require, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The registered query's rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def reversed_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it: subdomains sort behind their domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host, distinct) with ``stack``: the rules (length, block, rule, path, verdict) that fit it or a domain
    above it. rules: host, path, verdict."""
    clean = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict").where("host is not null and host <> ''")
    rule = F.concat("host", "path")
    option = F.struct(F.char_length(rule).alias("length"), (F.col("verdict") == "block").alias("block"), rule.alias("rule"), "path", "verdict")
    opened = clean.groupBy("host").agg(F.collect_list(option).alias("options")).select(
        reversed_key(F.col("host")).alias("key"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("host"),
        F.size(F.split("host", r"\.")).alias("depth"),
        # "/" follows "." in byte order: the first key behind all subdomains.
        F.concat(F.expr("left(key, char_length(key) - 1)"), F.lit("/")).alias("until"),
        "options",
    )
    kinds = dict(opened.dtypes)
    points = hosts.select(reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("depth", "until", "options")])
    # Depths of rules: as many as a host name has labels, 127 at most.
    depths = [r["depth"] for r in opened.select("depth").distinct().orderBy("depth").collect()]
    if not depths:
        return hosts.withColumn("stack", F.lit(None).cast(kinds["options"]))
    ranges = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = opened.unionByName(points).repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id())
    events = written(dealt, "url-events")
    slot = {d: F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("until", "options")) for d in depths}
    # One row for each range.
    ends = events.where("kind = 0").groupBy("range").agg(*[F.max_by(F.struct("until", "options"), F.when(F.col("depth") == d, F.col("key"))).alias(f"end{d}") for d in depths])
    every = events.select("range").distinct().join(ends, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("range", *[F.last(f"end{d}", True).over(earlier).alias(f"carried{d}") for d in depths])
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.select("range", "key", "kind", "host", *[F.last(slot[d], True).over(sweep).alias(f"open{d}") for d in depths]).where("kind = 1")
    joined = swept.join(carried, "range")
    active = [F.coalesce(f"open{d}", f"carried{d}").alias(f"slot{d}") for d in depths]
    found = joined.select("host", "key", *active)
    none = F.lit(None).cast(kinds["options"])
    stack = F.flatten(F.filter(F.array(*[F.when(F.col("key") < F.col(f"slot{d}.until"), F.col(f"slot{d}.options")).otherwise(none) for d in depths]), lambda x: x.isNotNull()))
    return found.select("host", stack.alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict."""
    url = F.coalesce("url", F.lit(""))
    pages = require(pages, "page_id", "url").select(
        "page_id",
        F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    stacks = host_stacks(pages.select("host").where("host <> ''").distinct(), rules)
    fitting = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = pages.join(stacks.hint("merge"), "host", "left").select("page_id", "host", "path", F.array_max(fitting).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    # Literals, so that not even the rules pass through Python workers.
    named = [F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict"), strict=True)]) for r in RULES]
    rules = spark.range(1).select(F.inline(F.array(*named)))
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP5_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (
  SELECT p.k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(r.host || r.path) DESC) AS n
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.k = m.k AND m.n = 1
"""
