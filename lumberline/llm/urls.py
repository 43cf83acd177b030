"""URL filters: longest-match rules, and trust that spreads over the links between hosts.

A rule names a host (and all its subdomains) and a path prefix; the longest rule that fits decides. Other pages get the verdict of
their host. Seeds come from the rules: a host's trust is the share of its pages that rules allow, its distrust the share that
they block. A host without pages that links lead to is judged by those links: the shares that rules allow and block. Trust spreads as personalised PageRank, forward along the links between hosts; distrust spreads the same way along
the reversed links, to hosts that link to blocked ones. Both are personalised PageRank in the scale of the seeds: values are divided by
(1 - damping), so that a host without links has its own share, and not by the sum of all seeds, so that a verdict depends on a
host's surroundings and not on how many seeds the whole crawl has. Rounds end when no value moves by ``SETTLED`` or more, or at
``ROUNDS`` (damping leaves under a thousandth of the seeds to later walks). A host is blocked where distrust is at least
``THRESHOLD`` and greater than trust.

Links are absolute links of the pages' html to other hosts, weighted by number. Rounds are joins of host tables in Spark, written
to the shared folder every few rounds; nothing of the graph reaches the driver.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule, and its verdict is that of the empty
host; null html has no links; hosts without links keep their seeds' values; repeated rows count one by one; an empty table gives an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, pick, stored

#: verdict, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 50
SETTLED = 1e-4
THRESHOLD = 0.5
STORE_EVERY = 5
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>][^"'\s<>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Verdict and text of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + prefix).alias("rule"))).otherwise(found)
    return found


def links(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """src, dst and n, the number of links from one host to another, with the numbers that rules allow and block."""
    rows = pick(pages, "url", "html").where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    to = F.concat(F.lit("://"), F.col("to"))
    rows = rows.select("src", host_of(to).alias("dst"), path_of(to).alias("path")).where("src != dst and src != ''")
    counted = rows.withColumn("by", ruled(F.col("dst"), F.col("path"), rules)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), _told("allow"), _told("block"))
    return stored(counted, "links")


def _told(verdict: str) -> Column:
    return F.count(F.when(F.col("by.verdict") == verdict, 1)).alias(verdict)


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host and value: the sum of damped walks from the seeds (host, value) along edges (src, dst, n)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = stored(edges.join(out, "src").select("src", "dst", (F.lit(damping) * F.col("n") / F.col("all")).alias("share")), "steps")
    value = before = stored(seeds.where("value > 0"), "spread")
    for i in range(rounds):
        moved = value.join(steps, value.host == steps.src).select(F.col("dst").alias("host"), (F.col("value") * F.col("share")).alias("value"))
        value = moved.unionByName(seeds).groupBy("host").agg(F.sum("value").alias("value")).where("value > 0")
        if (i + 1) % STORE_EVERY == 0 or i + 1 == rounds:
            value = stored(value, "spread")
            moved = value.join(before.withColumnRenamed("value", "old"), "host", "left").where(F.abs(F.col("value") - F.coalesce("old", F.lit(0.0))) >= SETTLED)
            done = moved.isEmpty()
            discard(before)
            before = value
            if done:
                break
    discard(steps)
    return value


def url_filter(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    rows = pick(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("by", ruled(F.col("host"), F.col("path"), rules))
    edges = links(pages, rules)
    own = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), _told("allow"), _told("block")).withColumn("own", F.lit(True))
    linked = edges.groupBy(F.col("dst").alias("host")).agg(*(F.sum(c).alias(c) for c in ("n", "allow", "block"))).withColumn("own", F.lit(False))
    judged = own.unionByName(linked).groupBy("host").agg(F.max(F.struct("own", "n", "allow", "block")).alias("by"))  # pages before links
    hosts = stored(judged.select("host", (F.col("by.allow") / F.col("by.n")).alias("trust"), (F.col("by.block") / F.col("by.n")).alias("distrust")), "hosts")
    trust, distrust = hosts.select("host", F.col("trust").alias("value")), hosts.select("host", F.col("distrust").alias("value"))
    trust = spread(trust, edges)
    distrust = spread(distrust, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = reduce(lambda a, b: a.join(b, "host", "left"), (hosts.select("host"), trust.withColumnRenamed("value", "trust"), distrust.withColumnRenamed("value", "distrust")))
    bad = (F.coalesce("distrust", F.lit(0.0)) >= threshold) & (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)))
    told = scores.select("host", F.when(bad, "block").otherwise("allow").alias("told"))
    return rows.join(told, "host").select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce(F.col("by.verdict"), F.col("told")).alias("verdict"))
