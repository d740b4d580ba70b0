"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefix.

An URL is expanded into every suffix of its host's labels with every prefix of
its path that is as long as some rule's path. Expressions meet the rules in an
equi-join on the first four bytes of their SHA-256; the full digest confirms;
of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """action, rule from (action, host/path) pairs."""
    return spark.createDataFrame(rules, "action string, rule string")


def expressions(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """The array of host-suffix + path-prefix strings; a host of n labels has n suffixes."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(wanted, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow", lengths_at_once: int = 512) -> DataFrame:
    """id, host, path, rule, verdict for every row of pages.

    Urls that repeat are judged once. A null url, or one without ://, has an empty
    host and path and fits no rule; an url that no rule fits gets `default` and a
    null rule. Rules: action (allow or block), rule (host, then the path from its
    first slash on). Of rules of equal length the one with the longer host wins,
    then block, so the result is defined for any rules; repeated rules are one; null
    rules, and rules without a slash, fit nothing. The distinct lengths of the
    rules' paths (whole numbers up to the longest path) are collected; for every
    `lengths_at_once` of them the urls are expanded and joined once.
    """
    own = rules.where("rule is not null and instr(rule, '/') > 0 and action is not null").select("action", F.concat(F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER), F.expr("substring(rule, instr(rule, '/'))")).alias("rule")).distinct()
    own = own.withColumn("host_length", F.expr("instr(rule, '/') - 1")).withColumn("digest", F.sha2("rule", 256))
    own = own.groupBy("rule", "host_length", "digest").agg(F.max("action").alias("action"))  # block > allow
    own = own.withColumn("prefix", F.substring("digest", 1, 8)).select("prefix", F.col("digest").alias("rule_digest"), "rule", "action", "host_length")
    lengths = sorted(r.n for r in own.select((F.length("rule") - F.col("host_length")).alias("n")).distinct().collect())
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    judged = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))  # all else fits no rule, and would meet in one task
    urls = rows.where(judged).select("url").distinct()
    fits = None
    for at in range(0, max(len(lengths), 1), lengths_at_once):
        some = lengths[at : at + lengths_at_once] or [0]
        expanded = urls.select("url", F.explode(expressions(host_of(F.col("url")), path_of(F.col("url")), some)).alias("expression"))
        expanded = expanded.withColumn("digest", F.sha2("expression", 256)).select("url", "digest", F.substring("digest", 1, 8).alias("prefix"))
        found = expanded.join(own, "prefix").where("digest = rule_digest").select("url", "rule", "host_length", "action")
        fits = found if fits is None else fits.unionByName(found)
    rank = F.struct(F.length("rule"), "host_length", "action", "rule")
    best = fits.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    known = rows.where(judged).join(best, "url", "left").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    empty = F.lit("")
    return known.unionByName(rows.where(~judged).select("page_id", empty.alias("host"), empty.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
