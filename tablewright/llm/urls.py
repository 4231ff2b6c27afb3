"""URL filters: host and path rules found by hash prefixes.

A URL is expanded into expressions, one for each host suffix and path prefix. They
meet the rules by the first bytes of their digests in an equi-join; full digests
confirm, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Hexadecimal digits of a short hash.
SHORT = 8
RULES = "host string, path string, action string"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES)


def url_parts(df: DataFrame, column: str = "url") -> DataFrame:
    """``df`` with host and path.

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case;
    path: from there up to "?", "#" or the end. Null or without "://": both empty.
    """
    url = F.coalesce(F.col(column), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({column}, instr({column}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.select("*", F.translate(host, upper, upper.lower()).alias("host"), path.alias("path"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url, ...).

    A rule (host, path, action) fits its host and all subdomains when the URL's path
    begins with the rule's path. The longest fitting rule decides; of rules that are
    the same text, block wins. Without a rule: rule null, verdict ``default``. Null and
    odd URLs have an empty host and path and so no rule. Null ids and repeated rows
    stay; extra columns of pages are not read.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    named = rules.select(F.concat("host", "path").alias("rule"), "path", "action").where("rule is not null and action is not null")
    named = named.groupBy("rule", "path").agg(F.max("action").alias("action"))  # block sorts after allow
    digest = F.sha2("rule", 256)
    # The lengths of rule paths are the only prefixes that can match.
    lengths = named.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    keyed = named.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("full"), F.length("path").alias("cut"),
                         F.col("rule"), F.col("action"))
    # Equal host and path need one look-up, however many rows have them.
    places = url_parts(pages).select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.withColumn("suffix", F.explode(F.array_distinct(suffixes))).withColumn("lengths", lengths.scalar()).withColumn(
        "cut", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    expression = F.concat("suffix", F.expr("substring(path, 1, cut)"))
    each = each.select("host", "path", "cut", F.sha2(expression, 256).alias("_full"))
    each = each.withColumn("short", F.substring("_full", 1, SHORT))
    met = each.join(keyed, ["short", "cut"]).where(F.col("_full") == F.col("full"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "action", "rule")).alias("best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("best.rule").alias("rule"),
                       F.col("best.action").alias("action"))
    told = url_parts(pages).join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return told.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
