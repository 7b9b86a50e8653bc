"""Verdicts on web addresses by host-suffix and path-prefix rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geohour.llm.common import lower_ascii, small
from geohour.session import materialize

DEFAULT_VERDICT = "allow"
# Hexadecimal digits of a digest that the join compares; the rest is confirmed after it.
PREFIX_DIGITS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): from the first :// up to / ? # or the end, and on up to ? # or the end.

    Host letters A-Z become lower case. Both are empty for null and where :// is missing.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _short(digest: str) -> Column:
    return F.substring(digest, 1, PREFIX_DIGITS)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url",
               keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per row of `pages`: the `keep` columns, host, path, rule and verdict.

    `rules` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains where the address's path starts with the rule's. The rule with the longest
    host and path together wins; among equally long ones the longer host, then block. Without
    a fitting rule the rule is null and the verdict allow.

    Hosts come first: each distinct one is expanded into its suffixes by label, no longer than
    the longest host of a rule, and meets the rules' hosts. Then each distinct (host, path) is
    expanded into the path prefixes of the lengths that occur among the rules of these hosts, so
    the expressions of an address depend neither on its length nor on the rules of other hosts.
    Both joins compare the first 32 bits of SHA-256 digests; full digests are compared after it. Rules
    are broadcast after their bytes are counted, so addresses that all ask the same rule stay
    where they are; a longer list is shuffled, and Spark splits the rows that ask for one rule.

    Null addresses have an empty host and path; addresses may have any length. Rules without a
    host fit nothing; a rule's null path is empty and fits every path. Rows of `pages` that
    repeat are all returned; extra columns are not read; an empty table of pages or rules gives
    no row or no rule.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path"))
    known = materialize(rules.where("host IS NOT NULL").select(
        lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"),
        F.col("verdict").alias("v"),
    ).groupBy("h", "p").agg(F.max("v").alias("v")), "url-rules")  # block sorts after allow
    longest = known.agg(F.max(F.length("h"))).first()[0]
    if longest is None:
        return rows.select("*", F.lit(None).cast("string").alias("rule"),
                           F.lit(DEFAULT_VERDICT).alias("verdict"))
    rule_hosts = known.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))  # as many as differ
    rule_hosts = rule_hosts.select(_digest("h").alias("digest"), "lengths").withColumn("short", _short("digest"))
    # A suffix that a rule may have lies in the end of the host, behind a dot or whole.
    end = F.when(F.length("host") <= longest, F.col("host")).otherwise(F.expr(f"right(host, {longest + 1})"))
    labels = rows.select("host").distinct().withColumn("labels", F.split(end, r"\."))
    first = F.when(F.length("host") <= longest, F.lit(1)).otherwise(F.lit(2))
    suffixes = labels.where(F.size("labels") >= first).select("host", F.explode(F.transform(
        F.sequence(first, F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("suffix"))
    hosts = (
        suffixes.withColumn("asked", _digest("suffix")).withColumn("short", _short("asked"))
        .join(small(rule_hosts), "short").where("asked = digest").select("host", F.col("suffix").alias("h"), "lengths")
    )
    hosts = materialize(hosts, "rule-hosts")
    hashed = known.select(
        F.concat("h", "p").alias("rule"), "v", F.length("h").alias("rule_hl"), _digest("h", "p").alias("digest"),
    ).withColumn("short", _short("digest"))
    asked = (
        rows.select("host", "path").distinct().join(small(hosts), "host")
        .select("host", "path", "h", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
        .withColumn("asked", _digest("h", F.substring(F.col("path"), F.lit(1), F.col("n"))))
        .withColumn("short", _short("asked"))
    )
    best = F.max(F.struct(F.length("rule"), "rule_hl", "v", "rule"))
    found = (
        asked.join(small(hashed), "short").where("asked = digest")
        .groupBy("host", "path").agg(best.alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.v").alias("v"))
    )
    return rows.join(found, ["host", "path"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("v", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
