"""URL rules by host-suffix and path-prefix expressions (operator 3): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule tables up to this many rows are broadcast (some 200 bytes a row); larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the join compares; the rest is confirmed.
PREFIX = 8
DEFAULT = "allow"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host and path: what follows the first :// up to /, ? or #, and from there up to ? or #."""
    start = F.locate("://", F.col(url_col))
    rest = F.when(start > 0, F.substring(F.col(url_col), start + 3, F.length(url_col))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def _count(column: str, mark: str):
    return F.length(column) - F.length(F.translate(column, mark, ""))


def _digest(host, start):
    return F.sha2(F.concat(host, F.lit("\n"), start), 256)


def expressions(urls: DataFrame, labels: int, steps: int) -> DataFrame:
    """urls(host, path) with a row for each pair of a host suffix (whole labels) and a path start (up to a slash, or empty).

    No suffix has more than ``labels`` labels and no start more than ``steps``
    slashes, which are the most that a rule has, so a long url has no more
    pairs than a rule can fit.
    """
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(max(labels, 1))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    starts = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.when(i > 0, F.call_function("substring_index", F.col("path"), F.lit("/"), i)).otherwise(""))
    whole = F.filter(starts, lambda x: (x == "") | (x != F.col("path")))
    whole = F.transform(whole, lambda x, i: F.when(i > 0, F.concat(x, F.lit("/"))).otherwise(x))
    out = urls.withColumn("suffix", F.explode(F.array_distinct(suffixes))).withColumn("start", F.explode(F.array_distinct(whole)))
    digest = _digest(F.col("suffix"), F.col("start"))
    return out.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules by the digest of their host and of their path up to its last slash, one for each host and path (block before allow)."""
    r = rules.where("host is not null and path is not null").groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    r = r.agg(F.max("verdict").alias("rule_verdict"))
    digest = _digest(F.col("rule_host"), F.regexp_extract("rule_path", r"^(.*/)?", 0))
    return r.withColumn("rule_digest", digest).withColumn("short", F.substring("rule_digest", 1, PREFIX))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all hosts below it if the url's path starts with
    the rule's; the longest host and path win, then the longer host, then block.
    Distinct hosts and paths are expanded, so copies of an url cost nothing
    more.  A null url has neither host nor path and gets the default, as does an
    empty rule table; repeated rows and null ids stay as they are, other columns
    are not looked at, and an url of any length costs as much as the deepest
    rule lets it.
    """
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).drop("url")
    keyed = keyed_rules(rules)
    n, labels, steps = keyed.agg(F.count("*"), F.max(_count("rule_host", ".") + 1), F.max(_count("rule_path", "/"))).first()
    keyed = F.broadcast(keyed) if n <= BROADCAST_RULES else keyed
    hit = expressions(rows.select("host", "path").distinct(), labels or 0, steps or 0).join(keyed, "short")
    hit = hit.where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "rule_verdict")
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), order).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, rules_frame(pages.sparkSession))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT DISTINCT host, path, h || p AS rule, verdict, length(h) + length(p) AS n FROM (SELECT DISTINCT host, path FROM part) x
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (
  SELECT host, path, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM fit GROUP BY host, path
)
SELECT page_id, part.host, part.path, rule, coalesce(verdict, 'allow') AS verdict FROM part LEFT JOIN best USING (host, path)
"""
