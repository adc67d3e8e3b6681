"""URL filters: each URL is expanded into host-suffix and path-prefix expressions, which are
equi-joined with the rules on a short hash prefix; full digests, the path test and rule
precedence then confirm.

A rule is (host, path, verdict). It fits its host and every subdomain of it, if the URL's
path starts with the rule's path. Among the rules that fit, the longest host + path wins;
of equally long ones that with the longer host, then ``block``, then the later host and
path in string order.

Only parts of a URL that decide are joined, so repeated URLs are judged once: one row for
each distinct (host, path). Rules are indexed under their path up to its last ``/``, and
URLs are expanded at each ``/``; the rest of the rule's path is confirmed after the join. A URL
is expanded no deeper than the deepest rule goes (labels of its host, slashes of its path): longer
expressions equal no rule's, so a URL of any length costs its own length times the rules' depth.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule,
and gets the default verdict. A URL without a path fits only rules with an empty path.
An empty rule table leaves every URL at the default. Rules with a null host, path or
verdict are ignored, repeated rules count once. Other columns of the input are kept unless
they are named like an output column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import table

#: Rules of the registered query: host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT_VERDICT = "allow"
#: Hexadecimal digits of the hash prefix that the join uses.
PREFIX_DIGITS = 8


def with_host_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: the host follows the first ``://`` up to ``/ ? #``, A-Z lower-cased;
    the path follows it up to ``? #``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return urls.withColumns({"host": F.translate(authority, upper, lower), "path": path})


def _digest(host, key):
    return F.sha2(F.concat(host, F.lit("\n"), key), 256)


def expressions(places: DataFrame, labels: int, slashes: int) -> DataFrame:
    """One row for each host suffix of at most ``labels`` labels and each path prefix that ends in
    ``/`` and has at most ``slashes`` of them (or is empty)."""
    suffixes = F.expr(f"transform(sequence(1, least({max(labels, 1)}, 1 + length(host) - length(replace(host, '.', '')))), k -> substring_index(host, '.', -k))")
    prefixes = F.expr(f"transform(sequence(0, least({slashes}, length(path) - length(replace(path, '/', '')))), k -> CASE WHEN k = 0 THEN '' ELSE concat(substring_index(path, '/', k), '/') END)")
    out = places.where((F.col("host") != "") & F.lit(labels > 0)).withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    return out.withColumn("digest", _digest("suffix", "prefix"))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule (host + path of the rule that decides, else null) and verdict."""
    urls = with_host_path(urls.drop("host", "path", "rule", "verdict", "_place"), url)
    place = F.struct("host", "path")
    good = rules.select("host", "path", "verdict").dropna().distinct()
    good = good.select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
        _digest("host", F.regexp_extract("path", "^(.*/)?", 0)).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    deepest = good.agg(F.max(F.size(F.split("rule_host", "[.]"))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    labels, slashes = (int(x or 0) for x in deepest)
    asked = expressions(urls.select("host", "path").distinct(), labels, slashes).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    hits = asked.join(good, "short").where((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    order = F.struct(
        F.length("rule_host") + F.length("rule_path"),
        F.length("rule_host"),
        (F.col("rule_verdict") == "block").cast("int"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = hits.groupBy(place.alias("_place")).agg(F.max(order).alias("_best"))
    out = urls.withColumn("_place", place).join(best, "_place", "left")
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_place", "_best")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}:{v}'"
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
QUERIES = {"op7_urls": op7_urls}
ORACLE_SQL = {
    "op7_urls": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM cut
), told AS (
  SELECT page_id, host, path, CASE {_FITS} END AS hit FROM part
)
SELECT page_id, host, path, split_part(hit, ':', 1) AS rule, coalesce(split_part(hit, ':', 2), '{DEFAULT_VERDICT}') AS verdict FROM told
"""
}
