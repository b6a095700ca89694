"""URL rules: allow and block lists of hosts and path prefixes.

A URL is expanded into its host's suffixes and its path's prefixes.  Each pair
is digested; pairs and rules meet on the first characters of their digests, the
full digest confirms, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import fold, materialize, table

#: The rules of the query, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of the digest that rules and expressions are joined on.
PREFIX = 8
#: Rules up to this number are broadcast (about 150 bytes each).
BROADCAST_RULES = 200_000
#: Verdict on URLs that no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z made small) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(fold(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    parts = F.split(host, r"\.", -1)
    return F.array_distinct(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A rule fits its host and all subdomains, if the path starts with the
    rule's.  The longest rule (host and path together) decides, of equally
    long ones that of the longer host, of rules alike a block.  A URL that no
    rule fits gets ``default`` and a null rule; rules with a null host or path
    fit nothing.  Repeated rows are judged alike.
    """
    own = rules.select("verdict", fold(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).filter("rule_host is not null and rule_path is not null")
    own = own.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # block > allow
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    own = materialize(own.select("*", digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"), F.concat("rule_host", "rule_path").alias("rule")), "url-rules")
    size, lengths = own.agg(F.count("*"), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    own = F.broadcast(own) if size <= broadcast_rules else own
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).filter("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    # Only prefixes as long as some rule's path can fit.
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = urls.select("url", F.explode(host_suffixes(F.col("host"))).alias("suffix"), starts.alias("starts"))
    pairs = pairs.select("url", "suffix", F.explode("starts").alias("start")).select("url", _digest(F.col("suffix"), F.col("start")).alias("found"))
    fits = pairs.withColumn("prefix", F.substring("found", 1, PREFIX)).join(own, "prefix").filter("found = digest")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule_verdict", "rule")).alias("best"))
    best = best.select(F.col("url").alias("known"), "best.rule", F.col("best.rule_verdict").alias("verdict"))
    few = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    out = few.join(best, F.col("url") == F.col("known"), "left")
    host, path = host_and_path(F.col("url"))
    return out.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark, sf_dir) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rule_table(spark))


OP4_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM split
"""
