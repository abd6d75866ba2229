"""URL filters: host-suffix and path-prefix expressions against a rule table.

Every url is expanded into expressions of a host suffix (whole labels) and a path prefix (up to a
slash), no deeper than the deepest rule; expressions meet rules by a short hash prefix, and a meeting
counts once the full digests agree and the path starts with the rule's. The rule with the longest host
and path wins, a block before an allow of the same length. Expansion never crosses rows: the decision
for each distinct url is joined back to the pages.

Rules are few: the table is broadcast while it has at most ``BROADCAST_RULES`` rows, and joined by
shuffle beyond. A rule's path need not end in a slash; it is keyed by its part up to the last one.

Defined cases: a null url or one without ``://`` has empty host and path and meets no rule; urls that
meet no rule get ``default``; repeated rows are judged each; null rules' fields count as empty, and a rule with an
empty host fits nothing. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editloom.llm.base import save

BROADCAST_RULES, DEFAULT = 100_000, "allow"
#: Fixed values of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _stem(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _digest(host: Column, stem: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), stem), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url). ``rules``: verdict, host, path."""
    empty = F.lit("")
    table = rules.select("verdict", F.lower(F.coalesce("host", empty)).alias("rule_host"), F.coalesce("path", empty).alias("rule_path")).where("rule_host <> ''")
    table = table.withColumn("digest", _digest(F.col("rule_host"), _stem(F.col("rule_path")))).withColumn("short", F.substring("digest", 1, 8))
    # Rules are numbered in the order that they win in, so that the best of a url's is the largest number.
    order = [F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block", "rule_host", "rule_path"]
    table = save(table.orderBy(*order).withColumn("no", F.monotonically_increasing_id()), "url-rules")
    told = table.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_path", "/"))).alias("steps")
    ).first()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = rows.select("url").distinct().withColumns({"host": host, "path": path}).where("host <> ''")
    label, step = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(label) - F.lit((told.labels or 1) - 1)), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), ".")
    )
    stems = F.transform(
        F.sequence(F.lit(0), F.least(F.size(step) - 1, F.lit((told.steps or 1) - 1))),
        lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(step, F.lit(1), i), "/"), F.lit("/"))).otherwise(empty),
    )
    expressions = (
        urls.select("url", "path", F.explode(suffixes).alias("suffix"), stems.alias("stems"))
        .select("url", "path", "suffix", F.explode("stems").alias("stem"))
        .withColumn("full", _digest(F.col("suffix"), F.col("stem")))
        .withColumn("short", F.substring("full", 1, 8))
    )
    side = F.broadcast(table) if told.n <= broadcast_rules else table
    met = expressions.join(side, "short").where((F.col("full") == F.col("digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    best = met.groupBy("url").agg(F.max("no").alias("no"))
    named = table.select("no", "verdict", F.concat("rule_host", "rule_path").alias("rule"))
    best = save(best.join(F.broadcast(named) if told.n <= broadcast_rules else named, "no").select("url", "verdict", "rule"), "url-best")
    return rows.join(best, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP6_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages) x),
rules(verdict, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT host, path, arg_max(row(verdict, h || s), length(h || s)) AS b
  FROM (SELECT DISTINCT host, path FROM p) u, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY host, path)
SELECT page_id, p.host, p.path, b[2] AS rule, coalesce(b[1], 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""
