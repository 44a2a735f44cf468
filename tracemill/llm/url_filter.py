"""URL filters: a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import Scratch, fold_az, read_table

#: (host, path prefix, verdict) of the contract's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: Urls that one range of the sweep holds, about.
RANGE_URLS = 200_000
RULE_LIST = "array<struct<host:string,path:string,verdict:string>>"


def url_parts(url):
    """(host, path) of a url column: both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return fold_az(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host):
    """Labels in reverse with a dot after each: all subdomains of a host start with the host's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def host_of(key):
    """The host of a key."""
    return F.array_join(F.reverse(F.split(F.substring(key, 1, F.length(key) - 1), r"\.", -1)), ".")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules as a table (host, path, verdict), from a list or from a table."""
    if isinstance(rules, DataFrame):
        return rules.select(fold_az(F.col("host")).alias("host"), "path", "verdict")
    rows = F.array(*[F.struct(fold_az(F.lit(h)).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def boundaries(rules: DataFrame) -> DataFrame:
    """The sweep's events: (key, level, rules) at the start and the end of each host's interval.

    The interval of key ``com.example.`` is [``com.example.``, ``com.example/``): "/" follows "." in byte order. Intervals of
    one level (number of labels) are apart, and those of different levels nest or are apart. A start puts its rules in its
    level's place of the stack and an end empties that place.
    """
    keyed = rules.select(host_key(F.col("host")).alias("key"), F.struct(F.col("host"), F.col("path"), F.col("verdict")).alias("rule"))
    own = keyed.groupBy("key").agg(F.collect_set("rule").alias("rules")).withColumn("level", F.size(F.split("key", r"\.", -1)) - 1)
    ends = own.select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), "level", F.slice("rules", 1, 0).alias("rules"))
    return own.select("key", "level", "rules").unionByName(ends)


def url_filter(spark: SparkSession, pages: DataFrame, rules=RULES, default: str = DEFAULT, range_urls: int = RANGE_URLS) -> DataFrame:
    """Judge each url by the longest rule that fits.

    Urls and the boundaries of all rules are sorted by key to ranges of about ``range_urls`` rows, where urls of one host are in
    no order, so a host that holds a third of all rows takes many ranges. Each range is swept with a stack that has a place for
    every level of the rules: a url meets what the boundaries at or before its key left there. The stack at the beginning of
    a range comes from the last boundaries of the ranges before it, by a window of one row a range. Of the stack the longest rule whose
    path starts the url's path decides (total length of host and path, then the longer host, then text order). Ranges are
    written before they are swept, so that all who read them see the same; no rule table is broadcast.

    Returns page_id, host, path, rule, verdict, one row per input row. Null urls, urls without ``://`` and urls that
    no rule fits have rule null and the ``default`` verdict; repeated rows and null page_ids are kept as they are; of equal rules one
    counts. Empty tables give no rows, and without rules all urls have the default; other columns are ignored.
    """
    scratch = Scratch(spark, "urls")
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", path.alias("path"), host_key(host).alias("key"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("tie"))
    events = scratch.save(boundaries(rule_table(spark, rules)), "boundaries")
    levels = sorted(r["level"] for r in events.select("level").distinct().collect())  # at most the labels of a host
    places = [f"place_{n}" for n in levels]
    events = events.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("tie"), *[F.when(F.col("level") == n, F.col("rules")).alias(p) for n, p in zip(levels, places)])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // range_urls))
    cut = urls.unionByName(events, allowMissingColumns=True).repartitionByRange(n, "key", "kind", "tie").drop("tie")
    ranges = scratch.save(cut.withColumn("range", F.spark_partition_id()), "ranges")

    lasts = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col("key"))).alias(p) for p in places]
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    left = spark.range(n).select(F.col("id").cast("int").alias("range"))
    if places:
        left = left.join(ranges.filter("kind = 0").groupBy("range").agg(*lasts), "range", "left")
    left = left.select("range", F.lit("").alias("key"), F.lit(-1).alias("kind"), *[F.last(p, ignorenulls=True).over(before).alias(p) for p in places])
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.array().cast(RULE_LIST)
    stack = F.concat(none, *[F.coalesce(F.last(p, ignorenulls=True).over(sweep), none) for p in places])
    found = ranges.unionByName(left, allowMissingColumns=True).withColumn("stack", stack).filter("kind = 1")
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("host_size"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict")))
    return found.withColumn("best", F.array_max(ranked)).select(
        "page_id", host_of(F.col("key")).alias("host"), "path",
        F.when(F.col("best").isNotNull(), F.concat("best.host", "best.path")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the contract's rules; null urls and urls without a host as in ``url_filter``."""
    return url_filter(spark, read_table(spark, sf_dir, "pages").select("page_id", "url"))


OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
