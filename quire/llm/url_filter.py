"""URL rules by hashed expressions: each URL is expanded into host suffixes and path prefixes, these meet the rules on a
short hash prefix, the full digest confirms, and the most specific rule decides."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups

#: Hex digits of the digest that the join uses; the whole digest confirms.
PREFIX = 8
#: Rules up to this number and these bytes are broadcast; more are joined by shuffle.
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 32 << 20
RULES = "host string, path string, action string"
#: What stands between host and path where they are hashed; neither of a url's can hold it.
BETWEEN = "#"


def url_parts(url):
    """(host, path) columns: host after the first :// up to / ? # or end, A-Z lower-cased; path up to ? # or end; both empty without ://."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lower).otherwise(""), F.when(found, path).otherwise("")


def make_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (host, path, action)."""
    return spark.createDataFrame(rules, RULES)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every page judged: (page_id, host, path, rule, verdict).

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins; of equally long
    ones the one with the longer host, then `block`, then by code point. Where none fits, rule is null and the verdict is
    `default`. Null and odd urls have empty host and path. Rows stay one to one, also where page_id repeats or is null; an empty
    table of rules fits nothing, one of pages gives no row. Other columns of pages are not read. Rules and urls may be of any length.
    """
    rules = rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action").distinct()
    shapes = rules.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")).alias("bytes"),
        F.collect_set(F.length("rule_path")).alias("paths"), F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
    ).first()  # two sets of small numbers
    rule, said = F.concat("rule_host", "rule_path"), F.concat("rule_host", F.lit(BETWEEN), "rule_path")
    ready = rules.select(rule.alias("rule"), F.length("rule_host").alias("host_length"), "action", F.sha2(said, 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    ready = ready.groupBy("prefix", "digest", "rule").agg(F.max(F.struct("host_length", F.col("action") == "block", "action")).alias("best"))
    ready = ready.select("prefix", "digest", F.struct(F.length("rule").alias("length"), F.col("best.host_length").alias("host_length"), "rule", F.col("best.action").alias("action")).alias("fits"))

    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    label, some = F.split("host", r"\.", -1), lambda numbers: F.lit(sorted(numbers)) if numbers else F.array().cast("array<int>")
    hosts = F.transform(F.filter(some(shapes.labels), lambda n: n <= F.size(label)), lambda n: F.array_join(F.slice(label, -n, n), "."))
    paths = F.transform(F.filter(some(shapes.paths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    each = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit(BETWEEN), p))))
    expressions = parts.select("row", "page_id", "host", "path", F.explode_outer(each).alias("expression")).withColumn("full", F.sha2("expression", 256)).withColumn("prefix", F.substring("full", 1, PREFIX))
    if shapes.n <= BROADCAST_RULES and (shapes.bytes or 0) <= BROADCAST_BYTES:
        met = expressions.join(F.broadcast(ready), "prefix", "left").withColumn("fits", F.when(F.col("full") == F.col("digest"), F.col("fits")))
        return _judged(met.groupBy("row", "page_id", "host", "path").agg(F.max("fits").alias("fits")), default)
    # a prefix that many urls have, as that of a popular host, is not gathered in one task; few rules share one
    alike = ready.groupBy("prefix").agg(F.collect_list(F.struct("digest", "fits")).alias("rules"))
    heard = cut(expressions.groupBy("prefix").agg(F.count("*").alias("urls")).join(alike, "prefix"))
    met = join_groups(expressions, heard, "prefix", "urls", max(1, heard.agg(F.sum("urls")).first()[0] or 0))
    fitting = met.select("row", "full", F.explode("rules").alias("r")).filter(F.col("full") == F.col("r.digest")).groupBy("row").agg(F.max("r.fits").alias("fits"))
    return _judged(parts.join(fitting, "row", "left"), default)


def _judged(best: DataFrame, default: str) -> DataFrame:
    return best.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.action", F.lit(default)).alias("verdict"))
