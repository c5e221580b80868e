"""URL filters over host and path rules. DataFrame functions only.

A rule has a host and a path and fits its host and all subdomains where the URL's path starts with
the rule's. Each URL is expanded into the expressions (host suffix + path prefix) that could equal
a rule; these are joined with the rules on the first 4 bytes of their SHA-256, then the full digest
is compared. Of the rules that fit, the longest wins; at equal length the one with the longer host,
then block before allow.

Only suffixes and prefixes of a length that some rule has are formed, so long hosts and paths cost
no more than the rules ask for: prefixes ending in a slash at the lengths of rule paths that do, others
at the lengths of rule paths that do not.

Cases: a null URL, or one without ``://``, has an empty host and path, and no rule fits; a rule
path must be present in the URL's path, so ``/`` does not fit an empty path; with no rules every
URL gets the default verdict; rules with a null host or path are ignored, repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join runs on.
SHORT_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path with its leading slash, verdict) as a table."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lengths(rules: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Lengths of rule hosts, of rule paths that end in a slash, and of other rule paths."""
    slash = F.col("path").endswith("/")
    row = rules.agg(
        F.collect_set(F.length("host")).alias("hosts"),
        F.collect_set(F.when(slash, F.length("path"))).alias("folders"),
        F.collect_set(F.when(~slash, F.length("path"))).alias("others"),
    ).first()
    return sorted(row.hosts), sorted(row.folders), sorted(row.others)


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def expansions(host: Column, path: Column, hosts: list[int], folders: list[int], others: list[int]) -> Column:
    """Array of the expressions of a URL that could equal a rule of these lengths."""
    n, m = F.length(host), F.length(path)
    suffixes = F.transform(
        F.filter(_numbers(hosts), lambda k: (k == n) | ((k < n) & (F.substring(host, n - k, 1) == "."))), lambda k: F.substring(host, n - k + 1, k)
    )
    ends = F.concat(
        F.filter(_numbers(folders), lambda k: (k <= m) & (F.substring(path, k, 1) == "/")), F.filter(_numbers(others), lambda k: k <= m)
    )
    prefixes = F.transform(ends, lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Every row with ``id``, ``host``, ``path``, the ``rule`` that wins (or null) and its ``verdict``.

    Rows are numbered as they are read, and their expressions are reduced to one row per page by a
    partial aggregate, so a popular host needs no task of its own.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = _lengths(rules)
    digest = F.sha2(F.concat("host", "path"), 256)
    listed = rules.select(
        F.substring(digest, 1, SHORT_DIGITS).alias("short"),
        digest.alias("full"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), "verdict", F.concat("host", "path").alias("rule")
        ).alias("rule"),
    )
    seen = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    spread = seen.select("*", F.explode_outer(expansions(F.col("host"), F.col("path"), *lengths)).alias("expression"))
    hashed = spread.withColumn("digest", F.sha2("expression", 256)).drop("expression")
    near = hashed.join(listed, F.substring("digest", 1, SHORT_DIGITS) == F.col("short"), "left")
    fits = F.when(F.col("digest") == F.col("full"), F.col("rule"))
    best = near.groupBy("row", "id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select(F.col("id").alias(id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
