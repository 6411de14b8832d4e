"""URL filters by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it fits must hold.
The tokens' frequencies over all URLs decide which of a rule's tokens it is filed under;
a URL's tokens fetch the rules filed under them, and only those rules' expressions run.
DataFrame and SQL functions only.

Site rules (host and path) come first, of them the longest (by its text, then by its host;
block before allow in a tie); where none fits, a URL is blocked if a pattern rule fits, else allowed.

Defined results: a null url, or one without "://", has an empty host and path and is judged by pattern rules
over its text alone (null: allow); repeated rows and ids are judged row by row; no rules allow everything. Other columns
stay out of the way: only page_id and url are read. The rule list is configuration: more than ``MAX_RULES`` is an error,
which bounds what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Name, expression over the URL with A-Z lower-cased, and literal tokens that it can't do without.
PATTERN_RULES = (
    ("spam-farm", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    ("casino", r"[./-]casino[./-]", ("casino",)),
    ("porn", r"[./-]porn[./-]", ("porn",)),
    ("free-pills", r"[./-]free-pills?[./-]", ("free",)),
    ("malware-download", r"/malware/download", ("malware", "download")),
)
SPLIT = "[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, sites: Sequence[tuple[str, str, str]], patterns: Sequence[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    if len(sites) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = []
    for verdict, host, path in sites:
        # what stands between two marks in the rule stands so in every URL that fits; the last part may be cut off
        tokens = {t for t in re.split(SPLIT, host + "/") if t} | {t for t in re.split(SPLIT, path.translate(str.maketrans(UPPER, LOWER)))[:-1] if t}
        rows.append(("site", f"{host}{path}", verdict, rf"(?s)^([^/?#]*\.)?{re.escape(host)}{re.escape(path)}", sorted(tokens), len(host)))
    for name, pattern, tokens in patterns:
        if not tokens:
            raise ValueError(f"rule {name} has no literal token")
        rows.append(("pattern", name, "block", pattern, sorted(tokens), 0))
    return spark.createDataFrame(rows, "kind string, name string, verdict string, pattern string, tokens array<string>, host_chars int")


def judge(pages: DataFrame, sites: Sequence = SITE_RULES, patterns: Sequence = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and reason (the rule's or pattern's name) of every row."""
    spark = pages.sparkSession
    rules = rule_table(spark, sites, patterns)
    urls = pages.where("url is not null").select(F.col("url").cast("string").alias("url")).distinct()
    tokens = urls.select("url", F.explode(F.array_distinct(F.split(F.translate("url", UPPER, LOWER), SPLIT))).alias("token")).where("token <> ''")
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(F.broadcast(wanted), "token").groupBy("token").count()
    by_token = rules.withColumn("token", F.explode("tokens")).join(F.broadcast(counts), "token", "left")
    filed = by_token.groupBy("kind", "name", "verdict", "pattern", "host_chars").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"))
    candidates = tokens.join(F.broadcast(filed), "token")
    subject = F.when(F.col("kind") == "site", F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.translate("url", UPPER, LOWER))
    # a site's rule needs a host: a URL without "://" has none
    fits = candidates.withColumn("subject", subject).where("regexp_like(subject, pattern)")
    best = fits.groupBy("url").agg(
        F.max_by(
            F.struct("kind", "name", "verdict"),
            F.struct(F.col("kind") == "site", F.length("name"), F.col("host_chars"), F.col("verdict") == "block", F.col("name")),
        ).alias("best")
    )
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    # null urls have no rule to meet, and would all meet in one task of the join
    out = own.where("url is not null").join(best, "url", "left")
    out = out.unionByName(own.where("url is null"), allowMissingColumns=True)
    return out.select(
        F.col("page_id").cast("long").alias("page_id"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("best.kind") == "site", F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("best.name", F.lit("")).alias("reason"),
    )


ORACLE_SQL = r"""
with p as (
  select page_id, coalesce(url, '') as url,
    translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) as path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from pages
), r as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
    case
    when regexp_matches(low, '[./-]casino[./-]') and not regexp_matches(low, '/malware/download|[./-]free-pills?[./-]|://([^/?#]*\.)?spam-farm\.') then 'casino'
    when regexp_matches(low, '/malware/download') then 'malware-download'
    when regexp_matches(low, '[./-]free-pills?[./-]') then 'free-pills'
    when regexp_matches(low, '://([^/?#]*\.)?spam-farm\.') then 'spam-farm'
    when regexp_matches(low, '[./-]porn[./-]') then 'porn' end as pattern
  from p
)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or pattern is not null then 'block' else 'allow' end as verdict,
  coalesce(rule, pattern, '') as reason
from r
"""
