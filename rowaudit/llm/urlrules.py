"""URL filter rules, indexed by their rarest literal token.  DataFrame functions only.

A rule is a regular expression over host and path joined, with the literal tokens
(runs of ASCII letters and digits, lower-cased) that any URL it matches must contain.
Token frequencies are counted over all URLs, for tokens of rules only; each rule is
filed under its rarest token.  A URL's tokens then fetch the candidate rules, and only
these run their expression.  Rules without a literal token are tried on every URL.

Two families share the index: host/path rules (``example.com/en/`` fits the host and
all its subdomains if the path starts with the rule's path; the longest that fits wins)
and pattern rules, which decide only where no host/path rule fits (block before allow,
then by name).  A URL that no rule matches gets the default verdict.

The rule table is a small configuration: it is broadcast only up to ``BROADCAST_RULES``
rows and joined by shuffle beyond.  Hits are grouped by host and path, so a URL that
occurs in many rows is judged once.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets
the default verdict (no literal token, no rule); empty tables give empty results;
repeated rows stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowaudit.llm.common import fresh

BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    length: int = 0
    host_path: bool = False


def host_rule(action: str, host: str, path: str = "/") -> UrlRule:
    """A rule for a host with all its subdomains and a path prefix."""
    literal = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    labels = re.findall("[a-z0-9]+", host.lower())
    # a token of the path counts only if the rule itself bounds it on both sides
    segments = re.findall("(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return UrlRule(host + path, action, literal, tuple(dict.fromkeys(labels + segments)), len(host + path), True)


def pattern_rule(name: str, action: str, pattern: str, *tokens: str) -> UrlRule:
    """A regular expression; ``tokens`` are literals that every match contains as whole tokens."""
    return UrlRule(name, action, pattern, tuple(t.lower() for t in tokens))


HOST_RULES = [
    host_rule("allow", "com"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/"),
]
#: Pattern rules of the method: promotion and abuse hosts, and machine pages.
PATTERN_RULES = [
    pattern_rule("spam host", "block", r"^(?:[^/]*[.-])?spam[.-]", "spam"),
    pattern_rule("pill shop", "block", r"^(?:[^/]*[.-])?pills[.-]", "pills"),
    pattern_rule("casino", "block", r"^(?:[^/]*[.-])?casino[.-]", "casino"),
    pattern_rule("betting", "block", r"^(?:[^/]*[.-])?bets[.-]", "bets"),
    pattern_rule("adult host", "block", r"^(?:[^/]*[.-])?adult[.-]", "adult"),
    pattern_rule("ad server", "block", r"^(?:[^/]*\.)?ads[.-]", "ads"),
    pattern_rule("tracker path", "block", r"/track/", "track"),
    pattern_rule("login page", "block", r"/login(?:[./]|$)", "login"),
    pattern_rule("shopping cart", "block", r"/cart(?:[./]|$)", "cart"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pat = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pat, 1), UPPER, LOWER), F.regexp_extract(u, pat, 2)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """One row per rule, as an inline table of constants."""
    rows = [F.struct(F.lit(i).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.action).alias("action"),
                     F.lit(r.pattern).alias("pattern"), F.lit(r.length).alias("length"), F.lit(r.host_path).alias("host_path"),
                     F.array(*[F.lit(t) for t in r.tokens]).cast("array<string>").alias("tokens"))
            for i, r in enumerate(rules)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def index_rules(rules: DataFrame, targets: DataFrame, n_rules: int, target: str = "target") -> DataFrame:
    """``rules`` with ``token``: the rarest of its tokens over all of ``targets``; null without tokens."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    wanted = F.broadcast(wanted) if n_rules <= BROADCAST_RULES else wanted
    seen = targets.select(F.explode(url_tokens(F.col(target))).alias("token")).join(wanted, "token")
    seen = seen.groupBy("token").agg(F.count(F.lit(1)).alias("_seen"))
    each = rules.withColumn("token", F.explode_outer("tokens")).join(seen, "token", "left")
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("_seen", F.lit(0)), "token")
    return each.withColumn("_r", F.row_number().over(rarest)).where("_r = 1").drop("_r", "_seen", "tokens")


def apply_rules(pages: DataFrame, rules: list[UrlRule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` plus host, path, rule, verdict and pattern_rule
    (the pattern rule that decided, or null).  A clashing column is replaced."""
    made = {"host", "path", "rule", "verdict", "pattern_rule"}
    keep = [c for c in pages.columns if c.lower() not in made or c == url]
    t, t2, h, p = fresh(pages, "_ut", "_ut2", "_uh", "_up")
    host, path = split_url(F.col(f"`{url}`"))
    df = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    df = df.withColumn(t, F.concat("host", "path"))
    if not rules:
        return df.drop(t).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default),
                                       "pattern_rule": F.lit(None).cast("string")})
    urls = df.select(F.col(t).alias("target")).where(F.col("target") != "")
    index = index_rules(rule_table(pages.sparkSession, rules), urls, len(rules))
    lookup = F.broadcast(index.where("token is not null")) if len(rules) <= BROADCAST_RULES else index.where("token is not null")
    got = urls.withColumn("token", F.explode(url_tokens(F.col("target")))).join(lookup, "token")
    got = got.where(F.rlike("target", "pattern")).select("target", "rule_name", "action", "length", "host_path")
    for r in rules:
        if not r.tokens:  # no literal to look up: tried on every URL
            got = got.unionByName(urls.where(F.col("target").rlike(r.pattern)).select(
                "target", F.lit(r.name).alias("rule_name"), F.lit(r.action).alias("action"),
                F.lit(r.length).alias("length"), F.lit(r.host_path).alias("host_path")))
    longest = F.max(F.when(F.col("host_path"), F.struct("length", "rule_name", "action")))
    first = F.min(F.when(~F.col("host_path"), F.struct((F.col("action") != "block").alias("late"), "rule_name", "action")))
    hits = got.groupBy(F.col("target").alias(t2)).agg(longest.alias(h), first.alias(p))
    df = df.join(hits, F.col(t) == F.col(t2), "left")
    return df.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col(f"{h}.rule_name").alias("rule"),
                     F.coalesce(f"{h}.action", f"{p}.action", F.lit(default)).alias("verdict"),
                     F.when(F.col(h).isNull(), F.col(f"{p}.rule_name")).alias("pattern_rule"))
