"""URL filter: pattern rules, indexed by their rarest literal token.

A rule has a verdict and a pattern `host/path`, in which `*` stands for any run of characters of the path. It fits its host
and all subdomains if the url's path starts with the rule's. Each rule is filed under one literal token of its pattern, the
one that the fewest urls of the corpus hold; the tokens of a url fetch candidate rules, and only those run their regular
expressions. Rules without a usable token are filed under the empty token, which every url has. Everything here is
DataFrame operations.

Rows: a null url, and one without `://`, has an empty host and path, no rule and the default verdict. Equal urls are judged
once. Of several rules that fit, the one with the longest pattern wins, of equally long ones the first in text order.
An empty table gives an empty result; other columns of the input, whatever their names, are left out of the work and only
`keep` ones are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules of the contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT_VERDICT = "allow"
#: A rule list of at most so many patterns is small enough to broadcast whole; a longer one is joined by shuffling.
BROADCAST_RULES = 100_000
TOKEN = "[A-Za-z0-9]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def compiled(pattern: str) -> tuple[str, list[str]]:
    """The regular expression of a rule, run on host and path together, and its usable literal tokens: those that
    something other than a letter or digit surely surrounds."""
    host, slash, path = pattern.partition("/")
    text = re.escape(host) + "".join(".*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", slash + path))
    tokens = {m[0] for m in re.finditer(TOKEN, host)} if slash else {m[0] for m in re.finditer(TOKEN + r"(?=\.)", host)}
    for m in re.finditer(TOKEN, path):
        around = path[m.start() - 1:m.start()] if m.start() else "/"
        after = path[m.end():m.end() + 1]
        if around != "*" and after not in ("", "*"):
            tokens.add(m[0])
    return rf"(?s)^(?:[^/]*\.)?{text}.*$", sorted(tokens)


def rule_frame(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per rule and usable token (the empty token where there is none)."""
    rows = [(verdict, pattern, *compiled(pattern)) for verdict, pattern in dict.fromkeys(rules)]
    schema = "rule_verdict string, rule string, regex string, tokens array<string>"
    return spark.createDataFrame(rows, schema).withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))


def judge_urls(pages: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """`keep`, host, path, rule and verdict of every row."""
    spark = pages.sparkSession
    host, path = split_url(F.col("__url"))
    rows = pages.select(*[F.col(c) for c in keep], F.col(url).alias("__url"))
    distinct = rows.select("__url").distinct().withColumn("__full", F.concat(host, path))
    tokens = distinct.select("__url", "__full", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("__full", F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))).alias("token"))

    filed = rule_frame(spark, rules)
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda frame: frame)
    wanted = filed.select("token").distinct()
    counts = tokens.join(hint(wanted), "token", "left_semi").groupBy("token").count()
    index = (filed.join(counts, "token", "left").groupBy("rule", "rule_verdict", "regex")
             .agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")))

    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule")))
    fits = tokens.join(hint(index), "token").where(F.expr("rlike(__full, regex)"))
    fits = fits.groupBy("__url").agg(best.alias("__best"))
    h, p = split_url(F.col("__url"))
    return (rows.join(fits, "__url", "left")
            .select(*keep, h.alias("host"), p.alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.rule_verdict", F.lit(default)).alias("verdict")))


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT h.page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
      FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT h.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM h LEFT JOIN f ON h.page_id = f.page_id
"""
