"""URL filters by token-indexed pattern rules, in DataFrame functions alone.

Pattern rules come from a table. Each names the literal tokens that a matching URL holds and is filed under the one that
the fewest URLs of the input have. A URL's own tokens fetch its candidate rules, and only these run their regular
expressions. The index is a table of buckets by the token's hash that travels in the plan, so a URL is judged without a
shuffle; tables with more rules than that are joined on the token instead. Host and path rules come before them: the
longest that fits decides.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, LOWER, UPPER, saved

#: Rules that travel in the plan at most, and buckets of their index.
IN_PLAN = 50_000
BUCKETS = 4096


class SiteRule(NamedTuple):
    action: str
    host: str
    path: str


class PatternRule(NamedTuple):
    action: str
    tokens: tuple[str, ...]  # runs of a-z and 0-9 that every matching URL holds whole
    pattern: str  # over the lower-cased URL


SITE_RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)


def _rule(action: str, tokens: str, pattern: str | None = None) -> PatternRule:
    """tokens, separated by blanks; without a pattern they stand in a row with '-', '_', '.' or '/' between them."""
    words = tuple(tokens.split())
    return PatternRule(action, words, f"(?:^|[^a-z0-9])(?:{pattern or '[-_./]'.join(words)})(?:[^a-z0-9]|$)")


#: Earlier rules come first; an allow rule that matches overrides all block rules.
PATTERN_RULES = (
    _rule("allow", "gambling help"), _rule("allow", "responsible gambling"), _rule("allow", "casino royale"), _rule("allow", "poker face"),
    _rule("allow", "sex education"), _rule("allow", "breast cancer"), _rule("allow", "virus taxonomy"), _rule("allow", "robots txt"),
    _rule("block", "casino"), _rule("block", "casinos"), _rule("block", "free bets"), _rule("block", "freebets"), _rule("block", "sports betting"),
    _rule("block", "online betting"), _rule("block", "slots"), _rule("block", "poker"), _rule("block", "jackpot"), _rule("block", "roulette"),
    _rule("block", "blackjack"), _rule("block", "bet now"), _rule("block", "bingo bonus"), _rule("block", "lottery winner"),
    _rule("block", "cheap pills"), _rule("block", "cheap meds"), _rule("block", "viagra"), _rule("block", "cialis"), _rule("block", "xanax"),
    _rule("block", "online pharmacy"), _rule("block", "no prescription"), _rule("block", "weight loss pills"), _rule("block", "diet pills"),
    _rule("block", "miracle cure"), _rule("block", "porn"), _rule("block", "xxx"), _rule("block", "adult cams"), _rule("block", "hot singles"),
    _rule("block", "escort service"), _rule("block", "escorts"), _rule("block", "nude"), _rule("block", "hookup"), _rule("block", "sex cams"),
    _rule("block", "payday loan"), _rule("block", "payday loans"), _rule("block", "fast cash"), _rule("block", "quick loans"), _rule("block", "debt relief"),
    _rule("block", "make money fast"), _rule("block", "get rich"), _rule("block", "work from home"), _rule("block", "crypto giveaway"),
    _rule("block", "double your bitcoin"), _rule("block", "forex signals"), _rule("block", "binary options"), _rule("block", "free iphone"),
    _rule("block", "gift card generator"), _rule("block", "replica watches"), _rule("block", "cheap handbags"), _rule("block", "buy followers"),
    _rule("block", "buy likes"), _rule("block", "seo backlinks"), _rule("block", "backlinks"), _rule("block", "essay writing service"),
    _rule("block", "keygen"), _rule("block", "crack download"), _rule("block", "warez"), _rule("block", "torrent"), _rule("block", "free download full version"),
    _rule("block", "serial key"), _rule("block", "nulled"), _rule("block", "phishing kit"), _rule("block", "malware"), _rule("block", "doubleclick"),
    _rule("block", "adserver"), _rule("block", "popunder"), _rule("block", "track click", r"track[-_./]+click(?:[-_./?][^#]*)?"), _rule("block", "affid", r"[?&]affid=[0-9]+"),
    _rule("block", "wp login php", r"wp-login\.php"), _rule("block", "xmlrpc php", r"xmlrpc\.php"), _rule("block", "cgi bin", r"cgi-bin/[^?#]+"),
    _rule("block", "phpinfo php"), _rule("block", "win prize"), _rule("block", "you won"), _rule("block", "claim reward"), _rule("block", "spin to win"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null and without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: tuple[SiteRule, ...] = SITE_RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else nulls. Of rules of one length the first counts."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, action = F.when(fits, rule.host + rule.path).otherwise(name), F.when(fits, rule.action).otherwise(action)
    return name, action


def url_tokens(url: Column) -> Column:
    """The distinct runs of a-z and 0-9 in the lower-cased URL."""
    return F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"))


def rules_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The pattern rules (n int, action, tokens array<string>, pattern): of a Parquet table, or PATTERN_RULES. The lower n counts first."""
    if path is not None:
        return spark.read.parquet(path).select(F.col("n").cast("int"), "action", "tokens", "pattern")
    return spark.createDataFrame([(n, r.action, list(r.tokens), r.pattern) for n, r in enumerate(PATTERN_RULES)], "n int, action string, tokens array<string>, pattern string")


def filed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (n, action, pattern) with token: of each rule's tokens the one that the fewest URLs of all pages have; ties go to the
    first in order. The url column is read once; a URL's tokens are held against those of the rules before anything moves.
    """
    wanted = saved(rules.select(F.explode("tokens").alias("token")).distinct())
    few = wanted.count() <= BROADCAST_KEYS
    seen = pages.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(F.broadcast(wanted) if few else wanted, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("urls"))
    offered = rules.select("n", "action", "pattern", F.explode("tokens").alias("token")).join(counts, "token", "left")
    least = offered.groupBy("n").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token", "action", "pattern")).alias("r"))
    return saved(least.select("n", "r.action", "r.pattern", "r.token"))


def _first(hits: Column) -> Column:
    """The rule that decides among hits (late, n, a): the first allow rule, else the first block rule; null for none."""
    return F.array_min(hits)


_ENTRY = "array<struct<t:string,late:boolean,n:int,a:string,p:string>>"


def _in_plan(pages: DataFrame, index: DataFrame) -> DataFrame:
    """pages with hit (late, n, a), looked up in an array of buckets."""
    own = index.select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("b"), F.struct(F.col("token").alias("t"), (F.col("action") != "allow").alias("late"), "n", F.col("action").alias("a"), F.col("pattern").alias("p")).alias("e"))
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for r in own.collect():
        buckets[r["b"]].append(r["e"].asDict())
    held = F.from_json(F.lit(json.dumps(buckets)), f"array<{_ENTRY}>")
    fetched = lambda t: F.filter(F.get(held, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")), lambda e: e["t"] == t)
    candidates = F.flatten(F.transform(url_tokens(F.col("url")), fetched))
    lower = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    hits = F.transform(F.filter(candidates, lambda e: F.rlike(lower, e["p"])), lambda e: F.struct(e["late"], e["n"], e["a"]))
    return pages.withColumn("hit", _first(hits))


def _by_join(pages: DataFrame, index: DataFrame) -> DataFrame:
    """The same by joins: distinct URLs meet their candidates on the token, and what they hit is joined back on the URL."""
    urls = saved(pages.select("url").filter("url IS NOT NULL").distinct())
    lower = F.translate(F.col("url"), UPPER, LOWER)
    met = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token").filter(F.rlike(lower, F.col("pattern")))
    hits = met.groupBy("url").agg(F.min(F.struct((F.col("action") != "allow").alias("late"), "n", F.col("action").alias("a"))).alias("hit"))
    return pages.join(hits, "url", "left")


def filter_urls(pages: DataFrame, sites: tuple[SiteRule, ...] = SITE_RULES, rules: DataFrame | None = None, in_plan: int = IN_PLAN) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule: one row per row of pages (page_id, url); other columns aren't read.

    rule: the site rule that decides, else null. verdict: its action, else that of the deciding pattern rule, else allow.
    pattern_rule: that rule's n, else null. rules: see rules_table. A null or empty URL, or one without '://', has an empty host and
    path and is held against the pattern rules alone. Rows that repeat are judged alike; an empty table gives no rows, and without
    rules all is allowed. URLs of any length are read whole.
    """
    host, path = url_parts(F.col("url"))
    name, action = site_rule(F.col("host"), F.col("path"), sites)
    own = pages.select("page_id", "url")
    index = filed(own, rules_table(pages.sparkSession) if rules is None else rules)
    judged = _in_plan(own, index) if index.count() <= in_plan else _by_join(own, index)
    parts = judged.select("page_id", host.alias("host"), path.alias("path"), "hit")
    return parts.select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, F.col("hit.a"), F.lit("allow")).alias("verdict"), F.col("hit.n").alias("pattern_rule"))


def _oracle() -> str:
    sites = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in SITE_RULES)
    values = ",\n    ".join(f"({n}, {int(r.action != 'allow')}, '{r.action}', '{r.pattern}')" for n, r in enumerate(PATTERN_RULES))
    return f"""
WITH sites(action, host, path) AS (VALUES {sites}),
patterns(n, late, action, p) AS (VALUES
    {values}
),
rests AS (
  SELECT page_id, row_number() OVER () AS row_no, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT page_id, row_no, lower_url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
),
fits AS (
  SELECT row_no, arg_max(s.host || s.path, length(s.host || s.path)) AS rule, arg_max(s.action, length(s.host || s.path)) AS action
  FROM parts p JOIN sites s ON (p.host = s.host OR ends_with(p.host, '.' || s.host)) AND starts_with(p.path, s.path)
  GROUP BY row_no
),
hits AS (SELECT row_no, min((late, n)) AS hit FROM parts JOIN patterns ON regexp_matches(lower_url, p) GROUP BY row_no),
named AS (SELECT h.row_no, t.n, t.action FROM hits h JOIN patterns t ON (t.late, t.n) = h.hit)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.action, m.action, 'allow') AS verdict, m.n AS pattern_rule
FROM parts p LEFT JOIN fits f USING (row_no) LEFT JOIN named m USING (row_no)
"""


ORACLE = _oracle()
