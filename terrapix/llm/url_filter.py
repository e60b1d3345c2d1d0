"""URL filters: rules indexed by their rarest literal token.

A rule is ``host/path-prefix``: it fits its host and all subdomains when the
URL's path starts with the rule's path; ``*`` stands for any run of
characters.  Each rule is filed under the literal token (run of ASCII
letters and digits, complete on both sides) that the fewest URLs contain.
A URL's own tokens fetch candidate rules, and only those run their regular
expression.  Rules without a complete literal are filed under the empty
token, which every URL has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Up to this many rules (counted, not estimated) travel as a broadcast; more
# are joined by a shuffle on the token.
MAX_BROADCAST_RULES = 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_regex(rule: Column) -> Column:
    """The expression a URL's host + path must match; literals are quoted, ``*`` is a wildcard."""
    quoted = F.replace(rule, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    quoted = F.replace(quoted, F.lit("*"), F.lit("\\E[\\s\\S]*\\Q"))
    return F.concat(F.lit("^(?:[^/]*\\.)?\\Q"), quoted, F.lit("\\E"))


def rule_tokens(rule: Column) -> Column:
    """Literal tokens that every matching URL contains whole: closed by a literal non-token character."""
    found = F.regexp_extract_all(ascii_lower(rule), F.lit(r"(?<![a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1))
    return F.array_distinct(found)


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Rules with lower-cased hosts, their expression and tokens; null rules or verdicts are dropped.

    Of repeated rules with different verdicts the later verdict in string order (block) wins.
    """
    host = ascii_lower(F.regexp_extract("rule", r"(?s)^([^/]*)", 1))
    shaped = F.concat(host, F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1))
    return (rules.where("rule is not null and verdict is not null")
            .groupBy("rule").agg(F.max("verdict").alias("verdict"))
            .select("rule", "verdict", rule_regex(shaped).alias("regex"), rule_tokens(shaped).alias("tokens")))


def rarest_token_index(rules: DataFrame, url_tokens: DataFrame, small: bool) -> DataFrame:
    """(token, rule, verdict, regex): each rule under its token with the fewest URLs, ties to the smaller token."""
    hint = F.broadcast if small else (lambda df: df)
    wanted = rules.select("rule", F.explode("tokens").alias("token"))
    counts = (url_tokens.join(hint(wanted.select("token").distinct()), "token", "left_semi")
              .groupBy("token").agg(F.count("*").alias("n_urls")))
    best = (wanted.join(counts, "token", "left").groupBy("rule")
            .agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n"), "token")).alias("best"))
            .select("rule", F.col("best.token").alias("token")))
    return (rules.join(best, "rule", "left")
            .select(F.coalesce("token", F.lit("")).alias("token"), "rule", "verdict", "regex"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: (rule, verdict).  Of the rules that fit, the longest wins (ties:
    later in string order); where none fits, ``rule`` is null and ``verdict``
    is ``default``.  Null URLs and URLs without ``://`` have an empty host and
    path and fit no rule with a host.  Repeated rows are each judged; an empty
    table gives an empty result.  Columns of ``pages`` other than ``url`` are
    kept, but for ones named like the four results, which are replaced.
    """
    known = normalise_rules(rules)
    small = known.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)

    # Each different URL is judged once, whatever number of rows holds it.
    urls = (pages.select(F.col(f"`{url}`").alias("url")).where("url is not null").distinct()
            .withColumn("key", F.concat(url_host(F.col("url")), url_path(F.col("url")))))
    found = F.regexp_extract_all(ascii_lower(F.col("key")), F.lit("([a-z0-9]+)"), F.lit(1))
    tokens = F.concat(F.array_distinct(found), F.array(F.lit("")))
    url_tokens = urls.select("url", "key", F.explode(tokens).alias("token"))

    index = rarest_token_index(known, url_tokens.select("token"), small)
    fits = url_tokens.join(hint(index), "token").where(F.expr("key rlike regex"))
    best = (fits.groupBy("url")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
            .select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    # A row travels as one value, so that its columns may have any name; rows without a URL are joined with nothing.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").alias("url"))
    judged = (rows.where("url is not null").join(best, "url", "left")
              .unionByName(rows.where("url is null"), allowMissingColumns=True))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*[F.col("row")[c].alias(c) for c in keep], url_host(F.col("url")).alias("host"),
                         url_path(F.col("url")).alias("path"), F.col("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
