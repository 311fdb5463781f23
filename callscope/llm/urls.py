"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` and the tokens (runs of letters and
digits) that every match must hold whole. Each rule is filed under the one of its
tokens that the fewest distinct URLs have. The tokens of a URL fetch the rules filed under
them, and only those run their regular expression. Rules without a whole token are filed
under the empty token, which every URL has, so they are tried on all.

A host rule like ``example.net/en/`` fits its host and all subdomains if the path starts with
the rule's; of the host rules that fit a URL the longest decides, ties by name. Where none
fits, the pattern rule of greatest weight does, and without any the default verdict holds.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the default
verdict; a rule list may be empty; rows with equal URLs or ids are judged alike, one
result each; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "rule string, host_rule boolean, pattern string, tokens array<string>, action string, weight long"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What the method blocks by itself, by words of the host (adverts, trackers, gambling, pharmacy, adult) ...
BLOCKED_HOSTS = (
    "ads", "ad", "adserver", "banner", "banners", "popup", "popunder", "spam", "track", "tracker", "tracking",
    "casino", "casinos", "betting", "jackpot", "poker", "free bets", "free spins", "online slots", "sports bets", "bet bonus",
    "viagra", "cialis", "cheap pills", "diet pills", "online pharmacy", "discount pharmacy", "buy pills", "no prescription",
    "porn", "xxx", "escorts", "adult cams", "live cams", "hot singles", "payday loans", "click farm",
)
#: ... and by words of the path, one after another.
BLOCKED_PATHS = ("ads click", "banner click", "affiliate click", "track click", "popunder", "adserver", "buy viagra", "casino bonus", "free spins", "cheap pills")


def host_rule(rule: str, action: str) -> tuple:
    """A rule ``host/path`` for a host, its subdomains and the paths that start with ``/path``."""
    host, slash, rest = rule.partition("/")
    host = host.translate(str.maketrans(UPPER, LOWER))
    path = slash + rest
    pattern = r"(?s)^(?:[^/]*\.)?" + re.escape(host) + re.escape(path) + ".*"
    # A token at the rule's end may go on in the URL, unless the rule ends with a separator.
    whole = re.findall(r"[A-Za-z0-9]+", host) + re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    if not path:
        whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", host)
    return rule, True, pattern, whole, action, len(rule)


def words_rule(words: str, action: str, part: str = "host") -> tuple:
    """A pattern rule for hosts, or paths, that hold some words one after another, each parted from the next by one sign."""
    tokens = words.split()
    inside = "[^A-Za-z0-9/]" if part == "host" else "[^A-Za-z0-9]"
    run = r"(?<![A-Za-z0-9])" + inside.join(map(re.escape, tokens)) + r"(?![A-Za-z0-9])"
    pattern = rf"(?s)^[^/]*{run}[^/]*(?:/.*)?$" if part == "host" else rf"(?s)^[^/]*/(?:.*[^A-Za-z0-9])?{run}.*$"
    return f"{part}:{words}", False, pattern, tokens, action, len(tokens)


def common_rules() -> list[tuple]:
    """The general rule set."""
    return [words_rule(w, "block") for w in BLOCKED_HOSTS] + [words_rule(w, "block", "path") for w in BLOCKED_PATHS]


def rules(spark: SparkSession, listed: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(listed), RULES)


def parted(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), _PARTS, i), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def _candidates(distinct: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, path, rule ...) of the rules that share their index token with a URL."""
    whole = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(whole, "[^A-Za-z0-9]+")))
    tokened = distinct.select("host", "path", F.explode(tokens).alias("token"))
    # The empty token is for rules without a whole one.
    wanted = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    entries = listed.withColumn("token", F.explode(wanted))
    counts = tokened.join(entries.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule").orderBy("n", "token")
    index = (
        entries.join(counts, "token", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("place", F.row_number().over(rarest))
        .where("place = 1 and n > 0")
        .drop("place", "n", "tokens")
    )
    return tokened.join(stored(index, "rules"), "token")


def judged(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the host rule that decides (or null) and the verdict."""
    rows = parted(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path")
    distinct = stored(rows.select("host", "path").distinct(), "urls")
    fits = _candidates(distinct, listed).where(F.expr("concat(host, path) rlike pattern"))
    # The longest rule, then the first by name: the least of (-weight, rule).
    best = F.min(F.when(F.col("host_rule"), F.struct((-F.col("weight")).alias("w"), "rule", "action")))
    other = F.min(F.when(~F.col("host_rule"), F.struct((-F.col("weight")).alias("w"), "rule", "action")))
    found = stored(fits.groupBy("host", "path").agg(best.alias("best"), other.alias("other")), "verdicts")
    verdict = F.coalesce("best.action", "other.action", F.lit(default))
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")
    )
