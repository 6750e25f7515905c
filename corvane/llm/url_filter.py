"""URL filter: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS
from corvane.llm.licenses import LOWER, UPPER

WORD = re.compile(r"[a-z0-9]+")


class Rule(NamedTuple):
    """`regex` is searched in host + path + rest of a url; `tokens` are words that any url it fits has whole."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    #: Host rules go before patterns, longer ones before shorter.
    rank: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits `host` and its subdomains where the url's path starts with `path`, which starts with a slash."""
    regex = r"^(?:[^/?#]*\.)?" + re.escape(host) + re.escape(path)
    whole = path if not WORD.match(path[-1:].lower()) else path[: len(path.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))]
    return Rule(host + path, verdict, regex, tuple(WORD.findall(f"{host} {whole}".lower())), 1_000_000 + len(host + path))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """Fits urls that hold `pattern` in any case of A-Z; `^` is an end or a separator, which is neither a letter or digit
    nor one of `_-.%`; `*` is any text."""
    parts = {"^": r"(?:^|[^A-Za-z0-9_.%-]|$)", "*": r"[\s\S]*"}
    regex = "(?i)" + "".join(parts.get(c, re.escape(c)) for c in pattern)
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", pattern.lower())
    if pattern[:1].isalnum():
        tokens = tokens[1:]
    if pattern[-1:].isalnum():
        tokens = tokens[:-1]
    return Rule(pattern, verdict, regex, tuple(tokens), len(pattern))


def label_rule(verdict: str, label: str) -> Rule:
    """Fits urls of hosts one of whose labels, the last one aside, is `label`."""
    return Rule(label + ".", verdict, r"(?i)^(?:[^/?#]*\.)?" + re.escape(label) + r"\.", tuple(WORD.findall(label)), len(label) + 1)


# The host rules that the query judges by.
HOST_RULES = [
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]
# Pages without prose of their own, and hosts of no use for training.
PATTERN_RULES = [
    pattern_rule("block", x)
    for x in (
        "/wp-admin/",
        "/wp-login.php^",
        "/wp-json/",
        "/xmlrpc.php^",
        "/login^",
        "/logout^",
        "/signin^",
        "/signup^",
        "/register^",
        "/password-reset^",
        "/account/",
        "/cart/",
        "/basket/",
        "/checkout/",
        "/wishlist/",
        "/captcha/",
        "/cgi-bin/",
        "/search^*^q=",
        "^replytocom=",
        "^sessionid=",
        "^phpsessid=",
        "^jsessionid=",
        "^add-to-cart=",
        "/trackback/",
        "/feed/",
        "/rss^",
        "/sitemap.xml^",
        "/robots.txt^",
        "/calendar/*^month=",
        "/print/",
        "/share^*^url=",
        ".jpg^",
        ".jpeg^",
        ".png^",
        ".gif^",
        ".svg^",
        ".css^",
        ".js^",
        ".ico^",
        ".mp3^",
        ".mp4^",
        ".zip^",
        ".exe^",
        ".apk^",
        ".dmg^",
        ".iso^",
        "^porn^",
        "^xxx^",
        "^escorts^",
        "^casino^",
        "^slots^*^bonus^",
        "^viagra^",
        "^cialis^",
        "^warez^",
        "^keygen^",
        "^payday-loans^",
        "^torrent^*^download^",
        "^doorway^",
        "^linkfarm^",
        "^spam^",
    )
] + [label_rule("block", x) for x in ("porn", "xxx", "escorts", "casino", "viagra", "cialis", "warez", "keygen", "payday-loans")]


def _host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([\s\S]*)", 1), F.lit(""))


def _tokens(subject: Column) -> Column:
    """The words of a url, and the empty word, under which rules without a token are kept."""
    return F.array_distinct(F.concat(F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(""))))


def rule_index(tokens: DataFrame, rules: list[Rule]) -> list[tuple]:
    """(token, name, verdict, regex, rank): each rule under its rarest token, counted over all of `tokens` (token).

    Only counts of the rules' own tokens come to the driver, a number for each.
    """
    words = sorted({t for rule in rules for t in rule.tokens})
    spark = tokens.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "token string")
    asked = F.broadcast(asked) if len(words) <= BROADCAST_ROWS else asked
    counts = {r[0]: r[1] for r in tokens.join(asked, "token", "left_semi").groupBy("token").count().collect()}
    return [(min(((counts.get(t, 0), t) for t in rule.tokens), default=(0, ""))[1], rule.name, rule.verdict, rule.regex, rule.rank) for rule in rules]


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`pages` with host, path, rule, verdict and pattern.

    Host: after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; path: from there up to a
    question mark, hash or the end; both are empty where url is null or has no ://. Of the host rules that fit the
    longest one's verdict holds; without one, `pattern` names the longest pattern that fits, and its verdict holds;
    without that the url is allowed. Every row stays; repeated rows and repeated urls are judged alike; an empty table
    gives an empty table; columns of `pages` under the five names are replaced. A url's words fetch the rules that
    stand under them, and only those run. Urls are judged once each; nothing but urls is shuffled.
    """
    rules = HOST_RULES + PATTERN_RULES if rules is None else rules
    spark = pages.sparkSession
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    urls = pages.select(F.col(url).alias("__url")).where("__url is not null").distinct()
    subject = F.concat(_host(F.col("__url")), _rest(F.col("__url")))
    words = urls.select("__url", subject.alias("subject"), F.explode(_tokens(subject)).alias("token"))
    index = spark.createDataFrame(rule_index(words.select("token"), rules), "token string, name string, verdict string, regex string, rank int")
    fits = words.join(F.broadcast(index) if len(rules) <= broadcast_rows else index, "token").where(F.regexp_like("subject", F.col("regex")))
    best = fits.groupBy("__url").agg(F.max(F.struct("rank", "name", "verdict")).alias("__best"))
    # Rows without a url have no rule, and would all meet in one task of the join.
    judged = pages.where(F.col(url).isNotNull()).join(best, F.col(url) == F.col("__url"), "left")
    judged = judged.unionByName(pages.where(F.col(url).isNull()), allowMissingColumns=True)
    host_wins = F.col("__best.rank") >= 1_000_000
    return judged.select(
        *[F.col(c) for c in names],
        _host(F.col(url)).alias("host"),
        _path(F.col(url)).alias("path"),
        F.when(host_wins, F.col("__best.name")).alias("rule"),
        F.coalesce("__best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~host_wins, F.col("__best.name")).alias("pattern"),
    )
