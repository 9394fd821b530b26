"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression plus the literal tokens that any URL it fits must hold as whole tokens, which can be told
from the expression.  The tokens of all rules are counted over all URLs; each rule is filed under its rarest one.  A URL's
tokens fetch the few rules filed under them, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.common import unused

_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_ASCII = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Rule:
    """name: as reported; pattern: searched in host + path; tokens: whole tokens that a match needs; rank: the higher wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True


def tokens_of(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every text must hold in which pattern is found: runs of plain letters and digits outside groups
    that stand between literal signs or anchors; no token if the pattern has alternatives outside groups."""
    found, run, closed, depth = [], "", False, 0
    # One element at a time: an escape, a class, a group's start, a sign; with its quantifier.
    for m in re.finditer(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:[aiLmsux-]*:|P?<[^>]*>|[=!]|<[=!]))?|.)([?*+]|\{\d*,?\d*\})?", pattern, re.S):
        one, counted = m[1], m[2]
        if one == "|" and not depth:
            return ()
        plain = one[1] if one[0] == "\\" and not one[1].isalnum() else one
        letter = len(plain) == 1 and plain.isascii() and plain.isalnum()
        if depth or counted or len(plain) > 1 or plain in "()." and plain == one:
            run, closed = "", False  # anything may stand here
        elif letter:
            run = run + plain if run or closed else ""
            closed = False if run else closed
        else:
            if run:
                found.append(run.lower())
            run, closed = "", True
        depth += one.startswith("(") - (one == ")")
    return tuple(dict.fromkeys(found))


def pattern_rule(verdict: str, pattern: str, rank: int = 0) -> Rule:
    """A rule of a regular expression alone, named by it."""
    return Rule(pattern, verdict, pattern, tokens_of(pattern), rank)


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix, such as example.net/en/.  Longer sites win."""
    host, _, path = site.partition("/")
    host = host.translate(_ASCII)
    whole = path[: path.rfind("/") + 1] if "/" in path else ""  # what follows the last slash may go on in the URL
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape('/' + path)})"
    return Rule(site, verdict, pattern, tuple(_TOKEN.findall(f"{host}/{whole}".translate(_ASCII))), len(site))


def word_rule(verdict: str, words: str) -> Rule:
    """A rule for hyphenated words anywhere in host or path; it yields to every site rule and isn't named in results."""
    body = re.escape(words)
    return Rule(words, verdict, rf"(?:^|[./_-])(?i:{body})(?:[./_-]|$)", tuple(_TOKEN.findall(words)), 0, False)


# The rules of the contract, then words of unwanted sites.
SITE_RULES = (site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/"))
WORD_RULES = tuple(word_rule("block", w) for w in ("adult-x", "cheap-pills", "casino", "porn", "xxx", "viagra"))
RULES = SITE_RULES + WORD_RULES


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty where there is no ://"""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_ASCII), slash + path


def token_counts(df: DataFrame, url: str, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each token that the rules name; as many rows as the rules have tokens."""
    names = sorted({t for r in rules for t in r.tokens})
    tokens = F.explode(F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))).alias("token")
    found = df.select(tokens).where(F.col("token").isin(names)).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in found}


def rule_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; "" has the rules without tokens, which run on every URL."""
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(k)
    return index


def filter_urls(df: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null where no listed rule fits) and verdict; columns so named in df are replaced.

    Null, empty or malformed URLs have empty host and path, which no site rule fits, and get the default verdict.
    Repeated rows are judged alike; of rules with equal rank the first wins.  The rules travel with the function: their
    number is a parameter, not data.
    """
    rules = list(rules)
    index = rule_index(rules, token_counts(df, url, rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled: dict[int, re.Pattern] = {}  # those that a task has needed

        def fits(k: int, at: str) -> bool:
            if k not in compiled:
                compiled[k] = re.compile(rules[k].pattern)
            return compiled[k].search(at) is not None

        for urls in batches:
            rows = []
            for u in urls:
                host, path = parts(u)
                at = host + path
                names = {"", *_TOKEN.findall(at.translate(_ASCII))}
                fit = [k for t in names for k in index.get(t, ()) if host and fits(k, at)]
                best = max(fit, key=lambda k: (rules[k].rank, -k), default=None)
                r = None if best is None else rules[best]
                rows.append((host, path, r.name if r and r.listed else None, r.verdict if r else default))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    (found,) = unused(kept, "_judged")
    return df.select(*kept, judge(F.col(url)).alias(found)).select(*kept, f"{found}.*")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
    regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') END AS rest FROM pages),
named AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') = 0 THEN rest ELSE substr(rest, 1, strpos(rest, '/') - 1) END,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND regexp_matches(host || path,
    '(^|[./_-])(?i:adult-x|cheap-pills|casino|porn|xxx|viagra)([./_-]|$)') THEN 'block'
  ELSE 'allow' END AS verdict FROM ruled
"""
