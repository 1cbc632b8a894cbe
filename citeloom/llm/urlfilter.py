"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with at least one literal token. The index files a rule
under the one of its tokens that the fewest rules have (the longest of equals). A URL is cut into tokens, which
fetch candidate rules; only those run their regular expression. The longest matching rule decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The index travels inside the function, so the number of rules is bounded.
MAX_RULES = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is what is reported; ``pattern`` is matched against host + path; ``literals`` is text that a match contains
    at token borders; rules without a literal are tried for every URL. Longer ``name`` wins; ``ranked`` rules come before the others."""

    name: str
    verdict: str
    pattern: str
    literals: str
    ranked: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """``example.net/en/``: this host and its subdomains, paths that start with the rule's."""
    host, _, path = rule.partition("/")
    path = "/" + path if "/" in rule else ""
    # the last piece of a path prefix may be cut anywhere, so it is a literal only when a slash ends it
    sure = path.rpartition("/")[0]
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{'(?=/|$)' if not path else re.escape(path)}", f"{host} {sure.lower()}")


def word_rule(verdict: str, word: str) -> Rule:
    """A host that has ``word`` between dots or hyphens."""
    return Rule(word, verdict, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", word, ranked=False)


class RuleIndex:
    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the index is bounded to {MAX_RULES}")
        tokens = [set(_TOKEN.findall(r.literals.lower())) for r in rules]
        seen = Counter(t for ts in tokens for t in ts)
        self.by_token: dict[str, list[Rule]] = {}
        for rule, ts in zip(rules, tokens, strict=True):
            rarest = min(ts, key=lambda t: (seen[t], -len(t), t)) if ts else ""
            self.by_token.setdefault(rarest, []).append(rule)
        self.compiled = {r.pattern: re.compile(r.pattern) for r in rules}

    def match(self, host: str, path: str) -> Rule | None:
        text, best = host + path, None
        for token in {"", *_TOKEN.findall(text.lower())}:
            for rule in self.by_token.get(token, ()):
                if (best is None or self._rank(rule) > self._rank(best)) and self.compiled[rule.pattern].search(text):
                    best = rule
        return best

    @staticmethod
    def _rank(rule: Rule) -> tuple:
        return rule.ranked, len(rule.name), rule.name


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the contract has them; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub(r"[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def filter_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` for every row of ``df``; no row is dropped and nothing is shuffled.

    Null, empty and scheme-less URLs have an empty host and path, no rule and the default verdict. Columns of
    ``df`` that have these names are replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    index = RuleIndex(rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for url in urls:
                host, path = split_url(url)
                rule = index.match(host, path) if host or path else None
                rows.append((host, path, rule.name if rule else None, rule.verdict if rule else default))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return df.select(*(F.col(f"`{c}`") for c in kept), judge(F.col(f"`{url}`")).alias("_judged")).select(*(F.col(f"`{c}`") for c in kept), "_judged.*")
