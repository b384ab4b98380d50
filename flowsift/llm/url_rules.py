"""URL filters: pattern rules behind an index on their rarest literal token.

Each rule has literal tokens that every url it matches must hold whole. The index files the rule under the one
that is rarest in the urls at hand; a url's own tokens fetch the candidate rules, and only those run their
regular expressions. Rules without such a token run on every url.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``place`` rules (host and path) name themselves in the result, and the longest wins; patterns decide the rest."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    place: bool = False


def place_rule(text: str, verdict: str) -> Rule:
    """A host (with its subdomains) and the start of a path: ``example.org/en/``."""
    host, slash, path = text.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    # In the path the last token may go on, so only closed tokens count.
    closed = path.lower()[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])] if path else ""
    tokens = _TOKEN.findall(host) + _TOKEN.findall(closed)
    return Rule(host + slash + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host + slash + path)}", tuple(tokens), True)


def pattern_rule(text: str) -> Rule:
    """A filter line: ``*`` stands for anything, ``^`` for a separator or the end, ``||`` for the start of a host
    label, ``|`` at either end for the url's own; ``@@`` in front makes an exception. Case does not count."""
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    body = body.lower()
    head, tail = "", ""
    if body.startswith("||"):
        head, body = r"\A[a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = r"\A", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    regex = head + "".join({"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(c, re.escape(c)) for c in body) + tail
    tokens = []
    for m in _TOKEN.finditer(body):
        opened = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and head
        ended = m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and tail
        if opened and ended:
            tokens.append(m[0])
    return Rule(text, verdict, regex, tuple(tokens))


#: Spam, advertising and tracking hosts and paths; a url that none of these matches is allowed.
PATTERNS = tuple(map(pattern_rule, (
    "||spam-farm.*^", "||*-farm.example.", "||cheap-pills.*^", "||*pills.*/buy^", "||ads-track.*^", "||ads.*^", "||adserver.*^",
    "||casino^", "-casino.", ".casino.", "/ads/banner^", "/adclick^", "/doubleclick^", "/popunder.", "?affiliate=", "&affiliate=",
    "/viagra^", "/porn^", ".xxx^", "||free-money.*^", "@@/en/1/", "@@||ads-track.*/privacy^")))


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): what lies behind the first ``://``, up to ``/ ? #`` and then up to ``? #``."""
    if url is None:
        return "", ""
    _, sign, rest = url.partition("://")
    if not sign:
        return "", ""
    end = re.search(r"[?#]", rest)
    rest = rest[: end.start()] if end else rest
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


class Index:
    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.rules = [(r, re.compile(r.regex.replace(r"\z", r"\Z"))) for r in rules]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, list[str]]:
        """(host, path, place rule, verdict, matching patterns)."""
        host, path = split_url(url)
        place, patterns = None, []
        if url is not None:
            lowered = lower_ascii(url)
            candidates = set(self.always)
            for token in set(_TOKEN.findall(lowered)):
                candidates.update(self.by_token.get(token, ()))
            for i in sorted(candidates):
                rule, regex = self.rules[i]
                if rule.place:
                    if host and regex.match(host + path) and (place is None or len(rule.text) > len(place.text)):
                        place = rule
                elif regex.search(lowered):
                    patterns.append(rule)
        if place:
            verdict = place.verdict
        else:
            verdict = "block" if patterns and all(r.verdict == "block" for r in patterns) else "allow"
        return host, path, place.text if place else None, verdict, [r.text for r in patterns]


def token_frequency(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens occurs: at most as many rows as the rules have tokens."""
    found = F.explode(F.array_intersect(F.split(F.lower(F.col(url)), "[^a-z0-9]+"), F.array(*map(F.lit, tokens))))
    return {r["token"]: r["n"] for r in pages.select(found.alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, patterns) per row.

    ``rule`` is the longest fitting place rule or null; its verdict stands. Otherwise a url is blocked if a block
    pattern matches and no exception does. A missing url, or one without ``://``, has an empty host and path; the
    missing one is allowed. Repeated rows and missing keys give rows like any other; other columns are ignored; an
    empty table gives an empty table. No rows are shuffled.
    """
    tokens = sorted({t for r in rules for t in r.tokens})
    index = Index(rules, token_frequency(pages, url, tokens) if tokens else {})
    shared = pages.sparkSession.sparkContext.broadcast(index)  # as large as the rules
    kind = pages.schema[key].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(shared.value.judge, batch.column("url").to_pylist()))) or [[]] * 5
            yield pa.record_batch([batch.column("key"), *(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.string()))],
                                  ["key", "host", "path", "rule", "verdict", "patterns"])

    out = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).mapInArrow(
        judged, f"key {kind}, host string, path string, rule string, verdict string, patterns array<string>")
    return out.withColumnRenamed("key", key)
