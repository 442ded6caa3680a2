"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only, no shuffle.

A rule is either host and path (`example.org/es/`: that host and its subdomains, paths that start so) or a wildcard
pattern over host and path (`*` for anything, `||` in front for the start of a host label, `|` behind for the end).
Each rule is filed under one token that every URL it fits must hold, the one that fewest rules hold; rules without such
a token are filed under the empty token, which every URL is asked for. The index is an array of buckets by the token's
hash, a constant of the plan; its size is bounded by MAX_RULES. A URL's tokens fetch candidates, and only their regular
expressions run.

Null URLs and URLs without `://` have an empty host and path and fit no rule. Every row is kept; rows repeat as they do
in the input. Of several fitting host rules the longest wins, then the alphabetically first."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "array<array<struct<token:string,rule:string,verdict:string,pattern:string,exact:boolean>>>"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str  # allow | block
    wildcard: bool = False  # else host and path

    def pattern(self) -> str:
        """A Java regular expression over host, newline, path; `(?s)` so that paths may hold anything."""
        if not self.wildcard:
            host, slash, path = self.text.partition("/")
            return rf"(?s)^(?:[^\n]*\.)?{_quoted(host)}\n{_quoted(slash + path)}.*"
        body, start, end = self.text, "(?s)^.*", ".*$"
        if body.startswith("||"):
            body, start = body[2:], r"(?s)^(?:[^\n]*\.)?"
        if body.endswith("|"):
            body, end = body[:-1], "$"
        parts = [r"\n?/".join(_quoted(x) for x in p.split("/")) for p in body.split("*")]
        return start + ".*".join(parts) + end

    def tokens(self) -> list[str]:
        """The runs of letters and digits that any URL which the rule fits holds whole."""
        if not self.wildcard:
            host, slash, path = self.text.partition("/")
            inner = re.match(r"(.*)[^0-9A-Za-z]", slash + path, re.S)
            return re.findall("[0-9A-Za-z]+", host) + (re.findall("[0-9A-Za-z]+", inner[1]) if inner else [])
        body = self.text
        start, end = body.startswith("||"), body.endswith("|")
        body = body.removeprefix("||").removesuffix("|")
        found = []
        for m in re.finditer("[0-9A-Za-z]+", body):
            left = body[m.start() - 1] != "*" if m.start() else start
            right = body[m.end()] != "*" if m.end() < len(body) else end
            if left and right:
                found.append(m[0])
        return found


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)


def index(rules: Sequence[Rule]) -> list[list[dict]]:
    """Buckets of rules by the hash of their rarest token: fewest rules hold it, then the longest, then alphabetical."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the plan's constant holds {MAX_RULES} at most")
    held = Counter(t for r in rules for t in {*r.tokens()})
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(rules)))]
    for r in rules:
        token = min({*r.tokens()}, key=lambda t: (held[t], -len(t), t), default="")
        entry = {"token": token, "rule": r.text, "verdict": r.verdict, "pattern": r.pattern(), "exact": not r.wildcard}
        buckets[_crc(token) % len(buckets)].append(entry)
    return buckets


def _crc(token: str) -> int:
    import zlib

    return zlib.crc32(token.encode())


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (text of the longest host rule that fits, or null) and verdict.

    The verdict is that rule's; without one, block if a wildcard rule that blocks fits and none that allows, else the default."""
    buckets = index(rules)
    given = F.col(url)
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    has = given.contains("://")
    host = F.when(has, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    out = df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    table, canonical = F.from_json(F.lit(json.dumps(buckets)), ENTRY), F.concat("host", F.lit("\n"), "path")
    words = F.array_distinct(F.concat(F.split(canonical, "[^0-9A-Za-z]+"), F.array(F.lit(""))))
    fetched = F.flatten(F.transform(words, lambda t: F.filter(F.get(table, (F.crc32(t) % len(buckets)).cast("int")), lambda r: r["token"] == t)))
    fits = F.filter(fetched, lambda r: (F.length("host") > 0) & F.regexp_like(canonical, r["pattern"]))
    out = out.withColumn("__fits", fits)
    hosts = F.filter("__fits", lambda r: r["exact"])
    ranked = F.array_sort(F.transform(hosts, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    best = F.get(ranked, F.lit(0))
    by_pattern = F.transform(F.filter("__fits", lambda r: ~r["exact"]), lambda r: r["verdict"])
    fallback = F.when(F.array_contains(by_pattern, "allow"), "allow").when(F.array_contains(by_pattern, "block"), "block").otherwise(default)
    return out.withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], fallback)}).drop("__fits")
