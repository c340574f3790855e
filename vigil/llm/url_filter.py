"""URL filters with rules indexed by their rarest literal token. DataFrame functions only.

A rule is a host (it fits the host and its subdomains) with an optional path prefix, or a pattern over host and path with `*`.
Each rule is filed under the token of it that fewest rules have; the tokens of a URL fetch the rules filed under them, and
only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are literals of the plan; more are joined by token.
INLINE = 64
#: Rules up to this number (a bounded side) are broadcast; more are joined by shuffle.
BROADCAST = 200_000


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. base: by host suffix and path prefix, else a pattern with `*` over host + path."""

    verdict: str
    text: str
    base: bool = True

    def regex(self) -> str:
        """A Java regular expression over host + path."""
        quote = lambda s: re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)
        if self.base:
            return r"(?s)^(?:[^/]*\.)?" + quote(self.text)
        return "(?s)^" + ".*".join(quote(x) for x in self.text.split("*"))

    def tokens(self) -> list[str]:
        """Runs of letters and digits that must stand whole in any URL that the rule fits."""
        if self.base:
            runs = [(m[0].lower(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", self.text)]
            return [t for t, end in runs if end < len(self.text)]  # the last may go on in the URL
        parts = self.text.split("*")
        return [m[0].lower() for p in parts for m in re.finditer(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", p)]


def index(rules: list[Rule]) -> list[tuple[str, Rule]]:
    """Each rule with its rarest token; a rule without one is filed under the empty token, which every URL has."""
    counts = Counter(t for r in rules for t in set(r.tokens()))
    return [(min(r.tokens(), key=lambda t: (counts[t], -len(t), t), default=""), r) for r in rules]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to `/`, `?`, `#`, with A-Z lower-cased. Path: up to `?` or `#`. Empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER), "[^a-z0-9]+"))


def _better(candidates: Column) -> Column:
    """The base rule that fits with the longest text; else the method's."""
    return F.array_max(F.transform(candidates, lambda c: F.struct(c["base"].alias("base"), F.length(c["text"]).alias("n"), (c["verdict"] == "block").alias("b"), c["text"].alias("text"))))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (the base rule or null), verdict, pattern (the method's own rule or null).

    Base rules go before patterns, longer before shorter, block before allow where they tie. Null urls and urls without `://`
    have empty host and path and the default verdict. Rows that repeat repeat.
    """
    host, path = host_and_path(F.col("url"))
    filed = index(list(dict.fromkeys(rules)))
    fits = lambda c: F.rlike(F.concat(F.col("host"), F.col("path")), c["regex"])
    if len(filed) <= INLINE:
        by: dict[str, list[Rule]] = {}
        for t, r in filed:
            by.setdefault(t, []).append(r)
        lit = lambda r: F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("text"), F.lit(r.base).alias("base"), F.lit(r.regex()).alias("regex"))
        none = F.array().cast("array<struct<verdict:string,text:string,base:boolean,regex:string>>")
        found = none
        for t, rs in by.items():  # a token of the URL fetches the rules filed under it
            found = F.concat(found, F.when(F.array_contains("__tokens", t) if t else F.lit(True), F.array(*map(lit, rs))).otherwise(none))
        urls = pages.select("page_id", host.alias("host"), path.alias("path"))
        hits = urls.withColumn("__tokens", _tokens(F.col("host"), F.col("path"))).withColumn("__hit", _better(F.filter(found, fits))).drop("__tokens")
    else:
        table = spark.createDataFrame([(t, r.verdict, r.text, r.base, r.regex()) for t, r in filed], "token string, verdict string, text string, base boolean, regex string")
        if len(filed) <= BROADCAST:
            table = F.broadcast(table)
        # verdicts of distinct urls: a url that many pages have is judged once
        urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        distinct = urls.select("host", "path").distinct().withColumn("token", F.explode(F.array_union(_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
        best = distinct.join(table, "token").where(fits(table)).groupBy("host", "path").agg(
            F.max(F.struct("base", F.length("text").alias("n"), (F.col("verdict") == "block").alias("b"), "text")).alias("__hit")
        )
        hits = urls.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("__hit.b"), "block").when(F.col("__hit").isNotNull(), "allow").otherwise(default)
    usable = (F.col("host") != "") | (F.col("path") != "")
    return hits.select("page_id", "host", "path", F.when(F.col("__hit.base"), F.col("__hit.text")).alias("rule"), F.when(usable, verdict).otherwise(default).alias("verdict"), F.when(~F.col("__hit.base"), F.col("__hit.text")).alias("pattern"))
