"""URL verdicts by rules and by trust that flows along links between hosts.

Rules name a host and a path; the longest that fits a page decides. For pages
without a rule the link graph does: a personalised PageRank from trusted hosts
along links, and one from blocked hosts against them (who links to blocked
hosts is distrusted). A host is blocked if its distrust passes a threshold and
its trust. Seeds are given, or taken from the rules: hosts all of whose pages
the rules allow are trusted, hosts all of whose pages they block are blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texweave.llm.common import cut
from texweave.llm.html_template import BROADCAST_ROWS


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


#: The production rules, fixed values of the contract.
RULES = (
    Rule("block", "com", "en/"),
    Rule("allow", "example.com", "en/7"),
    Rule("allow", "net", "de/"),
    Rule("block", "example.net", "de/8"),
    Rule("block", "org", "es/"),
)
DAMPING = 0.85
TOLERANCE = 1e-4
#: Share of all distrust, times the number of hosts that have a score, from which a host is blocked.
THRESHOLD = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path (from its slash) of a url; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equal ones the first given); null if none does."""
    text = verdict = F.lit(None).cast("string")
    longest_last = sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path))
    for rule in longest_last:
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(f"/{rule.path}"))
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, share``: links between different hosts, each host's links sharing one vote by their pages."""
    here, _ = parts(F.col("url"))
    hrefs = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]*)"), F.lit(1))
    links = pages.select(here.alias("src"), F.explode(F.array_distinct(hrefs)).alias("href"))
    there = F.translate(F.regexp_extract("href", r"//([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = links.select("src", there.alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counted


def rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, score``: personalised PageRank over ``src, dst, n`` from ``seeds`` (``host, weight``).

    Scores sum to 1: what hosts without links would pass on returns to the
    seeds, which scaling at the end does as well. Hosts that no seed reaches
    are not in the result. Every round is cut, and rounds go on until all scores
    together change by no more than ``tolerance``: a round's change is at most
    ``damping`` of the one before, which bounds their number (57 as given).
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.sparkSession.createDataFrame([], "host string, score double")
    home = cut(seeds.groupBy("host").agg((F.sum("weight") / total * (1 - damping)).alias("home")))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    votes = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all") * damping).alias("share")))
    scores = home.select("host", F.col("home").alias("score"))
    for _ in range(1 + math.ceil(math.log(tolerance / 2) / math.log(damping)) if damping else 1):
        passed = scores.join(votes, scores["host"] == votes["src"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("passed"))
        now = passed.join(home, "host", "full").select("host", (F.coalesce("passed", F.lit(0.0)) + F.coalesce("home", F.lit(0.0))).alias("score"))
        both = cut(now.join(scores.withColumnRenamed("score", "was"), "host", "left").select("host", "score", F.coalesce("was", F.lit(0.0)).alias("was")))
        scores = both.select("host", "score")
        if both.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] <= tolerance:
            break
    else:
        raise ArithmeticError("scores did not settle")
    return scores.select("host", (F.col("score") / scores.agg(F.sum("score")).first()[0]).alias("score"))


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, trusted: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """``host, trust, distrust`` of every host that has either; seeds are ``host, weight`` tables."""
    here, path = parts(F.col("url"))
    _, verdict = ruled(here, path, rules)
    seen = cut(pages.select(here.alias("host"), verdict.alias("verdict")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    trusted = trusted if trusted is not None else seen.filter("host <> '' and allowed = n").select("host", F.lit(1.0).alias("weight"))
    blocked = blocked if blocked is not None else seen.filter("host <> '' and blocked = n").select("host", F.lit(1.0).alias("weight"))
    edges = cut(host_edges(pages))
    trust = rank(edges, trusted).withColumnRenamed("score", "trust")
    against = rank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), blocked).withColumnRenamed("score", "distrust")
    return trust.join(against, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, trusted: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, which no
    rule fits and no link reaches: they are allowed. Repeated rows are judged
    each; other columns are ignored; an empty table gives an empty result.
    """
    scores = cut(host_scores(pages, rules, trusted, blocked))
    n = scores.count()
    bad = cut(scores.filter((F.col("distrust") * n >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad")))
    here, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), here.alias("host"), path.alias("path"))
    text, verdict = ruled(F.col("host"), F.col("path"), rules)
    few = bad.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(bad) if few else bad, "host", "left")
    return joined.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
