"""URL filters: rules on hosts and paths, and trust that flows along the links between hosts.

Where no rule fits, the host decides: trust is a personalised PageRank from the hosts whose pages are
allowed by rules, along the links; distrust one from the hosts whose pages are blocked, against the links
(who links to blocked hosts is suspect). A host whose distrust exceeds its trust by the threshold is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

#: Fixed by the contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.5


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, links``: absolute links of pages to other hosts. Relative links stay on the host."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]*)"""), F.lit(1))
    links = pages.select(url_host(F.col(url)).alias("src"), F.explode(found).alias("_to"))
    return (
        links.select("src", url_host(F.col("_to")).alias("dst"))
        .filter("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` from ``host, good, bad`` (seed weights) over ``src, dst, links``.

    Each round is a join and a sum over both directions at once. Scores are multiples of a seed's own
    share, so a fully blocked host without links has distrust 1. Rounds end early when nothing moves.
    """
    whole = edges.alias("e").join(hosts.select(F.col("host").alias("dst")), "dst")
    out_total = whole.groupBy("src").agg(F.sum("links").alias("total"))
    in_total = whole.groupBy("dst").agg(F.sum("links").alias("total"))
    forward = whole.join(out_total, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    backward = whole.join(in_total, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("links") / F.col("total")).alias("d"))
    flows = materialize(forward.unionByName(backward).groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    scores = hosts.select("host", "good", "bad", F.col("good").cast("double").alias("trust"), F.col("bad").cast("double").alias("distrust"))
    if flows.isEmpty():
        return scores
    scores = materialize(scores)
    for _ in range(rounds):
        moved = (
            flows.join(scores.select(F.col("host").alias("a"), "trust", "distrust"), "a")
            .groupBy(F.col("b").alias("host"))
            .agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        )
        new = scores.join(moved, "host", "left")
        trust = F.col("good") + damping * F.coalesce(F.col("t"), F.lit(0.0))
        distrust = F.col("bad") + damping * F.coalesce(F.col("d"), F.lit(0.0))
        change = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        scores = materialize(
            new.select("host", "good", "bad", change.alias("change"), trust.alias("trust"), distrust.alias("distrust"))
        )
        if (scores.agg(F.max("change").alias("m")).first()["m"] or 0.0) < 1e-9:
            break
    return scores


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row.

    A host's seed weights are the shares of its pages that rules allow and block. Null urls and urls
    without ``://`` have an empty host and path, fit no rule and are allowed, as are hosts without
    evidence. Null html has no links. Repeated rows are judged alike; no rows give no rows.
    """
    narrow = pages.select(F.col(key).alias("_key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    narrow = materialize(narrow.withColumn("_fit", longest_rule(F.col("host"), F.col("path"), rules)))
    verdict = F.col("_fit.verdict")
    share = [F.count(F.when(verdict == v, 1)) / F.count(F.lit(1)) for v in ("allow", "block")]
    hosts = materialize(narrow.groupBy("host").agg(share[0].alias("good"), share[1].alias("bad")))
    scores = propagate(hosts, materialize(host_edges(pages, url, html)), damping, rounds)
    blocked = scores.filter((F.col("host") != "") & (F.col("distrust") - F.col("trust") > threshold)).select("host", F.lit("block").alias("_host_verdict"))
    return narrow.join(blocked, "host", "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce(verdict, F.col("_host_verdict"), F.lit("allow")).alias("verdict"),
    )
