"""URL filters: listed rules, and propagation of trust and distrust over the graph of hosts.

A rule names a host and a path; it fits the host and its subdomains where the url's path starts with the
rule's path, and the longest rule that fits decides. Other urls are decided per host. Nodes are hosts;
an edge goes from a page's host to each host it links to (weight: number of links), and both ways between a
host and its parent domain. Trust is personalised PageRank from hosts in proportion to their allowed pages,
distrust the same over reversed edges from blocked pages (a host that links to bad ones is suspect). Both
are in units of pages; a host is blocked if distrust exceeds trust by ``(1 - DAMPING) / 2`` per page of the
host, as if half of its own pages were blocked.

Scale: edges are counted per pair of hosts before anything is joined; the ranks are a few joins and sums
over (host, kind), and Spark splits the join of a hub host as its other side has one row per host.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed; html null
means no links; an empty table gives no rows; repeated pages count as often as they occur; a host whose trust and distrust
are equal is allowed, as are hosts that nothing reaches; very long urls and pages are read whole; other columns are not read, and those
named like results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtrial.llm.common import written

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING, ROUNDS, ROUNDS_A_JOB = 0.7, 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text of the longest rule that fits and its verdict, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between hosts, and steps between a host and its parent domain."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.regexp_replace(F.translate("dst", _UPPER, _LOWER), "^.*@", "").alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    hosts = pages.select("host").distinct()
    parts = F.split("host", "\\.")
    level = lambda i: F.array_join(F.slice(F.col("_parts"), i, F.size("_parts")), ".")
    up = hosts.withColumn("_parts", parts).where(F.size("_parts") > 2).select(F.col("_parts"), F.explode(F.sequence(F.lit(1), F.size("_parts") - 2)).alias("i"))
    up = up.select(level(F.col("i")).alias("src"), level(F.col("i") + 1).alias("dst")).distinct()
    both = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1).cast("long"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, kind ('trust' or 'distrust'), mass, from ``seeds`` of the same columns; distrust runs against the edges."""
    def arcs(kind: str, start: str, end: str) -> DataFrame:
        total = edges.groupBy(start).agg(F.sum("weight").alias("total"))
        return edges.join(total, start).select(F.lit(kind).alias("kind"), F.col(start).alias("start"), F.col(end).alias("end"), (F.col("weight") / F.col("total")).alias("share"))

    steps = written(arcs("trust", "src", "dst").union(arcs("distrust", "dst", "src")))
    source = written(seeds.select("host", "kind", (F.col("mass") * (1 - damping)).alias("mass")))
    state = source
    for i in range(rounds):
        moved = state.join(steps.withColumnRenamed("start", "host"), ["host", "kind"]).select(F.col("end").alias("host"), "kind", (F.col("mass") * F.col("share") * damping).alias("mass"))
        state = moved.union(source).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        if (i + 1) % ROUNDS_A_JOB == 0 and i + 1 < rounds:
            state = written(state)
    return state


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, with the host's trust and distrust."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, listed = matched(F.col("host"), F.col("path"), rules)
    told = read.select("page_id", "host", "path", rule.alias("rule"), listed.alias("listed"))
    counts = told.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("listed") == "allow").alias("trust"), F.count_if(F.col("listed") == "block").alias("distrust"))
    counts = written(counts)
    seeds = reduce(DataFrame.union, [counts.where(f"{k} > 0").select("host", F.lit(k).alias("kind"), F.col(k).cast("double").alias("mass")) for k in ("trust", "distrust")])
    ranks = propagated(host_edges(read), seeds).groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    verdicts = counts.select("host", "pages").join(ranks, "host", "left").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        F.when((F.col("host") != "") & (F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) >= F.col("pages") * (1 - DAMPING) / 2), F.lit("block")).otherwise(F.lit("allow")).alias("by_host"),
    )
    return told.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", "by_host").alias("verdict"), "trust", "distrust")
