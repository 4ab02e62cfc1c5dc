"""URL filter by trust and distrust over the link graph.

Hosts, without user info and port, are nodes; links in the pages' HTML are edges.  Trust starts at trusted seeds and follows
links (personalised PageRank); distrust starts at blocked seeds and follows links backwards, since
who links to bad hosts is suspect.  A host is blocked where distrust outweighs its trust; seeds beyond a
bounded number of links are no evidence.  Rules on host and path come first; the longest that fits
decides.

Null urls, and urls without ``://``, have an empty host and path and the method's verdict for a
host without evidence: allow.  Ties in rule length go to the longer host, then to the smaller text;
equal trust and distrust allow.  Mass at a host without links is not passed on.  Repeated rows are
judged one by one, empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import stored

#: (verdict, host, path) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Parts of a host name that make it a blocked seed.
BLOCKED_PARTS = ("ads", "adult", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "xxx")
#: Propagation ends when at most this share of the seeds' mass is still on its way.
LEAST = 0.01
FOLLOW = 0.85
ANCHOR = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def node_of(host: str | Column) -> Column:
    """The host as a node of the link graph: lower case, without user info and port."""
    return F.translate(F.regexp_replace(host, "^.*@|:[0-9]*$", ""), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): absolute links between different hosts, counted before any shuffle."""
    found = pages.select(node_of(host_of("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("_d"))
    named = found.select("src", node_of("_d").alias("dst"))
    return named.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def suffixes(host: str) -> Column:
    """The host and its parent domains."""
    parts = F.split(F.col(host), "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")


def with_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host) with ``rules``: those that fit the host, longest first, as an array of structs."""
    named = rules.withColumn("_rule", F.concat("rule_host", "rule_path"))
    order = F.struct((-F.length("_rule")).alias("o"), (-F.length("rule_host")).alias("h"), F.col("_rule").alias("rule"), F.col("rule_path").alias("path"), F.col("verdict").alias("verdict"))
    fit = hosts.select("host", F.explode(suffixes("host")).alias("rule_host")).join(named, "rule_host")
    fit = fit.groupBy("host").agg(F.array_sort(F.collect_set(order)).alias("rules"))
    return hosts.join(fit, "host", "left")


def enough_rounds(follow: float = FOLLOW, least: float = LEAST) -> int:
    """Rounds after which at most the share ``least`` of the seeds' mass is still on its way."""
    return ceil(log(least) / log(follow))


def propagated(edges: DataFrame, seeds: DataFrame, follow: float = FOLLOW, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) reached from ``seeds`` (host, trusted, blocked: booleans).

    Both walks run in one table keyed by (host, kind), so a round is one join and one sum.  Rounds end
    when no host is reached anew and no host's mass changes by more than the share ``tolerance`` of
    itself, or after ``rounds`` (``enough_rounds`` by default): what a round moves falls by ``follow``
    each time, so beyond them the masses of all hosts together lack at most the share ``LEAST`` of the
    seeds' mass, whatever the length of the graph's chains.
    """
    starts = seeds.select("host", F.lit(0).alias("kind"), F.col("trusted").alias("_on")).union(seeds.select("host", F.lit(1).alias("kind"), F.col("blocked").alias("_on")))
    start = cut_lineage(starts.filter("_on").select("host", "kind", F.lit(1.0 - follow).alias("mass")).distinct())
    ways = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.lit(0).alias("_kind"), "links").union(
        edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), F.lit(1).alias("_kind"), "links")
    )
    out = ways.groupBy("_from", "_kind").agg(F.sum("links").alias("_all")).withColumnRenamed("_from", "_f").withColumnRenamed("_kind", "_k")
    ways = stored(ways.join(out, (ways._from == out._f) & (ways._kind == out._k)).select("_from", "_to", "_kind", (F.col("links") / F.col("_all")).alias("_share")), "url-ways")
    state = start
    for _ in range(rounds if rounds is not None else enough_rounds(follow)) if ways.limit(1).count() else ():
        moved = state.join(ways, (F.col("host") == F.col("_from")) & (F.col("kind") == F.col("_kind")))
        moved = moved.select(F.col("_to").alias("host"), "kind", (F.col("mass") * F.col("_share") * follow).alias("mass"))
        tagged = start.union(moved).select("host", "kind", "mass", F.lit(0.0).alias("_old")).union(state.select("host", "kind", F.lit(0.0).alias("mass"), F.col("mass").alias("_old")))
        new = cut_lineage(tagged.groupBy("host", "kind").agg(F.sum("mass").alias("mass"), F.sum("_old").alias("_old")))
        change = new.filter("mass > 0").agg(F.max(F.abs(F.col("mass") - F.col("_old")) / F.col("mass"))).first()[0]
        state = new.drop("_old")
        if change is None or change <= tolerance:
            break
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0))
    return state.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked_parts: Sequence[str] = BLOCKED_PARTS, trusted: DataFrame | None = None, blocked: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust.

    Trusted seeds: hosts that an allow rule covers from the path ``/`` on, and ``trusted`` (host).
    Blocked seeds: those a block rule covers so, hosts with a part in ``blocked_parts``, and
    ``blocked`` (host).  A host is blocked where distrust is more than ``threshold`` of both.
    """
    spark = pages.sparkSession
    seen = pages.select(host_of("url").alias("host")).distinct()
    edges = stored(host_edges(pages), "url-edges")
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host")))
    named = seen.union(seen.select(node_of("host").alias("host"))).union(ends).distinct()
    hosts = stored(with_rules(named, rule_table(spark, rules)).withColumn("node", node_of("host")), "url-hosts")
    whole = lambda v: F.coalesce(F.get(F.filter("rules", lambda r: r["path"] == "/"), F.lit(0))["verdict"] == v, F.lit(False))
    parts = F.array(*[F.lit(p) for p in blocked_parts]) if blocked_parts else F.array().cast("array<string>")
    bad = F.arrays_overlap(F.split("host", "[.\\-_]"), parts) | whole("block")
    seeds = hosts.filter("host = node").select("host", (whole("allow") & ~bad).alias("trusted"), bad.alias("blocked"))
    for more, flags in ((trusted, (True, False)), (blocked, (False, True))):
        if more is not None:
            seeds = seeds.union(more.select(node_of("host").alias("host"), F.lit(flags[0]), F.lit(flags[1])))
    mass = propagated(edges, seeds).withColumnRenamed("host", "node")
    known = hosts.join(mass, "node", "left").select(F.col("host").alias("_h"), "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    known = stored(known, "url-judged")
    out = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    out = out.join(known, out.host == known._h, "left")
    hit = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    first = F.get(hit, F.lit(0))
    method = F.when(F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", first["rule"].alias("rule"), F.coalesce(first["verdict"], method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10(pages: DataFrame, **settings) -> DataFrame:
    return judged(pages, **settings).select("page_id", "host", "path", "rule", "verdict")
