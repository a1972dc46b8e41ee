"""URL filter: rules first, then trust and distrust propagated over the host graph.

The graph's edges are the links in page markup between different hosts and, in both directions, between a host and its
nearest parent host that is also known. Every link target is a host of the graph: one without pages counts as one page, and rules for
whole hosts make it a seed. Trust is personalised PageRank from the hosts of pages that a rule allows; distrust
is personalised PageRank over the reversed edges from the hosts that a rule blocks (who links to bad hosts is suspect).
Scores are put on the scale of pages: a host's distrust times all blocked pages over its own pages is the share of its pages
that distrust accounts for. A page that no rule decides is blocked if that share exceeds THRESHOLD and the host's trust share.

Everything runs in Spark: links are pre-aggregated by host pair, scores are joined on hosts, lineage is cut by staged tables. A host's
rows are never gathered; the last join's page side is split by Spark where a host is hot.

Defined cases: a url that is null or lacks ``://`` has an empty host and path and no rule, and is allowed; without seeds scores are
zero and all unruled pages are allowed; repeated rows are each judged; links in null markup do not exist; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import staged, unstage

#: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rounds end when those between two written tables moved less than this share of a kind's mass.
TOLERANCE = 1e-3
#: Rounds between two written score tables.
ROUNDS_KEPT = 4
DAMPING = 0.85
THRESHOLD = 0.5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1)


def _matching(host: Column, path: Column, rule: tuple) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def _decided(host: Column, path: Column, rules: tuple, value) -> Column:
    """``value`` of the longest rule that fits, null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        out = F.when(_matching(host, path, rule), F.lit(value(rule))).otherwise(out)
    return out


def located(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = F.col("host") != ""
    by = lambda value: F.when(known, _decided(F.col("host"), F.col("path"), rules, value))
    return rows.select("*", by(lambda r: r[0] + r[1]).alias("rule"), by(lambda r: r[2]).alias("ruled"))


def links_of(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, whether or not the target has pages."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(found).alias("to"))
    target = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    named = linked.select("src", target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return named.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def edges_of(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): the links, and both ways between a host and its nearest parent among ``hosts``."""
    # Every proper suffix of a host; the longest that is a host itself is its parent.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = hosts.where(F.size(labels) > 1).select("host", F.posexplode(suffixes).alias("depth", "parent"))
    known = above.join(hosts.select(F.col("host").alias("parent")), "parent")
    family = known.groupBy("host").agg(F.min_by("parent", "depth").alias("parent"))
    both = family.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(family.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    return links.unionByName(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): PageRank along (kind, src, dst, weight), restarted at (kind, host, seed), a graph of its own for each kind.

    A kind's seeds sum to 1. Mass at hosts without outgoing edges returns to the seeds. That is the same, up to one factor, as
    letting it go, so it is let go and a kind's scores are divided by their sum at the end: no round needs a total of its own.
    All kinds go through one join and one partial aggregate a round; the table is written every ROUNDS_KEPT rounds and compared with the one before, until it
    has settled. Every round shrinks what is unsettled by ``damping`` at least, so the rounds are bounded by the tolerance alone, on any graph.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    share = (F.col("weight") / F.col("total") * damping).alias("share")
    steps = staged(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", share), "steps")
    restart = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    written, off = staged(seeds.select("kind", "host", F.col("seed").alias("score")), "scores"), 1.0
    while off > tolerance:
        score = written
        for _ in range(ROUNDS_KEPT):
            moved = steps.join(score, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score"))
            score = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = staged(score, "scores")
        both = score.unionByName(written.select("kind", "host", (-F.col("score")).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("moved"))
        by_kind = both.groupBy("kind").agg(F.sum(F.abs("moved")).alias("moved"))
        off = by_kind.agg(F.max("moved")).first()[0] or 0.0
        unstage(written)
        written = score
    score = written
    total = score.groupBy("kind").agg(F.sum("score").alias("total"))
    return score.join(total, "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))


def judged(pages: DataFrame, rules: tuple = RULES, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's trust and distrust."""
    rows = located(pages, rules)
    by = lambda verdict: F.count_if(F.col("ruled") == verdict).alias(verdict)
    links = staged(links_of(pages), "links")
    crawled = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), by("allow"), by("block"))
    # A linked host without pages counts as one page, which only rules for whole hosts decide.
    far = links.select(F.col("dst").alias("host")).distinct().join(crawled, "host", "left_anti")
    whole = tuple(r for r in rules if r[1] == "/")
    far = far.withColumn("ruled", _decided(F.col("host"), F.lit("/"), whole, lambda r: r[2]))
    is_ = lambda verdict: F.coalesce(F.col("ruled") == verdict, F.lit(False)).cast("bigint").alias(verdict)
    far = far.select("host", F.lit(1).cast("bigint").alias("pages"), is_("allow"), is_("block"))
    hosts = staged(crawled.unionByName(far), "hosts")
    edges = staged(edges_of(links, hosts.select("host")), "edges")
    allowed, blocked = hosts.agg(F.sum("allow"), F.sum("block")).first()
    seed = lambda verdict, n: hosts.where(f"`{verdict}` > 0").select(F.lit(verdict).alias("kind"), "host", (F.col(verdict) / (n or 1)).alias("seed"))
    ahead = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight")
    back = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    found = personalised(ahead.unionByName(back), seed("allow", allowed).unionByName(seed("block", blocked)), tolerance)
    of = lambda verdict, n: F.coalesce(F.max(F.when(F.col("kind") == verdict, F.col("score"))), F.lit(0.0)) * float(n or 0)
    shares = found.groupBy("host").agg(of("allow", allowed).alias("trust"), of("block", blocked).alias("distrust"))
    part = lambda c: (F.coalesce(c, F.lit(0.0)) / F.col("pages")).alias(c)
    scored = hosts.join(shares, "host", "left").select("host", part("trust"), part("distrust"))
    bad = staged(scored.withColumn("bad", (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))), "judged")
    method = F.when(F.coalesce("bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
