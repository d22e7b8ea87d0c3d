"""URL filter by link-graph propagation, in DataFrame expressions only.

Rules judge the URLs they fit. For all others, trust and distrust spread over the graph of hosts: a personalised
PageRank from hosts with allowed pages along the links, and one from hosts with blocked pages against them (who links
to a bad host is suspect). A host is blocked where its distrust exceeds its trust. Edges are absolute links between
hosts, counted before the shuffle, and site edges between a host and its parent domain in both directions, so that
hosts whose pages link only within themselves are reached too. Mass that gets to a host without edges leaves the graph.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, ascii_lower, cut

DAMPING, ROUNDS, CUT_EACH = 0.85, 8, 4
#: Edges in a partition, where the graph is small enough that a ranking is broadcast to its edges.
PART_EDGES = 200_000
#: Rankings converge until what further rounds can change is below this share of all mass; trust and distrust that
#: differ by less than this share of the larger are alike.
TOLERANCE, ALIKE = 1e-3, 1e-9
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """Host of a URL; null or without `://`: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (text, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(links: DataFrame) -> DataFrame:
    """Edges (src, dst, w) of links(src, dst), which may have a null dst: links counted, and site edges of weight 1."""
    found = links.where("dst is not null and dst <> '' and src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    labels = F.split("host", "\\.")
    chain = hosts.select(F.explode(F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".").alias("a"), F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".").alias("b"))))).alias("e"))
    site = chain.select("e.a", "e.b").distinct()
    both = site.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(site.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("w", F.lit(1.0))
    return found.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def rounds_for(tolerance: float, damping: float = DAMPING) -> int:
    """Rounds after which further ones change less than the tolerance: damping ** k of the mass is still on its way after k."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(host, score) over edges(src, dst, w) from seeds(host, mass), whose mass is scaled to 1.

    Without a tolerance, after a fixed number of rounds; with one, when what further rounds can change is below it in
    all. by: columns of edges and seeds whose values have rankings of their own, which then go on together. Seeds without
    mass have no score but 0.
    """
    by, at = list(by), [*by, "host"]
    totals = seeds.groupBy(*by).agg(F.sum("mass").alias("_all"))
    scaled = seeds.join(F.broadcast(totals), by) if by else seeds.crossJoin(F.broadcast(totals))  # a row for each ranking
    mass = F.when(F.col("_all") > 0, F.col("mass") / F.col("_all").cast("double")).otherwise(0.0)
    start = cut(scaled.select(*at, mass.alias("score")))
    out = edges.groupBy(*by, "src").agg(F.sum("w").alias("out"))
    share = cut(edges.join(out, [*by, "src"]).select(*by, F.col("src").alias("host"), "dst", (F.col("w") / F.col("out")).alias("p")))
    # A ranking has a row for each host at most: counted, and broadcast to the edges if they are few, else joined by shuffle.
    hosts = share.select(*by, F.col("dst").alias("host")).unionByName(start.select(*at)).distinct().count()
    few = hosts <= BROADCAST_ROWS
    parts = max(1, -(-share.count() // PART_EDGES))
    packed = (lambda df: df.coalesce(parts)) if few else lambda df: df
    share, start = packed(share), packed(start)
    rank = start
    for k in range(rounds if tolerance is None else rounds_for(tolerance, damping)):
        flow = share.join(F.broadcast(rank) if few else rank, at).select(*by, F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        rank = flow.unionByName(start.select(*at, (F.col("score") * (1 - damping)).alias("score"))).groupBy(*at).agg(F.sum("score").alias("score"))
        if (k + 1) % CUT_EACH == 0:
            rank = cut(packed(rank))
    return rank


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html", damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, trust, distrust, verdict.

    The rankings converge to the tolerance; without one they end after `rounds`. Trust and distrust are alike if they
    differ by less than ALIKE of the distrust, so a verdict doesn't depend on how many hosts share the mass.

    A URL that is null or has no `://` has empty host and path, fits no rule and is allowed, as is a host that neither
    trust nor distrust reaches, or both alike. Repeated rows count repeatedly. An empty table gives no
    rows.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1))
    targets = F.transform(hrefs, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit(":"), x)).otherwise(x)))
    links = rows.where("host <> ''").select(F.col("host").alias("src"), F.explode_outer(targets).alias("dst"))
    # Counted by pair of hosts at once: whatever comes after grows with the pairs, not with the pages.
    pairs = cut(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    counted = host_edges(pairs.select("src", "dst")).drop("w")
    weights = pairs.where("dst is not null and dst <> '' and src <> dst").select("src", "dst", F.col("n").cast("double").alias("w"))
    edges = cut(counted.join(weights, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(1.0)).alias("w")))
    seeds = cut(rows.where("host <> '' and r is not null").groupBy("host", F.col("r.verdict").alias("v")).agg(F.count(F.lit(1)).alias("mass")))
    against = edges.select(F.lit("block").alias("v"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = edges.select(F.lit("allow").alias("v"), "src", "dst", "w").unionByName(against)
    marks = personalised_pagerank(both, seeds, damping, rounds, tolerance, ("v",))
    score = lambda v: F.sum(F.when(F.col("v") == v, F.col("score")).otherwise(0.0))
    hosts = cut(marks.groupBy("host").agg(score("allow").alias("trust"), score("block").alias("distrust")))
    out = rows.drop("html").join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    worse = F.col("distrust") - F.col("trust") > F.col("distrust") * ALIKE
    own = F.when(worse, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.text").alias("rule"), "trust", "distrust", F.coalesce(F.col("r.verdict"), own).alias("verdict"))
