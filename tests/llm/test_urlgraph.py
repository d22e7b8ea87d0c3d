import re
from collections import defaultdict

import pytest

from ledgerloom.llm import urlgraph as U

SCHEMA = "page_id bigint, url string, html string, host string, rule string, trust string, verdict string"


def slow(pages, rounds=300):
    """The method in plain Python, converged."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        return host.translate(low), re.match(r"[^?#]*", rest[len(host) :]).group()

    def rule(host, path):
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    weight, hosts, seeds = defaultdict(float), set(), {"allow": defaultdict(float), "block": defaultdict(float)}
    for _, url, html in pages:
        host, path = split(url)
        if not host:
            continue
        hosts.add(host)
        if r := rule(host, path):
            seeds[r.verdict][host] += 1
        for x in re.findall(r"href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)", html or "", re.I):
            other, _ = split(x if not x.startswith("//") else ":" + x)
            if other:
                hosts.add(other)
                if other != host:
                    weight[host, other] += 1
    for h in hosts:
        parts = h.split(".")
        for i in range(len(parts) - 2):
            a, b = ".".join(parts[i:]), ".".join(parts[i + 1 :])
            for e in ((a, b), (b, a)):
                weight[e] = weight.get(e) or 1.0

    def rank(edges, seed):
        total = sum(seed.values())
        if not total:
            return {}
        start = {h: m / total for h, m in seed.items()}
        out = defaultdict(float)
        for (a, _), w in edges.items():
            out[a] += w
        now = dict(start)
        for _ in range(rounds):
            new = defaultdict(float, {h: (1 - U.DAMPING) * m for h, m in start.items()})
            for (a, b), w in edges.items():
                if a in now:
                    new[b] += U.DAMPING * now[a] * w / out[a]
            now = dict(new)
        return now

    trust, distrust = rank(weight, seeds["allow"]), rank({(b, a): w for (a, b), w in weight.items()}, seeds["block"])
    got = []
    for i, url, _ in pages:
        host, path = split(url)
        r = rule(host, path)
        bad = distrust.get(host, 0)
        own = "block" if bad - trust.get(host, 0) > bad * 1e-9 else "allow"
        got.append((i, host, path, r.text if r else None, r.verdict if r else own))
    return sorted(got, key=repr)


PAGES = [
    (1, "https://www.Example.COM/en/7?x", '<a href="http://bad.example.net/x">'),
    (2, "http://example.com/en/8", None),
    (3, "http://bad.example.net/de/1", '<a href="//www.example.com/">,<a href=http://other.org/es/>'),
    (4, "http://other.org/fr/", '<a href="HTTPS://bad.example.net/?q">'),
    (5, "ftp://a.b.other.org/es/1", "<a href='/local'>"),
    (6, None, '<a href="http://x.org">'),
    (7, "no scheme", None),
    (8, "://", ""),
    (9, "x://y://z/en/", ""),
    (9, "x://y://z/en/", ""),
    (None, "https://lonely.test/", "no links"),
    (10, "https://notexample.com/en/7", '<a href="https://lonely.test/a#b">' * 3),
]


def judged(spark, pages):
    df = spark.createDataFrame([(*p, "?", "?", "?", "?") for p in pages], SCHEMA)
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()), key=repr)


def test_against_the_plain_method(spark):
    assert judged(spark, PAGES) == slow(PAGES)


@pytest.mark.parametrize("pages", [[], PAGES[5:8], PAGES[10:11], PAGES[:2]])
def test_few_or_no_seeds(spark, pages):
    assert judged(spark, pages) == slow(pages)


def test_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert judged(spark, pages) == slow(pages)


def test_a_long_chain_converges(spark):
    """The last of twelve hosts is eleven links from the blocked one, which eight rounds don't reach."""
    hosts = [f"h{i}.test" for i in range(11)] + ["bad.net"]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in zip(hosts, hosts[1:], strict=False)], "src string, dst string, w double")
    against = edges.selectExpr("dst AS src", "src AS dst", "w")
    seeds = spark.createDataFrame([("bad.net", 1)], "host string, mass long")
    got = {r["host"]: r["score"] for r in U.personalised_pagerank(against, seeds, tolerance=0.1).collect()}
    assert got["h0.test"] == pytest.approx(0.15 * 0.85**11)
    assert sum(got.values()) > 0.8


def test_clashing_names_and_long_pages(spark):
    """Columns of the operator's own names are left alone; a page of many links is one row."""
    long = '<a href="http://bad.example.net/x">' * 20_000
    pages = [(20, "http://hub.test/", long), (21, "http://bad.example.net/de/1", "x" * 1_000_000), (22, "http://" + "h" * 5000 + ".test/", None)]
    assert judged(spark, pages) == slow(pages)
    names = "src, dst, w, out, p, mass, score, distrust, path, r, v, n".split(", ")
    df = spark.createDataFrame([(*p, *["?"] * len(names)) for p in PAGES], "page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in names))
    assert sorted((tuple(r) for r in U.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == slow(PAGES)


def test_rules_are_the_contracts(spark):
    """The contract's list in its own words, and pages that each rule fits."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{r.verdict} {r.text}" for r in U.RULES) == contract
    pages = [(1, "http://other.net/de/1", None), (2, "http://www.example.net/de/81", None), (3, "http://example.net/de/7", None), (4, "http://a.com/en/", None), (5, "http://example.com/en/70", None), (6, "http://a.org/es/", None)]
    assert [r[4] for r in judged(spark, pages)] == ["allow", "block", "allow", "block", "allow", "block"]
