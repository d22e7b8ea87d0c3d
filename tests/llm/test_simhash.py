import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash as S
from ledgerloom.llm.components import components


def slow_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values, radius):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints_against_the_plain_definition(docs, odd):
    for text in [r["text"] for r in docs.limit(40).collect()] + [r["text"] for r in odd.collect() if len(r["text"] or "") < 100_000]:
        assert S.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    h = spark.range(1).select(F.xxhash64(F.lit("a b cé")).alias("h")).first()["h"]
    assert h & (2**64 - 1) == xxhash.xxh64_intdigest("a b cé".encode(), 42)


@pytest.mark.parametrize("tile", [3, 16, 4096])
@pytest.mark.parametrize("lanes", [1, 4, 8])
def test_links_keep_all_components(spark, tile, lanes):
    rng = random.Random(tile + lanes)
    base = [rng.getrandbits(64) for _ in range(25)]
    values = set(base)
    for b in base[:15]:
        for _ in range(6):
            v = b
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values | {0, 1, 3, 2**64 - 1})
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = S.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), lanes=lanes, tile=tile)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = roots(values, 2)
    assert all(((x ^ y) & (2**64 - 1)).bit_count() <= 2 for x, y in links.collect())
    same = lambda ids: {tuple(sorted(i for i, r in enumerate(ids) if r == k)) for k in set(ids)}
    assert same([found.get(s, s) for s in signed]) == same(want)


def test_forest_spans():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    keep = S._forest(a, b, 40)
    assert len(keep) <= 39

    def parts(x, y):
        label = list(range(40))
        for i, j in zip(x, y, strict=True):
            p, q = label[i], label[j]
            label = [min(p, q) if v in (p, q) else v for v in label]
        return label

    assert parts(a, b) == parts(a[keep], b[keep])


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*chain, *star, (5, 5), (1, 0), (0, 1)], "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(1000, 1100)} | {0: 0, 1: 0}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_against_brute_force(spark, sf, docs):
    from ledgerloom.llm.queries import op7_simhash

    rows = sorted((r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect())
    root = roots([f for _, f in rows], 2)
    want = [(d, format(f, "016x"), rows[k][0]) for (d, f), k in zip(rows, root, strict=True)]
    assert sorted(map(tuple, op7_simhash(spark, sf).collect())) == want


def test_odd_rows(odd, none):
    out = S.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    empty = {r["component_id"] for r in out if r["fp"] == 0}
    assert empty == {3}
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["keep_rid"] for r in out})
    assert S.near_duplicates(none).count() == 0 and S.drop_near_duplicates(none).count() == 0
