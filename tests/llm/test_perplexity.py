import math
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import perplexity as P


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition, over bytes."""
    pad = b"\n" * (order - 1)
    digits = bytes.maketrans(b"123456789", b"000000000")
    counts = {order: Counter()}
    for t in texts:
        d = pad + t.encode().translate(digits)
        counts[order].update(d[i : i + order] for i in range(len(d) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, sums, fans = {}, {}, {}
    for k, c in counts.items():
        off[k] = P.discounts(*[sum(v == n for v in c.values()) for n in (1, 2, 3, 4)])
        sums[k], fans[k] = Counter(), defaultdict(Counter)
        for g, n in c.items():
            sums[k][g[:-1]] += n
            fans[k][g[:-1]][min(n, 3)] += 1

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 256
        if not sums[k][g[:-1]]:
            return lower
        n = counts[k][g]
        gamma = sum(off[k][m - 1] * f for m, f in fans[k][g[:-1]].items())
        return (max(n - off[k][min(n, 3) - 1], 0) * (n > 0) + gamma * lower) / sums[k][g[:-1]]

    def score(t):
        d = pad + t.encode().translate(digits)
        return sum(math.log(p(d[i : i + order])) for i in range(len(d) - order + 1)), len(d) - order + 1

    return score, p


TEXTS = ["the cat sat on the mat", "the dog sat on the log 12", "a cat and a dog, 34 é", "mats and logs and cats", "", "zq"]


@pytest.mark.parametrize("order", [2, 3, 5])
@pytest.mark.parametrize("shard_rows", [7, 1000, 4_000_000])
def test_against_the_definition(spark, order, shard_rows):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate([*TEXTS, "unseen words xyz", None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(2)
    trusted = spark.createDataFrame([(i,) for i in range(4)], "doc_id bigint")
    if order != 3 and shard_rows == 7:
        pytest.skip("one order is enough for many shards")
    got = {r["doc_id"]: r for r in P.classify(df, trusted, order=order, shard_rows=shard_rows).collect()}
    score, _ = slow_model([t for i, t in enumerate(TEXTS[:4]) if zlib.crc32(str(i).encode()) % P.FOLDS], order)
    for i, t, _ in rows:
        total, n = score(t or "")
        assert got[i]["n_grams"] == n
        assert got[i]["perplexity"] == (pytest.approx(math.exp(-total / n), rel=1e-4) if n else None)


def test_probabilities_sum_to_one(spark):
    _, p = slow_model(TEXTS[:4], 3)
    for context in (b"th", b"\n\n", b"xx", b"at"):
        assert sum(p(context + bytes([b])) for b in range(256)) == pytest.approx(1.0)
    counts = P.gram_counts(spark.createDataFrame([(t, True) for t in TEXTS[:4]], "text string, trusted boolean"), 3)
    every = spark.range(256).selectExpr("(116L * 256 + 104) * 256 + id AS gram", "0L AS c").join(counts.select("gram"), "gram", "left_anti").unionByName(counts)
    rows = {r["gram"]: r["logp"] for r in P.log_probabilities(every, 3).collect()}
    assert sum(math.exp(rows[(116 * 256 + 104) * 256 + b]) for b in range(256)) == pytest.approx(1.0)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    # Trusted and judged texts are different ones.
    rows = P.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("quality = 1 and doc_id % 2 = 0")).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.3


def test_odd_rows(spark, odd, none):
    trusted = spark.createDataFrame([(1,), (1,), (None,), (6,)], "doc_id bigint")
    rows = P.classify(odd, trusted).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_grams"] == 0 and by[3]["perplexity"] is None and by[3]["kept"]
    assert all(r["kept"] for r in P.classify(odd, trusted.limit(0)).collect())
    assert P.classify(none, trusted).count() == 0
