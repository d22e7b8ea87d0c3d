import re
from collections import Counter
from itertools import permutations

import pytest

from ledgerloom.llm import filteraudit as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic). Each document is walked through each order by itself."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(set(t) & set("#$%&*|")),
            "E": any(e is not None and d is not None and e < d and (u or "") == t for e, u, _ in rows),
        }
        docs.append((s or "", d, {f for f, yes in fails.items() if yes}))
    out = {(p, "".join(o), k): Counter() for p in {p for p, _, _ in docs} for o in permutations("ABCDE") for k in range(1, 6)}
    for p, d, fails in docs:
        for o in permutations("ABCDE"):
            gone = None
            for k, f in enumerate(o, 1):
                c = out[p, "".join(o), k]
                if fails == {f}:
                    c["unique_fails"] += 1
                if gone is not None:
                    c["redundant"] += f in fails
                elif f in fails:
                    gone = k
                    c["removed"] += 1
                    c["good_lost"] += d in good
                    c["toxic_lost"] += d in toxic
                else:
                    c["kept"] += 1
    total = Counter()
    for (p, o, k), c in out.items():
        total[p, o[k - 1]] += c["removed"]
    return sorted((p, o, k, *(c[x] for x in COLUMNS[3:-1]), total[p, o[k - 1]]) for (p, o, k), c in out.items())


def got(df, labels):
    return sorted(tuple(r) for r in X.audit(df, labels).select(*COLUMNS).collect())


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 1), (2, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_odd_rows(odd, none, labels):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert got(odd, labels) == brute(rows, [tuple(r) for r in labels.collect()])
    assert got(none, labels) == [] and len(got(odd, labels.limit(0))) == 600 * len({r[2] or "" for r in rows})


def test_each_filter_and_copies(spark, labels):
    long = [f"w{i}" for i in range(200)]
    texts = [" ".join(long), " ".join(long), " ".join(long[:199]), " ".join(["same"] * 400), " ".join(long) + " ABCDEFGHIJKLMNOPQRSTUVWXYZ", " ".join(long) + " a|b", "", None, "", "# " * 300]
    rows = [(i % 7 + 1, t, "s" if i % 2 else None) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert got(df, labels) == brute(rows, [tuple(r) for r in labels.collect()])


def test_shuffled_joins_agree(spark, odd, labels, monkeypatch):
    want = got(odd, labels)
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert got(odd, labels) == want


def test_a_steps_counts_add_up(docs, spark, sf):
    out = X.audit(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    sizes = {r["part"]: r["count"] for r in docs.groupBy("source").count().withColumnRenamed("source", "part").collect()}
    runs = Counter()
    for r in out:
        runs[r["part"], r["filter_order"]] += r["removed"]
        assert r["kept"] + r["removed"] + r["redundant"] <= sizes[r["part"]]
    last = {(r["part"], r["filter_order"]): r["kept"] for r in out if r["step"] == 5}
    assert all(runs[k] + last[k] == sizes[k[0]] for k in last)
