import re

import pytest

from ledgerloom.llm import mixing as M


def fill(sizes, weights, most):
    """The rule as it is told: shares by weight, excess shared again until none is above its limit."""
    target, done, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in done]
        if not open_:
            return target
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            done.add(s)
        left = float(sum(sizes.values())) - sum(target.values())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, None: 5}, {"a": 1, "b": 1000, "c": 2, "d": 3, "e": 0}, {"x": 7}, {"Z": 5, "a": 0, "é": 100, None: 1000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    want = fill(sizes, {s: float(1 + i % 3) for i, s in enumerate(order)}, 3.0)
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_copies(docs):
    rows = M.mix(docs, keep=("source",)).toPandas()
    assert (rows["copies"] <= 3).all() and (rows["copies"] >= rows["rate"].astype(int)).all()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert abs(per.taken.sum() / per.target.sum() - 1) < 0.2
    again = M.mix(docs.repartition(7)).toPandas()
    assert sorted(again["taken"]) == sorted(rows["taken"])
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == int(rows["copies"].sum())


def test_odd_rows(odd, none):
    rows = M.mix(odd).collect()
    assert len(rows) == odd.count()
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in odd.collect())
    assert sorted(r["size"] for r in rows) == want
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert M.mixed_documents(odd).columns == odd.columns
    assert M.mix(none).count() == 0 and M.mixed_documents(none).count() == 0
