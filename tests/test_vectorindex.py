"""The vector index against an exhaustive search in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import vectorindex as X

RNG = np.random.default_rng(5)
CENTRES = X.unit_rows(RNG.normal(size=(12, 16)))


def made(n):
    """Clusters of uneven size, copies of one vector, a null and one of zeros."""
    v = CENTRES[np.minimum(RNG.geometric(0.3, n), 12) - 1] + 0.2 * RNG.normal(size=(n, 16))
    v[: n // 3] = v[0]
    rows = [(i, [float(x) for x in r], i % 4) for i, r in enumerate(v)]
    return [*rows, (n, None, 0), (n + 1, [0.0] * 16, 1)]


ROWS = made(900)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    old, X.LIST_ROWS = X.LIST_ROWS, 100
    index = X.VectorIndex(spark, str(tmp_path_factory.mktemp("ivf")))
    index.build(spark.createDataFrame(ROWS, "vec_id bigint, embedding array<double>, label int"), "vec_id", "embedding")
    X.LIST_ROWS = old
    return index


def brute(k, keep=lambda label: True):
    m = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in ROWS if v is not None and np.any(v)}
    labels = {i: c for i, _, c in ROWS}
    out = {}
    for q in (i for i in m if i % 50 == 7):
        s = [(-round(float(m[q] @ v), 9), i) for i, v in m.items() if keep(labels[i])]
        out[q] = [i for _, i in sorted(s)[:k]]
    return out


def asked(spark):
    return spark.createDataFrame([(i, v) for i, v, _ in ROWS if i % 50 == 7 or v is None], "qid bigint, q array<double>")


def got(index, spark, k, **options):
    out = {}
    for r in sorted(index.search(asked(spark), k, "qid", "vec_id", **options).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["qid"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("probes,block", [(1, 2000), (4, 5)])
def test_exact(spark, index, probes, block):
    assert got(index, spark, 7, probes=probes, exact=True, block=block) == brute(7)


def test_filter(spark, index):
    assert got(index, spark, 5, probes=2, exact=True, where=F.col("label") == 2) == brute(5, lambda c: c == 2)


def test_probes_alone(spark, index):
    want, found = brute(10), got(index, spark, 10, probes=8)
    assert np.mean([len(set(found.get(q, [])) & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_every_vector_is_in_one_list_within_its_radius(spark, index):
    rows = spark.read.parquet(f"{index.path}/vectors").collect()
    lists = {r["list"]: r for r in spark.read.parquet(f"{index.path}/lists").collect()}
    assert sorted(r["vec_id"] for r in rows) == list(range(900)) and sum(r["size"] for r in lists.values()) == 900
    for r in rows:
        assert np.dot(r["_v"], lists[r["list"]]["centroid"]) >= np.cos(lists[r["list"]]["radius"]) - 1e-9
    assert max(r["part"] for r in rows) >= 2  # the list of the copies is several tasks


def test_empty(spark, tmp_path):
    index = X.VectorIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    assert index.search(asked(spark), 3, "qid", "vec_id", exact=True).count() == 0


def test_probes_are_as_many_as_the_recall_needs(spark, tmp_path):
    """Vectors without clusters: sixteen of their lists hold too few of the nearest."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(RNG.normal(size=(3000, 24)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").cache()
    index = X.VectorIndex(spark, str(tmp_path / "ivf"))
    index.build(table, "vec_id", "embedding", lists=80)
    asked = table.where("vec_id % 60 = 0").selectExpr("vec_id AS qid", "embedding AS q")
    exact = index.search(asked, 10, "qid", "vec_id", exact=True).select("qid", "vec_id").cache()
    reached = lambda probes: X.recall(index.search(asked, 10, "qid", "vec_id", probes=probes), exact, "qid", "vec_id").first()["recall"]
    probes = index.probes_for(asked, exact, 10, "qid", "vec_id")
    assert reached(16) < 0.9 <= reached(probes) and 16 < probes <= 80
