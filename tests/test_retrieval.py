import pytest

from ledgerloom.operators import evaluation as E
from ledgerloom.operators import relational as R
from ledgerloom.operators import retrieval as K


def ranked(spark, ids, q="q"):
    return spark.createDataFrame([(q, d, i) for i, d in enumerate(ids, 1)], "qid string, doc string, rank bigint")


def gold(spark, groups, q="q"):
    return spark.createDataFrame([(q, g, d) for g, ds in enumerate(groups) for d in ds], "qid string, fact int, doc string")


def metrics(spark, ids, groups):
    return E.ranking_metrics(ranked(spark, ids), gold(spark, groups), "qid", "doc").first()


def test_metrics(spark):
    m = metrics(spark, ["x", "g1", "y", "g2", "z"], [["g1", "g2", "g3"]])
    assert m["precision_3"] == pytest.approx(1 / 3) and m["recall_5"] == pytest.approx(2 / 3)
    assert (m["hit_1"], m["hit_3"], m["mrr_10"], m["first_rank"]) == (0, 1, 0.5, 2)
    miss = metrics(spark, ["a", "b"], [["g"]])
    assert (miss["mrr_10"], miss["ndcg_10"], miss["first_rank"]) == (0, 0, None)
    assert metrics(spark, [f"g{i}" for i in range(1, 6)], [[f"g{i}" for i in range(1, 13)]])["recall_5"] == 1.0


def test_metrics_of_several_facts(spark):
    m = metrics(spark, ["a1", "x", "y", "z", "q", "b1"], [["a1", "a2"], ["b1"]])
    assert (m["all_hit_5"], m["all_hit_10"], m["fact_recall_10"], m["hit_1"]) == (0, 1, 1.0, 1)
    assert metrics(spark, ["a1"], [["a1"], ["b1"]])["fact_recall_10"] == 0.5


def test_rrf_rewards_agreement(spark):
    out = K.rrf([ranked(spark, "abc"), ranked(spark, "cd")], "qid", "doc", 3).orderBy("rank").collect()
    assert out[0]["doc"] == "c" and len(out) == 3


def test_interleave(spark):
    rows = spark.createDataFrame([("q", d, r, n) for n, ds in enumerate((["a1", "a2", "s"], ["b1", "s", "b2"])) for r, d in enumerate(ds, 1)], "qid string, doc string, rank bigint, list_no int")
    assert [r["doc"] for r in K.interleave(rows, "qid", "doc", 5).orderBy("rank").collect()] == ["a1", "b1", "a2", "s", "b2"]


def test_relative_fusion_of_constant_lists(spark):
    same = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 2.0)], "qid string, doc string, score double")
    out = {r["doc"]: r["score"] for r in K.relative_fusion(same, same.limit(0), "qid", "doc", 5).collect()}
    assert out == {"a": pytest.approx(0.3), "b": pytest.approx(0.3)}


def test_budget_skips_and_goes_on(spark):
    hits = spark.createDataFrame([("q", c, i) for i, c in enumerate(["c1", "c2", "c3", "c4"], 1)], "qid string, child string, rank int")
    children = spark.createDataFrame([("c1", "p1", 10), ("c2", "p1", 10), ("c3", "p2", 50), ("c4", "p3", 5)], "child string, parent string, tokens int")
    parents = spark.createDataFrame([("p1", 60), ("p2", 500), ("p3", 30)], "parent string, tokens int")
    out = [(r["unit"], r["cost"]) for r in K.expand_to_parents(hits, children, parents, "qid", budget=100, max_parent=100).orderBy("place").collect()]
    assert out == [("p1", 60), ("p3", 30)]  # c2's parent was taken, c3 doesn't fit, p3 still does


def test_pools_and_registry(spark):
    with pytest.raises(ValueError):
        K.candidate_pool("none", {}, "qid", "doc")
    with pytest.raises(ValueError):
        K.retriever("none")
    out = K.candidate_pool("union_45_15", {"bm25": ranked(spark, "ab"), "dense": ranked(spark, "bc")}, "qid", "doc")
    assert [r["doc"] for r in out.orderBy("rank").collect()] == ["a", "b", "c"]


def test_embedding_is_deterministic(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(K.hash_embedding(F.lit("net income rose")).alias("a"), K.hash_embedding(F.lit("net income rose")).alias("b")).select("a", K.cosine(F.col("a"), F.col("b")).alias("c"), K.mean_vector(F.col("a"), F.col("b")).alias("m")).first()
    assert len(row["a"]) == 64 and row["c"] == pytest.approx(1.0) and row["m"] == pytest.approx(row["a"])


def test_mcnemar(spark):
    pairs = [(False, True)] * 14 + [(True, False)] * 0 + [(True, True)] * 20
    assert E.mcnemar(spark.createDataFrame(pairs, "a boolean, b boolean"), "a", "b").first()["p"] == pytest.approx(2 / 2**14)
    assert E.mcnemar(spark.createDataFrame([(True, True)], "a boolean, b boolean"), "a", "b").first()["p"] == 1.0


def test_bootstrap_bounds(spark):
    rows = spark.createDataFrame([(i, 0.0, 1.0 if i % 3 else 0.0) for i in range(60)], "id int, a double, b double")
    out = E.paired_bootstrap(rows, "id", "a", "b", n=200).first()
    assert out["low"] < out["diff"] < out["high"] and out["significant"]


def test_draws_are_made_in_tasks(spark):
    """No list of places stands in the plan: 100,000 rows would be a literal of as many numbers."""
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select("id", F.lit(0.0).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    out = E.paired_bootstrap(rows, "id", "a", "b", n=2)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert out.first()["diff"] == pytest.approx(1.0, abs=1e-4)


def test_bootstrap_makes_all_rounds(spark, sf):
    """The query draws 10,000 times, as its SQL does, and so does the operator where nothing else is asked."""
    import inspect
    import re

    from ledgerloom.plans import evaluation

    assert inspect.signature(E.paired_bootstrap).parameters["n"].default == 10_000
    assert re.search(r"range\((\d+)\) r", evaluation.registry.sql["paired_bootstrap"])[1] == "10000"
    plan = evaluation.paired_bootstrap(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    work, rows = int(re.search(r"Range \(0, (\d+)", plan)[1]), spark.read.parquet(f"{sf}/labels.parquet").count()
    assert work * E.DRAWS >= 10_000 * rows


@pytest.mark.parametrize("held", [0, 10_000])
@pytest.mark.parametrize("size,n", [(1, 3), (60, 120), (20_000, 7)])
def test_bootstrap_against_plain_draws(spark, size, n, held):
    """Held or joined, over several rows of work: the draws are those of hashlib, and a null difference counts in no mean."""
    import hashlib

    import numpy as np

    d = [None if size > 1 and i % 7 == 3 else float(i * 37 % 11 - 4) for i in range(size)]
    rows = spark.createDataFrame([(i, 0.0, x) for i, x in enumerate(d)], "id int, a double, b double").repartition(3)
    hashed = lambda r, s: int(hashlib.md5(f"x:{r}:{s}".encode()).hexdigest()[:13], 16) % size
    means = [np.mean(some) for r in range(n) if (some := [x for s in range(size) if (x := d[hashed(r, s)]) is not None])]
    out = E.paired_bootstrap(rows, "id", "a", "b", n=n, seed="x", held=held).first()
    assert (out["low"], out["high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


@pytest.mark.parametrize("seed", ["0", "é" * 20, "x" * 44, "x" * 47, "y" * 60])
def test_places_are_those_of_hashlib(seed):
    """Rounds and slots of unlike lengths, and texts up to and beyond one block."""
    import hashlib

    from ledgerloom.functions import draws

    rounds, slots = range(7, 13), range(95, 1205, 3)
    got = {r: p for some, at in draws.places(seed, rounds, slots, 977) for r, p in zip(some, at.tolist(), strict=True)}
    assert got == {r: [int(hashlib.md5(f"{seed}:{r}:{s}".encode()).hexdigest()[:13], 16) % 977 for s in slots] for r in rounds}


@pytest.mark.parametrize("most", [7, 1000])
def test_numbers_by_ranges(spark, most):
    keys = [f"k{i * 37 % 101:03}" for i in range(101)] + [None]
    got = {r["k"]: r["i"] for r in E.numbered(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k", len(keys), most).collect()}
    assert got == {k: i for i, k in enumerate([*sorted(keys[:-1]), None])}


def test_upsert_and_as_of(spark):
    log = spark.createDataFrame([("v1", None, 1.0), ("v2", "d", 2.0)], "version string, dataset string, x double")
    new = spark.createDataFrame([("v1", None, 3.0, 7)], "version string, dataset string, x double, extra int")
    out = {(r["version"], r["x"], r["extra"]) for r in R.upsert(log, new, ["version", "dataset"]).collect()}
    assert out == {("v2", 2.0, None), ("v1", 3.0, 7)}
    left = spark.createDataFrame([("k", 1), ("k", 5), ("z", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b")], "k string, at int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in R.as_of(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {("k", 1): None, ("k", 5): "b", ("z", 5): None}


def test_postings_are_counted_within_their_row(spark):
    docs = spark.createDataFrame([(1, "b a b, B"), (2, ""), (3, None), (4, "é 7 é" + " x" * 300)], "doc_id bigint, text string").selectExpr("*", "doc_id % 2 AS odd")
    posts = K.postings(docs, keep=("odd",))
    assert sorted(map(tuple, posts.collect())) == [(1, 1, "a", 1, 4), (1, 1, "b", 3, 4), (4, 0, "7", 1, 303), (4, 0, "x", 300, 303), (4, 0, "é", 2, 303)]
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [2, 2000])
def test_best_by_document_is_the_best_of_all(spark, block):
    docs = spark.createDataFrame([(i, f"w{i % 3} common w{i % 7} " * (1 + i % 4) + "filler " * (i % 5)) for i in range(120)] + [(200, None), (201, "")], "doc_id bigint, text string").repartition(5)
    queries = spark.createDataFrame([(1, "common w1"), (2, "w2 w5 w2"), (3, "nothing here"), (4, None), (5, "common")], "item_id bigint, text string")
    want = K.top_k(K.bm25_scores(docs, queries), 7, "item_id", "doc_id")
    rows = lambda df: sorted((r["item_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(K.bm25_top(docs, queries, 7, block=block)) == rows(want) and want.count() == 21
    assert K.bm25_top(docs.limit(0), queries, 7).count() == 0


def test_no_posting_is_shuffled_for_the_best(spark):
    """Texts are moved for rows of one id only, which count as one document."""
    docs = spark.createDataFrame([(i, f"w{i % 3} common w{i % 7} " * (1 + i % 4)) for i in range(60)], "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(1, "common w1"), (2, "w2 w5")], "item_id bigint, text string")
    rows = lambda df: sorted((r["item_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    spread = K.bm25_top(docs, queries, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in spread and "Aggregate" not in spread and "MapInArrow" in spread
    twice = docs.unionByName(docs.where("doc_id % 5 = 1"))
    assert rows(K.bm25_top(twice, queries, 5)) == rows(K.top_k(K.bm25_scores(twice, queries), 5, "item_id", "doc_id"))


def test_rerank_moves_no_text_that_its_pool_lacks(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} common w{i}") for i in range(60)], "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(1, "common w1 w7"), (2, "w2 w5")], "item_id bigint, text string")
    out = K.rerank(spark.createDataFrame([(1, 7), (1, 3), (2, 5), (2, 4)], "item_id bigint, doc_id bigint"), queries, docs, "item_id", "doc_id", 2)
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in out.collect()) == [(1, 1, 7), (1, 2, 3), (2, 1, 5), (2, 2, 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("strategy=broadcast") > 0


@pytest.mark.parametrize(("by", "block"), [("cosine", 2000), ("distance", 2), ("distance", 2000)])
def test_nearest_is_the_best_of_all_pairs(spark, by, block):
    """Copies, ties, far-off and null vectors; no plan holds a row for each pair."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1e6 if i % 50 == 7 else 1)]) for i in range(1, 2500)]
    rows = [(i, rows[i % 40][1] if i % 3 == 0 else v) for i, v in rows] + [(9001, None), (9002, None)]
    vectors = spark.createDataFrame(rows, "doc bigint, v array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 500 == 3 or i == 9001] + [(-1, rows[0][1])], "qid bigint, q array<double>")
    pairs = {"cosine": K.dense_scores, "distance": K.distance_scores}[by](asked, vectors, "qid", "doc")
    got = lambda df: sorted((r["qid"], r["rank"], r["doc"], None if r["score"] is None else round(r["score"], 8)) for r in df.collect())
    out = K.nearest(asked, vectors, 30, "qid", "doc", by, block=block)
    assert got(out) == got(K.top_k(pairs, 30, "qid", "doc"))
    assert got(K.nearest(asked, vectors.where("doc IS NULL OR doc > 2490"), 30, "qid", "doc", by)) == got(K.top_k(pairs.where("doc > 2490"), 30, "qid", "doc"))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("by", ["cosine", "distance"])
@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e20])
def test_single_precision_loses_no_near_vector(by, scale):
    """Scores that single precision can't tell apart, beside far-off vectors, and squares that it can't hold."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 16))
    x = np.concatenate([base[rng.integers(0, 3, 3000)] + rng.normal(size=(3000, 16)) * 1e-5, rng.normal(size=(1000, 16)) * 1e3]) * scale
    x = x[rng.permutation(len(x))]
    q = x[:7]
    search = K._Nearest(q, 20, by)
    for at in range(0, len(x), 1000):
        search.add(pa.array(np.arange(at, at + 1000)), x[at : at + 1000])
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None]
    scores = unit(q) @ unit(x).T if by == "cosine" else -np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    j, ids, got = K._k_best(search.best, 20)
    for n in range(len(q)):
        want = np.lexsort((np.arange(len(x)), -np.round(scores[n], 9)))[:20]
        assert np.allclose(np.sort(got[j == n]), np.sort(scores[n][want]), rtol=1e-12, atol=1e-8)
        if scale == 1.0:
            assert len(set(ids.to_numpy()[j == n]) & set(want)) >= 19  # roundings of the last place aside


@pytest.mark.parametrize("name", ["rrf_fusion", "relative_fusion", "candidate_pool_union", "round_robin_interleave", "pool_recall"])
def test_both_lists_come_from_one_pass(spark, sf, name):
    """Cosine and distance list: the vectors go to Python once, and no list is joined with the other."""
    from ledgerloom.plans import REGISTRIES

    query = next(r.queries[name] for r in REGISTRIES if name in r.queries)
    df = query(spark, sf)
    assert df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert ran.count("MapInArrow") == 1 and "FullOuter" not in ran


def test_sweep_fuses_stored_lists(spark, sf):
    """Six variants: none scores vectors again, nothing stays cached, and labels are counted once for all."""
    from ledgerloom.plans.evaluation import fusion_sweep

    df = fusion_sweep(spark, sf)
    assert len(df.collect()) == 12
    ran = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "MapInArrow" not in ran and "InMemoryTableScan" not in ran and ran.count("FileScan") <= 12


def test_best_of_the_sweep_is_chosen_on_dev(spark, tmp_path):
    """Labels by length, which the cosine doesn't see: the distance list is best on dev, and its test questions are reported."""
    import math

    import duckdb

    from ledgerloom.plans import evaluation as P
    from tests.oracle import check

    rows = [(i, [(1 + i % 5) * math.cos(i * 0.7), (1 + i % 5) * math.sin(i * 0.7) + i / 1e4], (i + (i % 100 == 0 and i % 300 == 0)) % 5) for i in range(900)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = P.sweep_best(spark, str(tmp_path))
    check(df, con, P.registry.sql["sweep_best"])
    swept = P.fusion_sweep(spark, str(tmp_path)).where("chosen").collect()
    (best,) = df.collect()
    assert {r["split"]: (r["variant"], r["n"], r["mrr_10"]) for r in swept}["test"] == (best["variant"], best["n"], best["mrr"])
    assert best["variant"] != "dense" and {r["split"]: r["mrr_10"] for r in swept}["dev"] == best["dev_mrr"]


def test_lists_by_several_measures_are_those_of_each(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 5), i / 9]) for i in range(60)] + [(90, None)], "doc int, v array<double>")
    asked = vectors.where("doc % 20 = 0 OR doc = 90").selectExpr("doc AS qid", "v AS q")
    rows = lambda df: sorted((r["qid"], r["rank"], r["doc"]) for r in df.collect())
    out = K.nearest_lists(asked, vectors, 9, "qid", "doc", ("distance", "cosine"))
    for n, by in enumerate(("distance", "cosine")):
        assert rows(out.where(f"list_no = {n}")) == rows(K.nearest(asked, vectors, 9, "qid", "doc", by))


def test_scaled_pairs_are_a_full_outer_join(spark):
    """Rows of one id meet each other, those without an id none; a null score counts as 0."""
    dense = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.1), (1, 2, 0.2), (1, None, 0.3), (2, 1, None), (2, 3, 4.0), (2, 4, 5.0)], "q int, doc int, score double")
    sparse = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (1, None, 2.0), (1, 7, 1.0), (2, 1, 7.0), (2, 3, None)], "q int, doc int, score double")
    for name, x in (("_a", dense), ("_b", sparse)):
        x.createOrReplaceTempView(f"scaled{name}")
    part = "SELECT q, doc, coalesce(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 0) AS x FROM {} WINDOW w AS (PARTITION BY q)"
    want = spark.sql(f"SELECT q, doc, coalesce(a.x, 0), coalesce(b.x, 0) FROM ({part.format('scaled_a')}) a FULL JOIN ({part.format('scaled_b')}) b USING (q, doc)")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(K.scaled_pairs([dense, sparse], "q", "doc")) == rows(want)


def test_metrics_by_run_are_those_of_each_run(spark):
    docs = spark.createDataFrame([(i, i % 4, i % 2) for i in range(40)], "doc int, kind int, fact int")
    asked = docs.where("doc % 5 = 0").select(docs.doc.alias("qid"), "kind")
    run = asked.join(docs.select("doc"), (docs.doc * 7 + asked.qid) % 3 == 0).selectExpr("qid", "doc", "CAST(row_number() OVER (PARTITION BY qid ORDER BY doc) AS BIGINT) AS rank").where("rank <= 6")
    both = run.selectExpr("'a' AS run", "*").unionByName(run.where("qid > 10 AND rank % 2 = 1").selectExpr("'b' AS run", "*"))
    rows = lambda df: sorted(map(tuple, df.na.fill(-1).collect()))
    out = E.class_metrics(both, asked, docs, "qid", "doc", "kind", "fact", {"run": ["a", "b", "none"]})
    for name in ("a", "b", "none"):
        assert rows(out.where(f"run = '{name}'").drop("run")) == rows(E.class_metrics(both.where(f"run = '{name}'").drop("run"), asked, docs, "qid", "doc", "kind", "fact"))


def test_gold_by_class_is_that_of_pairs(spark):
    docs = spark.createDataFrame([(i, i % 4 if i % 7 else None, i % 2) for i in range(40)] + [(50, 9, 0)], "doc int, kind int, fact int")
    asked = docs.where("doc % 5 = 0").select(docs.doc.alias("qid"), "kind")
    run = asked.join(docs.select("doc"), (docs.doc * 7 + asked.qid) % 3 == 0).selectExpr("qid", "doc", "CAST(row_number() OVER (PARTITION BY qid ORDER BY doc) AS BIGINT) AS rank").where("rank <= 6")
    gold = docs.join(asked, "kind").where("qid <> doc").select("qid", "fact", "doc")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(E.class_metrics(run, asked, docs, "qid", "doc", "kind", "fact").na.fill(-1)) == rows(E.ranking_metrics(run, gold, "qid", "doc").na.fill(-1))
    assert rows(E.class_pool_recall(run, asked, docs, "qid", "doc", "kind", "fact")) == rows(E.pool_recall(run, gold, "qid", "doc"))
