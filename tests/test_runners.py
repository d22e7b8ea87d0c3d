"""Models over tables: how often they are called, what is remembered, and how large calls get."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as K
from ledgerloom.operators import runners as X


def counted(path):
    """A model that writes each prompt it is asked into a file of its own run, and may be made once a task."""

    def make():
        def ask(prompts):
            with open(path, "a") as f:
                f.write("".join(f"{len(prompts)}\t{p}\n" for p in prompts))
            return [None if p is None else f"<{p}>" for p in prompts]

        return ask

    return make


def asked(path):
    return [x.split("\t") for x in path.read_text().splitlines()] if path.exists() else []


def test_calls_are_bounded():
    sizes = [5, 50, 1, 100, 7, 7, 300, 2]
    out = list(X.calls(sizes, rows=3, chars=110))
    assert sorted(i for c in out for i in c) == list(range(8)) and max(map(len, out)) <= 3
    assert all(sum(sizes[i] for i in c) <= 110 or len(c) == 1 for c in out) and out[0] == [6]


def test_a_key_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    memo = X.Memo(spark, str(tmp_path / "memo"))
    rows = spark.createDataFrame([("a", "one", 1), ("a", "one", 2), ("b", "two", 3), (None, "none", 4), ("c", None, 5)], "key string, prompt string, n int")
    got = {r["n"]: r["reply"] for r in memo.ask(rows, counted(log)).collect()}
    assert got == {1: "<one>", 2: "<one>", 3: "<two>", 4: None, 5: None}
    assert sorted(p for _, p in asked(log)) == ["None", "one", "two"]
    more = rows.unionByName(spark.createDataFrame([("d", "four", 6)], rows.schema))
    memo.put(spark.createDataFrame([("b", "edited"), ("b", "later")], "key string, reply string"))
    got = {r["n"]: r["reply"] for r in memo.ask(more, counted(log), rows_a_call=1).collect()}
    assert got[3] == "later" and got[6] == "<four>" and len(asked(log)) == 4
    assert memo.ask(rows.limit(0), counted(log)).count() == 0 and len(asked(log)) == 4


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    memo = X.Memo(spark, str(tmp_path / "memo"))
    rows = spark.createDataFrame([("a", "one")], "key string, prompt string")

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        memo.ask(rows, broken)
    assert memo.known().count() == 0
    assert memo.ask(rows, counted(tmp_path / "calls")).first()["reply"] == "<one>"


def test_embedding_runs_new_texts_only(spark, tmp_path):
    log = tmp_path / "calls"

    def model():
        def embed(texts):
            with open(log, "a") as f:
                f.write("".join(f"{len(texts)}\t{t}\n" for t in texts))
            return [[len(t), 1.0] for t in texts]

        return embed

    store = X.Embeddings(spark, str(tmp_path / "v"), max_tokens=4)
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "one two three four five"), (4, None), (5, "")], "id int, text string")
    got = {r["id"]: (r["v"], r["truncated"]) for r in store.embed(rows, model).collect()}
    assert got == {1: ([5.0, 1.0], False), 2: ([5.0, 1.0], False), 3: ([18.0, 1.0], True), 4: (None, None), 5: ([0.0, 1.0], False)}
    assert sorted(t for _, t in asked(log)) == ["", "a b c", "one two three four"] and tuple(store.last_run().first()) == (3, 1)
    assert store.embed(rows, model).columns == ["id", "text", "v", "truncated"] and tuple(store.last_run().first()) == (0, 0)
    assert len(asked(log)) == 3
    store.embed(rows.unionByName(spark.createDataFrame([(6, "new")], rows.schema)), model)
    assert len(asked(log)) == 4 and X.Embeddings(spark, str(tmp_path / "none")).last_run().first()["embedded"] == 0


def test_vectors_by_position(spark):
    nodes = spark.createDataFrame([("F", 0, "a"), ("F", 1, "b"), ("F", 2, "c")], "filing_id string, pos int, node_id string")
    vectors = spark.createDataFrame([("F", 0, "a", [1.0]), ("F", 1, "x", [2.0]), ("F", 3, "d", [3.0])], "filing_id string, pos int, node_id string, v array<double>")
    assert {(r["pos"], r["ok"]) for r in X.matched_vectors(nodes, vectors).collect()} == {(0, True), (1, False), (2, False), (3, False)}


@pytest.mark.parametrize("buckets,block", [(1, 2_000), (7, 2)])
def test_pairs_in_batches_equal_the_expression(spark, buckets, block):
    docs = spark.createDataFrame([(i, f"word{i} word{i + 1} the {'long ' * (i % 9)}") for i in range(60)] + [(99, None)], "doc_id bigint, text string")
    asked_ = spark.createDataFrame([(f"q{i}", f"word{i} the word{i * 2}") for i in range(12)] + [("none", "")], "item_id string, text string")
    pool = asked_.crossJoin(docs).where((F.col("doc_id") % 3 != 1) | (F.col("doc_id") == 99)).select("item_id", "doc_id")
    pool = spark.createDataFrame([tuple(r) for r in pool.unionByName(pool.limit(5)).collect()], "item_id string, doc_id bigint")
    want = K.rerank(pool.distinct(), asked_, docs.fillna(""), "item_id", "doc_id", 6)
    got = X.rerank_batched(pool, asked_, docs, "item_id", "doc_id", 6, X.lexical_pairs, buckets=buckets, block=block)
    rows = lambda df: sorted((r["item_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    assert rows(got) == rows(want)
