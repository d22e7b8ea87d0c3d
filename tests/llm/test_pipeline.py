"""The pipeline against its stages' plain versions, one by one on what the stage before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, toxicity
from tests.llm.test_exactdedup import LOWER
from tests.llm.test_nearcopies import kept as kept_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    kept, columns = docs, docs.columns
    expected = {r["doc_id"]: r["text"] for r in docs.collect()}
    lexicon = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name == "toxicity":
            expected = {d: t for d, t in expected.items() if not lexicon.rejects(t, toxicity.THRESHOLD)}
        elif name == "exact dedup":
            best = {}
            for d, t in expected.items():
                best[t.translate(LOWER)] = max(d, best.get(t.translate(LOWER), d))
            expected = {d: expected[d] for d in best.values()}
        elif name == "near dedup":
            left = kept_of(list(expected.items()))
            expected = {d: t for d, t in expected.items() if d in left}
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}
            assert out.columns == columns
            break
        assert {r["doc_id"] for r in out.collect()} == set(expected) and out.columns == columns
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert packed.select("length").groupBy().sum().first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_run_gives_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[0] == "doc_id" and rows.count() > 0


def test_run_against_the_plain_stages(spark, docs):
    lexicon = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if not lexicon.rejects(r["text"], toxicity.THRESHOLD)}
    best = {}
    for d, t in texts.items():
        best[t.translate(LOWER)] = max(d, best.get(t.translate(LOWER), d))
    ids = kept_of([(d, texts[d]) for d in best.values()])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.where(F.col("doc_id").isin(sorted(ids)))).collect()}
    rows = corpus_pipeline.run(spark, SF).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] // r["doc_tokens"] for r in rows} == {d: n for d, n in copies.items() if n}
    assert all(r["n"] % r["doc_tokens"] == 0 for r in rows)


def test_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (6, 0)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("k", range(4))
def test_empty_table(spark, none, k, tmp_path):
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.STAGES[k][1](spark, none, str(tmp_path))
    assert out.count() == 0 and out.columns == none.columns


def test_packing_of_an_empty_table(spark, none):
    out = corpus_pipeline.STAGES[4][1](spark, none, SF)
    assert out.count() == 0 and out.columns[0] == "doc_id"
