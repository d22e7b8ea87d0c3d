import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import observe as O
from ledgerloom.schemas import SPANS
from ledgerloom.sources import landing as L
from ledgerloom.sources import manifest as M
from ledgerloom.streaming import incremental as S


def test_latest_filings_by_form(spark):
    rows = [("10-Q", "2025-05-01", "2025-03-31", "a1"), ("10-K", "2025-02-01", "2024-12-31", "a2"), ("10-Q", "2025-08-01", "2025-06-30", "a3"), ("10-K/A", "2025-03-01", "2024-12-31", "a4"), ("4", "2025-08-02", "", "a5"), ("10-K", "2024-02-01", "2023-12-31", "a6"), ("10-Q", "2024-11-01", "2024-09-30", "a7")]
    form, filed, report, acc = (list(x) for x in zip(*rows, strict=True))
    from pyspark.sql import Row

    subs = spark.createDataFrame([("0000000001", Row(recent=Row(form=form, filingDate=filed, reportDate=report, accessionNumber=acc, primaryDocument=["d.htm"] * 7)))], "cik string, filings struct<recent: struct<form: array<string>, filingDate: array<string>, reportDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>>")
    picked = M.select_filings(M.filing_rows(subs, ["cik"]), ["cik"], {"10-K": 1, "10-Q": 2})
    assert [r["accessionNumber"] for r in picked.orderBy(F.desc("filingDate")).collect()] == ["a3", "a1", "a2"]
    made = M.manifest(picked.withColumn("company", F.lit("Acme")).withColumn("ticker", F.lit("ACME")))
    assert made.where("filing_id = 'ACME_10Q_2025-06-30'").count() == 1
    assert M.form_counts(subs.select("cik"), made).first()[1:] == (1, 2)


def test_companies(spark):
    universe = spark.createDataFrame([(0, "A", "brk.b "), (1, "A2", "BRKB2"), (2, "B", "none")], "pos int, company string, ticker string")
    ciks = spark.createDataFrame([("BRK-B", 1067983), ("BRKB2", 1067983)], "ticker string, cik bigint")
    got = M.companies(universe, ciks, "2026-01-01").collect()
    assert [(r["ticker"], r["cik"]) for r in got] == [("BRK.B", "0001067983")]


def test_documents_are_validated(spark):
    good = b"<html><body>FORM 10-K annual report" + b"x" * 30_000
    rows = [(0, good, "10-K"), (1, b"<html>10-K</html>", "10-K"), (2, good, "10-Q"), (3, b"%PDF" + b"10-K" * 10_000, "10-K")]
    from ledgerloom.functions.text import validate_document

    df = spark.createDataFrame(rows, "i int, content binary, form string").select("i", validate_document(F.col("content"), F.col("form")).alias("r")).orderBy("i")
    assert [r["r"] for r in df.collect()] == [None, "too small", "never mentions its form", "not an HTML document"]


def test_store_replaces_filings(spark, tmp_path):
    store = L.NodeStore(spark, str(tmp_path / "p"))
    nodes = lambda f, n, p: spark.createDataFrame([(f, f"{p}{i}", f"text {i}") for i in range(n)], "filing_id string, node_id string, text string")
    store.replace(nodes("F1", 3, "p"))
    store.replace(nodes("F1", 2, "p"))
    store.replace(nodes("F2", 1, "q"))
    assert store.count() == 3
    ids = spark.createDataFrame([("p0",), ("p2",), ("q0",), ("missing",)], "node_id string")
    assert {r["node_id"] for r in store.get(ids).collect()} == {"p0", "q0"}
    assert store.stale(nodes("F1", 3, "p").unionByName(nodes("F2", 1, "q"))).count() == 1
    store.replace(nodes("a=b/c", 2, "r"), spark.createDataFrame([("F2",), ("a=b/c",), ("never",)], "filing_id string"))
    assert {r["node_id"] for r in store.read().collect()} == {"p0", "p1", "r0", "r1"}
    store.replace(nodes("F1", 0, "p"), spark.createDataFrame([("a=b/c",)], "filing_id string"))
    assert {r["node_id"] for r in store.read().collect()} == {"p0", "p1"}
    with pytest.raises(PermissionError):
        L.NodeStore(spark, str(tmp_path / "p"), readonly=True).replace(nodes("F3", 1, "r"))


def test_landed_files(spark, tmp_path):
    (tmp_path / "ACME").mkdir()
    (tmp_path / "ACME" / "ACME_10Q_2025-06-28.htm").write_bytes(b"<html>10-Q</html>")
    row = L.landed(spark, str(tmp_path)).first()
    assert row["filing_id"] == "ACME_10Q_2025-06-28" and row["bytes"] == 17 and len(row["sha256"]) == 64


def test_state(spark):
    state = spark.createDataFrame([], "id string, status string, attempts bigint, error string")
    state = L.mark(state, spark.createDataFrame([("X", "failed", "boom")], "id string, status string, error string"))
    state = L.mark(state, spark.createDataFrame([("X", "done", None)], "id string, status string, error string"))
    row = state.first()
    assert (row["status"], row["attempts"], row["error"]) == ("done", 2, None)
    assert [tuple(r) for r in L.state_summary(state).collect()] == [("done", 1)]


def test_client_waits_and_gives_up():
    answers, waits = [(429, b""), (200, b"Request Rate Threshold Exceeded"), (200, b'{"a": 1}')], []
    client = L.Client("Someone someone@mail.org", opener=lambda _: answers.pop(0), sleep=waits.append)
    assert client.get_json("u") == {"a": 1} and [w for w in waits if w >= 1] == [1.0, 2.0]
    with pytest.raises(L.ClientError):
        L.Client("a@b.org", opener=lambda _: (404, b""), sleep=waits.append).get("u")
    for bad in ("nobody", "me@example.com"):
        with pytest.raises(ValueError):
            L.check_agent(bad)


def test_config_overrides(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"index": {"url": "http://a"}}')
    monkeypatch.setenv("INDEX_URL", "http://b")
    assert L.config(tmp_path / "c.json", {"INDEX_URL": ("index", "url")})["index"]["url"] == "http://b"


def test_deep_spans_are_no_silent_loss(spark, monkeypatch):
    monkeypatch.setattr(O, "DEPTH", 3)
    at = dt.datetime(2031, 1, 1)
    rows = [("t", "s0", None, O.ROOT, "CHAIN", at, at, "q", 900.0)] + [("t", f"s{i}", f"s{i - 1}", "step", "CHAIN", at, at, None, 1.0) for i in range(1, 4)]
    deep = lambda parent: spark.createDataFrame([*rows, ("t", "deep", parent, "rerank.cross_encoder", "CHAIN", at, at, None, 40.0)], SPANS)
    assert O.breakdown(deep("s1"), 1).first()["rerank"] == 40.0
    with pytest.raises(ValueError):
        O.breakdown(deep("s3"), 1)


def test_breakdown_counts_outermost_stages(spark):
    def row(sid, parent, name, kind, start, ms):
        t = dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=start)
        return ("t", sid, parent, name, kind, t, t + dt.timedelta(milliseconds=ms), "Q?" if parent is None else None, float(ms))

    rows = [row("root", None, "rag.answer", "CHAIN", 0, 10000), row("d", "root", "query.decompose", "CHAIN", 0, 1000), row("d_llm", "d", "x.chat", "LLM", 10, 900), row("p", "root", "retrieve.candidate_pool", "RETRIEVER", 1000, 100), row("r", "root", "rerank.cross_encoder", "RERANKER", 1100, 400), row("llm", "root", "x.predict", "LLM", 1500, 8000), row("llm2", "llm", "x.chat", "LLM", 1510, 7900), row("cv", "root", "answer.calc_and_verify", "TOOL", 9500, 5)]
    from ledgerloom.schemas import SPANS

    got = O.breakdown(spark.createDataFrame(rows, SPANS), 1).first()
    assert (got["decompose"], got["pool"], got["rerank"], got["llm"], got["calc_verify"], got["other"]) == (1000, 100, 400, 8000, 5, 495)


def test_spans_and_service(spark):
    tracer = O.Tracer()
    with O.span("x"), O.span("rag.answer", value={"a": 1}, tracer=tracer), O.span("inner", tracer=tracer):
        pass
    rows = {r["name"]: r for r in tracer.flush(spark).collect()}
    assert rows["inner"]["parent"] == rows["rag.answer"]["span"] and rows["rag.answer"]["input"] == '{"a": 1}'
    reqs = spark.createDataFrame([(i, float(i), i % 4 == 0, i % 2) for i in range(300)], "at int, total_ms double, refused boolean, unverified int")
    m = O.service_metrics(reqs).first()
    assert m["requests"] == 200 and m["refusal_rate"] == 0.25 and m["unverified_rate"] == 0.5 and m["p95_ms"] == 289.0


def test_ingest_is_idempotent(spark, tmp_path):
    spark.createDataFrame([("F1", "n1"), ("F2", "n2")], "filing_id string, node_id string").write.parquet(str(tmp_path / "in"))
    store = L.NodeStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        S.ingest(S.read_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck"), lambda b: b)
    assert store.count() == 2


def test_section_state_across_batches(spark, tmp_path):
    lines = [("d", 0, "10-K", "PART I", True), ("d", 1, "10-K", "Item 1. Business", True), ("d", 2, "10-K", "Text.", False)]
    schema = "doc_id string, idx int, form_type string, text string, bold boolean"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = S.section_labels(S.read_stream(spark, str(tmp_path / "in")))
    S.to_table(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [r["section"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("idx").collect()]
    assert got == ["Cover Page", "Item 1. Business", "Item 1. Business"]


def test_http_source_reports_errors_as_rows(spark):
    import json

    spark.dataSource.register(L.HttpSource)
    rows = spark.read.format("polite_http").option("urls", json.dumps(["http://127.0.0.1:9/a", "http://127.0.0.1:9/b"])).option("agent", "Someone someone@mail.org").option("partitions", "2").load().collect()
    assert sorted(r["url"][-1] for r in rows) == ["a", "b"] and all(r["content"] is None and r["error"] for r in rows)


def test_lines_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("0001", 'a "quoted"\nline'), ("0002", None)], "cik string, text string")
    L.write_lines(df, str(tmp_path / "j"))
    assert sorted(map(tuple, L.read_lines(spark, str(tmp_path / "j"), "cik string, text string").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "c.csv").write_text('cik,text\n0001,"a ""quoted""\nline"\n')
    assert [tuple(r) for r in L.read_csv(spark, str(tmp_path / "c.csv"), "cik string, text string").collect()] == [("0001", 'a "quoted"\nline')]
