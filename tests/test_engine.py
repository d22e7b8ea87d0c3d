import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grid as G
from ledgerloom.functions import grid_columns as C
from ledgerloom.operators import chunking, facts, judging
from ledgerloom.operators.engine import Engine, build_index
from ledgerloom.sources.manifest import constituents

SECTION = {"section": "Part I, Item 1. Financial Statements", "part": "I", "item": "1", "note": None, "subsection": None}
LIMITS = chunking.Limits()


def filing(ticker, period, quarter, income, before):
    end = {"Q1": "March 31", "Q2": "June 30"}[quarter]
    grid = [["", f"Three months ended {end}, 2025", f"Three months ended {end}, 2024"], ["Revenue:", "", ""], ["Total revenue", income, before], ["Net income", "1,200", "1,100"]]
    elements = [{"type": "table", "text": G.to_markdown(grid), "caption": "CONSOLIDATED STATEMENTS OF OPERATIONS", "units": "millions", **SECTION}, {"type": "paragraph", "text": f"Our total revenue was ${income} million, driven by strong demand for cloud services.", "caption": None, "units": None, **SECTION}]
    meta = (f"{ticker}_10Q_{period}", f"{ticker.title()}, Inc.", ticker, "10-Q", "2025", quarter, period, f"acc-{ticker}-{quarter}", "2025-08-01")
    return elements, meta


@pytest.fixture(scope="module")
def nodes(spark):
    names = ["type", "text", "caption", "units", "section", "part", "item", "note", "subsection"]
    rows, metas = [], []
    for args in (("ACME", "2025-06-30", "Q2", "28,202", "25,352"), ("ACME", "2025-03-31", "Q1", "24,000", "23,000"), ("ZENO", "2025-06-30", "Q2", "9,541", "9,000")):
        elements, meta = filing(*args)
        metas.append(meta)
        rows += [(meta[0], i, *[e[n] for n in names], None, None) for i, e in enumerate(elements)]
    elements = spark.createDataFrame(rows, "filing_id string, idx int, " + ", ".join(f"{n} string" for n in names) + ", table_ref int, heading_kind string")
    manifest = spark.createDataFrame(metas, "filing_id string, company string, ticker string, form_type string, fiscal_year string, fiscal_period string, period_of_report string, accession_number string, filing_date string")
    return chunking.chunks(elements, manifest, LIMITS).cache()


def test_facts_and_questions(spark, nodes):
    got = {(r["filing_id"], r["name"]): r for r in facts.extract_facts(nodes).collect()}
    f = got[("ACME_10Q_2025-06-30", "total revenue")]
    assert (f["value"], f["prior_value"], f["group"], f["statement"]) == ("28,202", "25,352", None, "income")  # a group row above the first line of data belongs to the header
    asked = facts.build(nodes).collect()
    kinds = {r["type"] for r in asked}
    assert {"numeric", "yoy", "cross_quarter"} <= kinds and all(r["gold_groups"] and all(r["gold_groups"]) for r in asked)
    pair = next(r for r in asked if r["type"] == "cross_quarter" and "total revenue" in r["question"])
    assert pair["expected_change"] == 4202.0 and len(pair["gold_groups"]) == 2
    assert sorted(r["qid"] for r in asked)[0] == "q0000" and len({r["qid"] for r in asked}) == len(asked)
    assert {r["question"] for r in facts.build(nodes).collect()} == {r["question"] for r in asked}


def test_rules(spark, nodes):
    rules = spark.createDataFrame([("r1", ["ACME"], None, ["financial"], ["revenue"], ["CLOUD", "none"]), ("r2", ["ZENO"], None, None, ["absent"], None)], "rule string, tickers array<string>, filing_ids array<string>, heading_any array<string>, text_all array<string>, text_any array<string>")
    got = {r["rule"] for r in facts.rule_gold(rules, nodes.where("node_type = 'child'")).collect()}
    assert got == {"r1"}


@pytest.fixture(scope="module")
def engine(spark, nodes, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    for _ in range(2):
        build_index(nodes, path)
    return Engine(spark, path)


def test_index_is_idempotent(engine, nodes):
    assert engine.table("children").count() == nodes.where("node_type = 'child'").count()


@pytest.mark.parametrize("name", ["dense", "bm25", "hybrid", "rerank", "decomposed", "hyde_dense"])
def test_retrievers(spark, engine, name):
    q = spark.createDataFrame([("q1", "What was Zeno total revenue driven by cloud services?"), ("q2", "Compare total revenue in fiscal 2025 Q1 with fiscal 2025 Q2.")], "qid string, question string")
    rows = engine.retriever(name)(q, 4).collect()
    assert rows and all(r["rank"] <= 4 for r in rows) and len({(r["qid"], r["node_id"]) for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        engine.retriever("none")


def test_filter_and_answer(spark, engine):
    q = spark.createDataFrame([("q1", "What was the total revenue?")], "qid string, question string")
    hits = engine.bm25(q, 5, F.col("filing_id") == "ZENO_10Q_2025-06-30").join(engine.table("children").withColumnRenamed("text", "t"), "node_id")
    assert {r["filing_id"] for r in hits.select(F.col("filing_id").cast("string").alias("filing_id")).collect()} == {"ZENO_10Q_2025-06-30"}
    got = engine.answer(q).first()
    assert got["contexts"] and got["sources"][0]["n"] == 1 and not got["refused"]
    none = engine.answer(spark.createDataFrame([("q9", "zzz qqq?")], "qid string, question string")).first()
    assert none["refused"] and none["contexts"] == []


GRIDS = [[["", "2025", "2024"], ["Revenue", "$10", "$9"]], [["•", "We sell | products."]], [["Item 1.", "Business", "3"], ["Item 1A.", "Risk Factors", "9"], ["Item 2.", "Properties", "20"]], [["", "2025"], ["Margin", "46.5%"]], [["Gross:", "", ""], ["Products", "34.5%", "(35.3%)"]]]


def test_grid_expressions_agree(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(GRIDS)], "i int, g array<array<string>>")
    g = F.col("g")
    rows = df.select("i", C.kind_of(g).alias("k"), C.has_header(g).alias("h"), C.all_percentages(g).alias("p"), C.to_markdown(g).alias("m"), C.to_text(g).alias("t"), F.size(C.cells(g)).alias("n")).orderBy("i").collect()
    for r, x in zip(rows, GRIDS, strict=True):
        assert (r["k"], r["h"], r["p"], r["m"], r["t"]) == (G.kind_of(x), G.has_header(x), G.all_percentages(x), G.to_markdown(x), G.to_text(x))
        assert r["n"] == sum(bool(c) for row in x for c in row[1:])


MINUTE = "Error code: 429 - Rate limit reached on tokens per minute (TPM). Please try again in 7.5s."
DAY = "Error code: 429 - Rate limit reached on tokens per day (TPD). Please try again in 14m2.5s."


def guarded(errors, most=10):
    errors, slept = list(errors), []

    def call(_):
        if errors:
            raise RuntimeError(errors.pop(0))
        return "ok"

    return judging.CallGuard(call, 6000, most, 5, slept.append), slept


def test_guard():
    guard, slept = guarded([MINUTE, MINUTE])
    assert guard("p") == "ok" and (guard.waited, guard.calls, guard.stopped) == (2, 3, None) and 8.5 in slept
    guard, _ = guarded([DAY])
    for _ in range(2):
        with pytest.raises(judging.BudgetExhausted):
            guard("p")
    assert "daily" in guard.stopped and guard.calls == 1
    guard, _ = guarded([], most=2)
    assert [guard("p"), guard("p")] == ["ok", "ok"]
    with pytest.raises(judging.BudgetExhausted):
        guard("p")
    with pytest.raises(RuntimeError, match="404"):
        guarded(["Error code: 404"])[0]("p")


def test_summaries(spark):
    rows = [("numeric", True, True, True, None, False, True, 0, 10.0), ("yoy", False, True, True, False, True, False, 2, 30.0), ("narrative", False, False, False, None, False, False, 0, 5.0)]
    df = spark.createDataFrame(rows, "type string, correct boolean, all_facts_in_context boolean, values_ok boolean, calc_ok boolean, refused boolean, cited boolean, unverified int, latency_ms double")
    total = judging.run_summary(df).where("type is null").first()
    assert (total["n"], total["correct"], total["calc_ok"], total["refused_with_facts"], total["unverified"], total["p50_ms"]) == (2, 0.5, 0.0, 1, 0.5, 20.0)
    per = spark.createDataFrame([("a", "dev", 0.5, 1.0), ("b", "dev", 0.7, 2.0), ("b", "test", 0.6, 2.0)], "variant string, split string, mrr_10 double, latency_ms double")
    assert {r["variant"] for r in judging.sweep(per).where("chosen").collect()} == {"b"}
    answers = spark.createDataFrame([("q", "What rose?", "Revenue rose.", ["Revenue rose fast"]), ("r", "What?", "The sources do not contain this information.", [])], "qid string, question string, answer string, contexts array<string>")
    got = {r["qid"]: r for r in judging.judge(answers).collect()}
    assert got["q"]["faithfulness"] == 1.0 and got["r"]["refused"] and got["r"]["faithfulness"] is None


def test_constituents():
    rows = "".join(f"<tr><td>Company {i}</td><td>t{i}</td></tr>" for i in range(95))
    got = constituents(f"<table><tr><th>x</th></tr></table><table><tr><th>Company</th><th>Ticker</th></tr>{rows}</table>")
    assert len(got) == 95 and got[3] == {"pos": 3, "company": "Company 3", "ticker": "T3"}
    with pytest.raises(ValueError):
        constituents("<table></table>")
