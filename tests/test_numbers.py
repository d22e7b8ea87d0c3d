import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import tables as P
from ledgerloom.functions import text as T
from ledgerloom.operators import answers as A
from ledgerloom.operators import audit
from ledgerloom.operators import evaluation as E


def test_calculations():
    text, log = N.calculated("Down <calc>4110 - 5480</calc>, that is <calc>(4110-5480)/5480*100</calc>% and <calc>7/2</calc> [2].")
    assert text == "Down -1,370, that is -25% and 3.50% [2].".replace("3.50%", "3.5")
    assert [c["text"] for c in log] == ["-1,370", "-25", "3.5"]
    for bad in ("open('x')", "2 ** 3", "(1", "", "x"):
        with pytest.raises(ValueError):
            N.evaluate(bad)
    text, log = N.calculated("<calc>5/(3-3)</calc> tons")
    assert text == "[calculation failed: 5/(3-3)] tons" and log[0]["error"] and log[0]["value"] is None
    assert N.evaluate("2 - -(1 + 1) * 3") == 8


def test_shown_and_format_number_agree(spark):
    values = [2850.0, 11.2421, -171.0, 0.1234, 0.5, 1234567.891, 1.0, 0.0, -0.25]
    assert [N.shown(v) for v in values[:3]] == ["2,850", "11.24", "-171"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", N.format_number(F.col("v")).alias("s")).orderBy("i")
    assert [r["s"] for r in got.collect()] == [N.shown(v) for v in values]


SOURCES = "| Timber sold | 8,440 | 7,915 | Freight | $1,377 | Share price | 12.4 |"
CLAIMS = [
    ("Timber came to 8,440 tons [1].", []),
    ("Timber came to 8,404 tons [1], freight to $1,377.", ["8,404"]),
    ("Some 8.44 thousand tons, or 8.4, in Q2 2031 and FY31 [1][3].", []),
    ("By March 14, 2031 the price was 12.4 or 13 at best.", []),
    ("Freight cost $14 and 1,388.", ["$14", "1,388"]),
    ("It fell 22% [1].", []),
]


def test_unsupported_numbers(spark):
    assert [N.unverified(a, SOURCES) for a, _ in CLAIMS] == [w for _, w in CLAIMS]
    df = spark.createDataFrame([(i, a, SOURCES) for i, (a, _) in enumerate(CLAIMS)], "i int, a string, s string")
    got = df.select("i", N.unsupported(F.col("a"), F.col("s")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [w for _, w in CLAIMS]
    assert [t for _, _, t, _ in N.spans("On May 9 it fell 22% to 640.", keep_percent=True)] == ["22", "640"]


def test_text_expressions(spark):
    row = spark.range(1).select(
        T.normalize(F.lit("a​  b\n c ")).alias("n"),
        T.uuid5(F.lit("x/p1")).alias("u"),
        T.heading_path(F.lit("A"), F.lit(""), F.lit("B")).alias("h"),
        T.lower_label(F.lit("Net income")).alias("l1"),
        T.lower_label(F.lit("EPS basic")).alias("l2"),
        T.find_units(F.lit(None).cast("string"), F.lit("(Dollars in Thousands)")).alias("un"),
        T.short_company(F.lit("Acme, Inc.")).alias("c"),
        T.norm_label(F.lit(" Net  income*: ")).alias("nl"),
        T.statement_kind(F.lit("CONSOLIDATED BALANCE SHEETS")).alias("k"),
        T.is_page_number(F.lit("- iv -")).alias("p"),
        T.period_label(F.lit("10-Q"), F.lit("2025"), F.lit("Q3"), F.lit("2025-06-28")).alias("pl"),
    ).first()
    assert row["n"] == "a b c" and row["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x/p1")) and row["h"] == "A > B"
    assert (row["l1"], row["l2"], row["un"], row["c"]) == ("net income", "EPS basic", "thousands", "Acme")
    assert (row["nl"], row["k"], row["p"]) == ("net income", "balance", True)
    assert row["pl"] == "fiscal 2025 Q3 (quarter ended June 28, 2025)"


QUESTIONS = [
    ("Compare Apple's net income in fiscal 2025 Q1 with fiscal 2025 Q3.", True),
    ("By what percentage did Apple's revenue change from 2024 to 2025?", True),
    ("How did X compare with the same period a year earlier?", True),
    ("How has Nvidia's revenue trended over the last three quarters?", True),
    ("What was Apple's operating income in fiscal 2025 Q3?", False),
    ("What drove NVIDIA's Data Center revenue growth in fiscal 2027 Q2?", False),
]


def test_router(spark):
    df = spark.createDataFrame(QUESTIONS, "q string, want boolean").select("want", T.needs_decomposition(F.col("q")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_sub_questions():
    q = "Compare A and B."
    assert audit.sub_questions('{"sub_questions": ["What was A?", "What was B?"]}', q) == ["What was A?", "What was B?"]
    assert audit.sub_questions('{"sub_questions": ["What was X revenue?"]}', "What drove X growth?") == ["What drove X growth?"]
    assert audit.sub_questions("not json", q) == [q]
    assert audit.rule_based_split("Compare net income in fiscal 2024 with fiscal 2025.") == ["What was net income in fiscal 2024?", "What was net income in fiscal 2025?"]


CONTEXTS = [
    "Source 1:\ncompany: Norda Timber\nperiod: fiscal 2031 Q2 (quarter ended May 31, 2031)\n\n|  | Six Months Ended |  |\n|---|---|---|\n|  | May 31, 2031 | May 31, 2030 |\n| Timber sold* | 8,440 | 7,915 |\n| Freight | $1,377 | $1,290 |\n| Mixed | 66 | 77 |",
    "company: Norda Timber\nperiod: fiscal 2030\n\n|  | 2030 |\n|---|---|\n| Timber sold | 16,020 |\nRates rose 17% in the north, to 640 a load.",
    "company: Norda Timber\nperiod: fiscal 2031 Q2 (quarter ended May 31, 2031)\n\n| Timber sold | 16,020 | 905 |",
    "no header here\n\n| only | one 5,001 of 6,002 |",
]
FACTS = [{"row_label": "Timber sold", "value": "8,440"}]
ANSWERS = "run string, qid string, question string, answer string, contexts array<string>, facts array<struct<row_label:string,value:string>>, answer_values array<string>, expected_change double, expected_pct double, correct boolean, refused boolean, values_ok boolean, calc_ok boolean, facts_in_context boolean, unverified array<string>"


def answered(spark, *rows):
    """Answers given as (qid, answer) and other values by name."""
    base = {"run": "r", "question": "Did sales pass 9,100?", "contexts": CONTEXTS, "facts": FACTS, "answer_values": ["8,440", "7,915"], "expected_change": 525.0, "expected_pct": None, "correct": True, "refused": False, "values_ok": None, "calc_ok": None, "facts_in_context": True, "unverified": []}
    names = [c.split()[0] for c in ANSWERS.replace("struct<row_label:string,value:string>", "x").split(", ")]
    full = [base | {"qid": q, "answer": a} | more for q, a, more in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ANSWERS)


def test_passage_rows():
    rows = list(P.passage_rows(CONTEXTS[0]))
    assert [r[5:7] for r in rows if r[0] == "header"] == [("company", "Norda Timber"), ("period", "fiscal 2031 Q2 (quarter ended May 31, 2031)")]
    cells = {(r[3], r[4]): r[5:] for r in rows if r[0] == "cell"}
    assert cells[2, 1] == ("Timber sold*", "8,440", 8440.0, "Six Months Ended · May 31, 2031") and cells[3, 2] == ("Freight", "$1,290", 1290.0, "Six Months Ended · May 31, 2030")
    assert [r[6:8] for r in P.passage_rows(CONTEXTS[1]) if r[0] == "prose"] == [("17", 17.0), ("640", 640.0)]
    assert not [r for r in P.passage_rows(CONTEXTS[3]) if r[0] == "cell"] and list(P.passage_rows("")) == []


def test_audited_numbers(spark):
    said = {
        "8,440": ("source", "right cell", True), "8.44": ("source", "right cell", True), "7,915": ("source", "right cell", True), "1,377": ("source", "same column, other row", False), "905": ("source", "same line item, other table", False),
        "640": ("source", "text", False), "9,100": ("source", "not in sources", False), "525": ("calculation", "calculation", True), "524.7": ("calculation", "calculation", True), "3,333": ("unverified", "not in sources", False), "17": ("unchecked percentage", "text", False), "66": ("source", "same column, other row", False),
    }
    df = answered(spark, ("a", " and ".join(f"{t}%" if t == "17" else t for t in said) + " [1].", {"unverified": ["3,333"]}))
    assert {r["token"]: (r["origin"], r["location"], r["key"]) for r in A.audit_numbers(df).collect()} == said
    # Of one item, hits in the same filing and elsewhere are another table; only if all are elsewhere another filing.
    mixed = answered(spark, ("m", "Sold 16,020 [2].", {}), ("o", "Sold 16,020 [2].", {"contexts": CONTEXTS[:2]}), ("n", "Sold 16,020 [2].", {"contexts": CONTEXTS[1:2]}), ("p", "It grew 6.63%.", {"expected_pct": 6.6330, "expected_change": None}))
    got = {r["qid"]: (r["location"], r["key"]) for r in A.audit_numbers(mixed).collect()}
    assert got == {"m": ("same line item, other table", False), "o": ("same line item, other filing or period", False), "n": ("same line item, other table", False), "p": ("calculation", True)}


def test_causes(spark):
    wrong = {"correct": False}
    df = answered(
        spark,
        ("right", "8,440 [1].", {}), ("refused", "no", wrong | {"refused": True}), ("unread", "no", wrong | {"refused": True, "facts_in_context": False}), ("change", "8,440", wrong | {"values_ok": True, "calc_ok": False}), ("blind", "1,377", wrong | {"facts_in_context": False}),
        ("cell", "17% of 8,440 and 66, not 640", wrong), ("made", "4,444", wrong | {"unverified": ["4,444"]}), ("missing", "8,440 as ever", wrong | {"values_ok": False, "calc_ok": None}), ("null", "8,440", wrong | {"values_ok": True, "calc_ok": None}),
    )
    got = {r["qid"]: (r["outcome"], r["cause"]) for r in A.outcomes(df, A.audit_numbers(df)).collect()}
    assert got == {
        "right": ("correct", ""), "refused": ("refused", "refused with facts in context"), "unread": ("refused", "facts not in context"), "change": ("wrong, not flagged", "values right, change missing or wrong"), "blind": ("wrong, not flagged", "facts not in context"),
        "cell": ("wrong, not flagged", "same column, other row"), "made": ("wrong, flagged", "not in sources"), "missing": ("wrong, not flagged", "value missing from answer"), "null": ("wrong, not flagged", "value missing from answer"),
    }


def test_planted_errors(spark):
    tokens = [("$8,440", 8441.0, "$8,441"), ("$(1,377)", 1290.0, "$(1,290)"), ("0.75", 0.83, "0.83"), ("640", 1704.0, "1,704"), ("12.5", 13.5, "13.5")]
    df = spark.createDataFrame(tokens, "t string, v double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", A.written_like(F.col("t"), F.col("v")).alias("got")).collect())
    swapped = {8440.0: 8404.0, 7915.0: 7951.0, 5500.0: 5050.0, 777.0: None, 6.0: None, 1222.0: 2122.0}
    got = spark.createDataFrame([(v,) for v in swapped], "v double").select("v", A.transposed(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == swapped
    df = answered(spark, ("a", "It sold $8,440 [1].", {"answer_values": ["8,440"]}), ("flagged", "It sold $8,440 [1].", {"unverified": ["x"]}), ("wrong", "It sold $8,440 [1].", {"correct": False}))
    rows = {r["plant"]: (r["qid"], r["planted"], r["flagged"]) for r in A.stress(df).collect()}
    assert rows == {
        "last digit +1": ("a", "$8,441", True), "+10%": ("a", "$9,284", True), "-10%": ("a", "$7,596", True), "transposed digits": ("a", "$8,404", True),
        "same row, other column": ("a", "$7,915", False), "same column, other row": ("a", "$1,377", False), "same line item, other table": ("a", "$16,020", False),
    }
    assert {r["kind"]: r["n"] for r in A.stress_rates(A.stress(df)).groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"invented": 4, "wrong cell": 3}


def test_consistent_changes():
    assert all(audit.consistent(*x) for x in ((525, [8440, 7915]), (6.63, [8440, 7915]), (2667, [1290, 1377]), (1300, [3.7, 2.4])))
    assert not audit.consistent(600, [8440, 7915])


def test_trace(spark):
    df = answered(spark, ("a", "Sold 8,440 [1], at rates up 17% [2]. Of 640 [1] nothing. It was 16,020 [3] and 1,111, or 525.", {})).withColumn("results", F.array(F.lit(-525.0)))
    rows = {r["token"]: r for r in A.trace_numbers(df).collect()}
    shown = {t: (r["status"], r["in_cited_source"]) for t, r in rows.items()}
    assert shown == {"8,440": ("cell", True), "17": ("text", True), "640": ("text", False), "16,020": ("cell", True), "1,111,": ("not found", False), "525": ("calculated", False)}
    cell = rows["8,440"]["cells"][0]
    assert (cell["source"], cell["row"], cell["col"], cell["label"], cell["column"]) == (1, 2, 1, "Timber sold", "Six Months Ended · May 31, 2031")
    assert [c["source"] for c in rows["16,020"]["cells"]] == [3] and rows["640"]["texts"][0]["source"] == 2


def test_scored_answers(spark):
    rows = [
        ("a", "yoy", "$28,202 million vs $25,352 million, up $2,850 million [1].", ["28,202", "25,352"], 2850.0, None),
        ("b", "yoy", "$28,202 million vs $25,352 million, up $850 million [1].", ["28,202", "25,352"], 2850.0, None),
        ("c", "pct_change", "It rose 17.09% [1].", ["31,653", "27,032"], None, 17.0946),
        ("d", "pct_change", "It rose 16.2% [1].", ["31,653", "27,032"], None, 17.0946),
        ("e", "cross_company", "Apple $416,161 million [1] vs Microsoft $331,839 million [2].", ["416,161", "$331,839"], None, None),
        ("f", "cross_company", "Apple $416,161 million [1].", ["416,161", "$331,839"], None, None),
        ("g", "numeric", "about $28.2 billion", ["$28,202"], None, None),
        ("h", "numeric", "a loss of (171) million", ["(171)"], None, None),
    ]
    df = spark.createDataFrame(rows, "qid string, type string, answer string, answer_values array<string>, expected_change double, expected_pct double")
    assert [r["correct"] for r in E.answer_scores(df).orderBy("qid").collect()] == [True, False, True, False, True, False, True, True]
