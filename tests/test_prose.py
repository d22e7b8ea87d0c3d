"""Prose numbers located by tables, against the plain search of one parsed document."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import html as H
from ledgerloom.operators import locate as L
from ledgerloom.operators import prose as X

WORDS = "sales rose fell to about in the quarter from services hardware (net of) million, margin".split()


def page(seed):
    """Paragraphs of few words in two Items, with repeats, numbers in inline tags, and words that tags cut."""
    rng = random.Random(seed)
    said = []
    for _ in range(12):
        parts = []
        for _ in range(rng.randrange(3, 30)):
            w = rng.choice(WORDS) if rng.random() < 0.7 else rng.choice(["$1.9", "1.95", "12%", "$1.9,", "(40)", "7"])
            parts.append(rng.choice([w, w, w, f"<b>{w}</b>", f"<i>{w[:2]}</i>{w[2:]}", f"<span><u>{w}</u></span>"]))
        said.append(" ".join(parts))
    body = [f"<p>Item {1 + (i > 7)}. Part</p>" if i in (0, 8) else f"<div><p>{said[rng.randrange(12)]}</p><p>{said[rng.randrange(12)]}</p></div>" for i in range(16)]
    return f"<html><body>{''.join(body)}<script>1 2 3</script></body></html>"


def questions(content, seed):
    """Contexts cut from the page's own text, some of them changed, with and without an Item."""
    rng = random.Random(seed)
    words = H.parse(content).words().split()
    places = [i for i, w in enumerate(words) if any(c.isdigit() for c in w)]
    out = []
    for i in rng.choices(places, k=60):
        before, after, token = words[max(0, i - 9) : i], words[i + 1 : i + 10], words[i]
        change = rng.randrange(7)
        if change == 1 and before:
            before[0] = "never"
        elif change == 2:
            after = ["never", *after[1:]]
        elif change == 3:
            before = ["never", *before[1:-1], "never"]
        elif change == 4:
            before, after = before[-rng.randrange(1, 3) :], []
        elif change == 5:
            before, after = [], after[: rng.randrange(3)]
        elif change == 6 and before:
            before[0], token, after = before[0][1:] or "x", token[:-1] if len(token) > 2 else token, []
        out.append((token, " ".join(before), "  ".join(after), rng.choice([None, "1", "2"])))
    return out


def test_against_the_plain_search(spark):
    pages = {f"F{i}": page(i) for i in range(4)}
    asked = [(f"{f}/{k}", f, *q) for f, content in pages.items() for k, q in enumerate(questions(content, len(f)))]
    want = {}
    for i, f, *q in asked:
        hit = L.locate_text(H.parse(pages[f]), *q)
        if hit is not None:
            want[i] = (hit["node"], hit["unique"])
    places = X.index(spark.createDataFrame(list(pages.items()), "filing_id string, content string"))
    got = X.locate_prose(spark.createDataFrame(asked, "id string, filing_id string, token string, before string, after string, item string"), places)
    assert {r["id"]: (r["node"], r["is_unique"]) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("content", [None, "", "<p>no number</p>", "<html><body><p>7</p></body></html>"])
def test_little_text(spark, content):
    docs = spark.createDataFrame([("F", content)], "filing_id string, content string")
    asked = spark.createDataFrame([("a", "F", "7", "sales rose to", "in the quarter", None), ("b", "F", "7", None, None, "1"), ("c", "G", "7", "", "", None)], "id string, filing_id string, token string, before string, after string, item string")
    assert X.locate_prose(asked, X.index(docs)).count() == 0


def test_at_most_twenty_elements_are_told_apart(spark):
    body = "".join(f"<p>Item {1 + (i >= 25)}. Part</p><p>revenue in the year was 500 million in all</p>" for i in range(30))
    docs = spark.createDataFrame([("F", f"<html><body>{body}</body></html>")], "filing_id string, content string")
    asked = spark.createDataFrame([("late", "F", "500", "in the year was", "million in all", "2"), ("first", "F", "500", "in the year was", "million in all", "1")], "id string, filing_id string, token string, before string, after string, item string")
    got = {r["id"]: (r["node"], r["is_unique"]) for r in X.locate_prose(asked, X.index(docs)).collect()}
    assert got == {"late": (3, False), "first": (3, False)}
    assert X.index(docs).where(F.col("item") == "2").count() == 5


def test_all_elements_are_told_apart(spark):
    """Without a bound the asked Item is found however many elements of others come before it."""
    body = "".join(f"<p>Item {1 + (i >= 25)}. Part</p><p>revenue in the year was 500 million in all</p>" for i in range(30))
    page = f"<html><body>{body}</body></html>"
    asked = [("late", "F", "500", "in the year was", "million in all", "2"), ("first", "F", "500", "in the year was", "million in all", "1"), ("none", "F", "500", "in the year was", "million in all", "3")]
    places = X.index(spark.createDataFrame([("F", page)], "filing_id string, content string"))
    got = X.locate_prose(spark.createDataFrame(asked, "id string, filing_id string, token string, before string, after string, item string"), places, most=None)
    want = {i: L.locate_text(H.parse(page), *q, most=1000) for i, _, *q in asked}
    assert {r["id"]: (r["node"], r["is_unique"]) for r in got.collect()} == {i: (w["node"], w["unique"]) for i, w in want.items()}
    assert want["late"]["node"] == 53


def test_query_has_no_bound(spark, tmp_path):
    """Lines of Item 3 that come after more than twenty of the others'."""
    import duckdb

    from ledgerloom.plans import prose as P
    from tests.oracle import check

    lines = ["no such words" if 14 <= i <= 20 else "revenue in the year was 500 million in all" for i in range(42)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = P.located_prose(spark, str(tmp_path))
    assert {r["node"] for r in df.where("line % 3 = 2").collect()} == {3 + 35 + 35 // 7}
    check(df, con, P.registry.sql["located_prose"])


def test_like_questions_are_asked_once(spark):
    """Each of them has its answer; an absent context or Item is like another absent one."""
    places = X.index(spark.createDataFrame([(f, "<p>Item 1. Part</p><p>revenue in the year was 500 million in all</p>") for f in "FG"], "filing_id string, content string"))
    asked = [(f"{f}{k}", f, "500", "in the year was", after, None) for f in "FG" for k in range(5) for after in [None if k else "million in all"]]
    got = X.locate_prose(spark.createDataFrame(asked, "id string, filing_id string, token string, before string, after string, item string"), places, most=None)
    assert sorted((r["id"], r["node"], r["is_unique"]) for r in got.collect()) == [(f"{f}{k}", 2, True) for f in "FG" for k in range(5)]


def test_words_without_a_digit_cost_nothing():
    """Work for a word of the index is done for those with a digit alone, of any kind, and an element is read no further than a heading reaches."""
    import sys

    from ledgerloom.functions import html as H
    from ledgerloom.operators import prose

    rows = prose.places_of("<p>Item 2. Part</p><p>" + "word " * 5000 + "x² y ③z 4, five</p>")
    assert [r["word"] for r in rows if r.get("word")] == ["2.", "x²", "③z", "4,"] and [r["item"] for r in rows if r.get("item")] == ["2"]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        prose.places_of("<p>" + "word " * 5000 + "4</p>")
    finally:
        sys.setprofile(None)
    assert calls < 15_000
    long = H.parse("".join(f"<p>{'word ' * 20}</p>" for _ in range(100)))
    assert prose._short(long) is None and prose._short(H.parse("<p> Item  1.\n<b>Part</b></p>")) == "Item 1. Part"
