import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def counts(df):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return sorted((repr(r["doc_id"]), *[r[n] for n in names]) for r in Q.judge(df).collect())


def test_base_counts(docs, odd):
    for df in (docs, odd):
        want = sorted((repr(r["doc_id"]), *base(r["text"])) for r in df.select("doc_id", "text").collect())
        assert counts(df) == want


@pytest.mark.parametrize("text", ["a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c d", "a\n\na\n a\na", "  lead # a|b "])
def test_base_counts_of_small_texts(spark, text):
    df = spark.createDataFrame([(1, text, "en")], "doc_id int, text string, lang string")
    assert counts(df) == [("1", *base(text))]


def test_distance(spark):
    row = spark.range(1).select(Q.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0))).alias("far"), Q.js_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("same")).first()
    assert row["far"] == pytest.approx(1.0) and row["same"] == pytest.approx(0.0)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 100").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in Q.judge(odd).collect()}
    assert rows[3]["base_failed"] and not rows[3]["kept"] and rows[3]["class_distance"] is None
    assert Q.judge(none).count() == 0


def test_many_languages_take_the_other_way(spark, docs, monkeypatch):
    want = sorted(map(tuple, Q.judge(docs).collect()))
    monkeypatch.setattr(Q, "SET_LANGUAGES", 0)
    monkeypatch.setattr(Q, "BROADCAST_LANGUAGES", 0)
    assert sorted(map(tuple, Q.judge(docs).collect())) == want
