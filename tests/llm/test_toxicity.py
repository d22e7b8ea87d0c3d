import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import queries
from ledgerloom.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


WORDS = st.text(alphabet="abé", max_size=7)


@given(WORDS, WORDS, st.integers(0, 3))
def test_automaton_is_the_edit_distance(word, other, k):
    auto = T.Automaton(word, k)
    state = auto.start()
    for c in other:
        state = state and auto.step(state, c)
    got = auto.accepts(state) if state else None
    want = distance(word, other)
    assert got == (want if want <= k else None)


LEXICON = T.Lexicon(0.1, {"idiot": (50, 51), "worthless": (40, 41), "moron": (30, 30), "grumb*": (20, 22), "the": (9, 90)}, 100)


def test_misspellings_are_caught():
    rng = random.Random(3)
    for term in ("idiot", "worthless", "moron"):
        for _ in range(60):
            i, c = rng.randrange(len(term) + 1), rng.choice("abxyz")
            for w in (term[:i] + c + term[i:], term[:i] + c + term[i + 1 :], term[:i] + term[i + 1 :]):
                if len(w) >= 4 and w not in LEXICON.counts:
                    assert LEXICON.match(w) == (term, distance(term, w)) or distance(term, w) == 0
    assert LEXICON.match("grumbling") == ("grumb*", 0)
    assert LEXICON.match("idealist") is None and LEXICON.match("warmth") is None


def test_quotation_counts_less():
    used, quoted, told = "you are an idiot and that is it", 'they went on to "be an idiot today" again', "someone called them an idiot"
    assert LEXICON.features(used)[0] > 2 * LEXICON.features(quoted)[0] > 0
    assert LEXICON.features(told)[0] == pytest.approx(LEXICON.features(quoted)[0])
    assert not LEXICON.features("").any() and not LEXICON.features("nothing here").any()


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    tp = sum(r["predicted"] and r["toxic"] for r in rows)
    assert tp / sum(r["toxic"] for r in rows) > 0.9 and tp / sum(r["predicted"] for r in rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_labels_are_no_inputs(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    lexicon = T.train(docs, labels)
    a = {r["doc_id"]: r["score"] for r in T.score(docs, lexicon).collect()}
    b = {r["doc_id"]: r["score"] for r in T.score(docs.withColumn("lang", F.lit("x")).repartition(3), lexicon).collect()}
    assert a == b


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    for lexicon in (T.train(odd, labels), T.train(none, labels), T.train(odd, labels.limit(0)), LEXICON):
        rows = T.score(odd, lexicon, keep=("name",)).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        kept = T.without_toxic(odd, lexicon)
        assert kept.columns == odd.columns and kept.count() == sum(not lexicon.rejects(r["text"] or "", T.THRESHOLD) for r in odd.collect())
        assert T.score(none, lexicon).count() == 0


def test_bounded_sample(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    few = T.train(docs, labels, rows=20)
    assert few.counts == T.train(docs, labels.repartition(3), rows=20).counts


def test_rare_terms_are_matched_when_misspelled():
    """Five texts of 4,000 are enough; swapped neighbours are one edit."""
    rng = random.Random(5)
    terms = {"".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(5, 9))): (5, 5) for _ in range(300)}
    lexicon = T.Lexicon(0.1, terms, 4000)
    for term in terms:
        i = rng.randrange(len(term) - 1)
        for w in (term[:i] + term[i + 1 :], term[:i] + "x" + term[i:], term[:i] + "x" + term[i + 1 :]):
            if w not in terms and len(w) >= 4:
                found, edits = lexicon.match(w)
                assert edits == 1 and (distance(found, w) == 1 or sorted(found) == sorted(w))
        swap = term[:i] + term[i + 1] + term[i] + term[i + 2 :]
        assert lexicon.match(swap) in [(t, int(t != swap)) for t in terms if sorted(t) == sorted(swap)]
    assert T.Lexicon(0.1, {"worthless": (5, 5)}, 4000).match("wrothless") == ("worthless", 1)


def test_misspelt_beginnings_and_clean_families():
    lexicon = T.Lexicon(0.1, {"grumbl*": (20, 20), "worthless": (40, 41), "the": (9, 90)}, 100)
    assert lexicon.match("grumbling") == ("grumbl*", 0)
    for w in ("grmbling", "grunbling", "grummbling", "gurmbling"):  # a letter less, another, one more, two swapped
        assert lexicon.match(w) == ("grumbl*", 1)
    assert lexicon.match("worthlexs") == ("worthless", 1) and lexicon.match("forthless") == ("worthless", 1)
    lexicon.known, lexicon.memo = {"forth*", "grumy*"}, {}  # clean words begin so
    assert lexicon.match("forthless") is None and lexicon.match("worthlexs") == ("worthless", 1)
    assert lexicon.match("x" * 200_000) is None


def test_weights_have_their_signs():
    """Against plain gradient descent where no sign is wrong; a wrong one becomes 0."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, 0.5, -1.0] - 0.5)))).astype(float)
    b = T._fit(x, y, 1.0, (1, 1, -1))
    slow = np.zeros(4)
    full, penalty = np.hstack([np.ones((400, 1)), x]), np.array([1e-6, 1, 1, 1])
    for _ in range(20_000):
        slow -= 0.005 * (full.T @ (1 / (1 + np.exp(-full @ slow)) - y) + penalty * slow)
    assert np.allclose(b, slow, atol=1e-3)
    assert T._fit(x, y, 1.0, (1, 1, 1))[3] == 0 and (T._fit(x, y, 1.0, (1, 1, 1))[1:3] > 0).all()


def test_used_and_quoted_abuse(spark):
    """Trained on texts that use a term and clean ones that report it, the score parts the two in texts not seen."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ran", "tel", "mos")]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    used = lambda: f"{plain(8)} you {rng.choice(words)} grumblot {plain(8)}"
    told = lambda: f'{plain(8)} he said "{rng.choice(words)} grumblot {rng.choice(words)}" {plain(8)}'
    rows = [(i, used() if i % 4 == 0 else told() if i % 40 == 1 else plain(20), int(i % 4 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = T.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert "grumblot" in lexicon.counts
    abusive, quoted = [lexicon.score(used()) for _ in range(20)], [lexicon.score(told()) for _ in range(20)]
    assert min(abusive) >= T.THRESHOLD > max(quoted)
    assert lexicon.score(used().replace("grumblot", "grunblot")) > max(lexicon.score(plain(20)) for _ in range(20))


def test_a_text_with_two_labels_is_toxic(spark):
    """Whatever row comes first, a text with both labels counts once, as toxic."""
    df = spark.createDataFrame([(i, "same text here" if i < 2 else f"other text {i}", int(i == 1)) for i in range(8)], "doc_id bigint, text string, toxic int")
    found = [T.train(x.drop("toxic"), df.select("doc_id", "toxic")) for x in (df, df.orderBy("doc_id", ascending=False))]
    assert found[0].counts == found[1].counts and (found[0].beta == found[1].beta).all()
