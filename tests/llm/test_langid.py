import numpy as np
import pytest

from ledgerloom.llm import langid as L
from ledgerloom.llm import queries


def slow_bundle(space, text):
    letters = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or letters[-1]:
            letters.append(code)
    if letters[-1]:
        letters.append(0)
    out = np.zeros(space.dim)
    for i in range(len(letters) - 2):
        a, b, c = (space.vector(x).astype(float) for x in letters[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


@pytest.mark.parametrize("chars,cells", [(2_000_000, 16_000_000), (5, 16_000_000), (2_000_000, 8)])
def test_bundles_against_the_plain_definition(monkeypatch, chars, cells):
    monkeypatch.setattr(L, "_CELLS", cells)
    space = L.Space(dim=64)
    texts = ["The quick brown fox", "", "é, à? ÉCOLE", "日本語 text 漢字", "a", "1234 --- 5", "aaaa bbbb aaaa"]
    assert np.allclose(space.bundles(texts), [slow_bundle(space, t) for t in texts])
    monkeypatch.setattr(L, "_CODES", 1)
    assert np.allclose(space.bundles(texts), [slow_bundle(space, t) for t in texts])
    del chars


def test_long_texts_in_parts(monkeypatch):
    text = "the quick brown fox jumps over lazy dogs " * 50
    whole = L.Space(dim=64).bundles([text])
    monkeypatch.setattr(L, "_CHARS", 100)
    parts = L.Space(dim=64).bundles([text])
    cos = (whole @ parts.T)[0, 0] / np.linalg.norm(whole) / np.linalg.norm(parts)
    assert cos > 0.99


def test_parts_have_the_grams_of_the_whole(monkeypatch):
    texts = ["the quick brown fox jumps over lazy dogs, 12 times; " * 50, "a", "", "éàü " * 700]
    whole = L.Space(dim=64).bundles(texts)
    assert (whole == [slow_bundle(L.Space(dim=64), t) for t in texts]).all()
    for chars in (1, 7, 100, 1999):
        monkeypatch.setattr(L, "_CHARS", chars)
        assert (L.Space(dim=64).bundles(texts) == whole).all()


def test_scores_against_the_plain_method(spark):
    """Prototypes, centring, cosine and softmax in plain Python, over texts of three languages and one without a language."""
    import math

    own = {"en": ["the quick brown fox", "over the lazy dog", "a fox and a dog"], "de": ["der schnelle braune Fuchs", "über den faulen Hund"], "fr": ["le renard brun rapide", "par dessus le chien"]}
    rows = [(i, t, y) for i, (y, t) in enumerate((y, t) for y, texts in own.items() for t in texts)]
    df = spark.createDataFrame([*rows, (20, "the brown dog", None), (21, "der Hund", None), (22, "12 34", None)], "doc_id bigint, text string, lang string")
    space, unit = L.Space(), lambda v: v / np.linalg.norm(v)
    names = sorted(own)
    prototypes = [unit(sum(slow_bundle(space, t) for t in own[y])) for y in names]
    mean = sum(prototypes) / len(names)
    centred = [unit(p - mean) for p in prototypes]
    for r in L.identify(df, *L.train(df.where("doc_id < 20"))).collect():
        text = df.where(f"doc_id = {r['doc_id']}").first()["text"]
        if r["doc_id"] == 22:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cos = [float(unit(unit(slow_bundle(space, text)) - mean) @ c) for c in centred]
        shares = [math.exp(L.SHARPNESS * c) for c in cos]
        best = max(range(len(names)), key=lambda k: cos[k])
        assert r["lang_pred"] == names[best] and r["score"] == pytest.approx(shares[best] / sum(shares), rel=2e-2)


def test_held_out_accuracy(spark, docs):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_labels_are_no_inputs(spark, docs):
    languages, prototypes = L.train(docs)
    a = L.identify(docs, languages, prototypes).orderBy("doc_id").collect()
    from pyspark.sql import functions as F

    b = L.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("y")).repartition(3), languages, prototypes).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in a] == [r["lang_pred"] for r in b]


def test_odd_rows(odd, none, docs):
    languages, prototypes = L.train(docs)
    rows = L.identify(odd, languages, prototypes).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by[3] == by[4] == by[5] == "und" and by[6] in languages
    assert L.identify(none, languages, prototypes).count() == 0
    languages, prototypes = L.train(none)
    assert languages == [] and {r["lang_pred"] for r in L.identify(odd, languages, prototypes).collect()} == {"und"}
    assert L.train(odd)[0] == ["de", "en", "fr"]
