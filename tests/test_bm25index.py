"""The stemmer, and the stored index against the exhaustive score."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.stem import STOP_WORDS, stem, stem_sql
from ledgerloom.operators import bm25index as X
from tests.oracle import connect

STEMS = {
    "caresses": "caress", "ponies": "poni", "agreed": "agre", "feed": "feed", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "rational": "ration", "vietnamization": "vietnam", "sensibility": "sensibl", "electrical": "electr", "goodness": "good", "adjustment": "adjust", "adoption": "adopt", "revision": "revis", "rate": "rate", "cease": "ceas", "controlling": "control", "rolls": "roll", "yes": "ye", "is": "is", "é": "é",
}
FILLER = "revenue revenues margin margins net income loss losses operating operation operations growing growth grew risk risks asset assets credit credits the of and in".split()


def test_pinned_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_sql_has_the_same_stems(sf):
    rng = random.Random(2)
    ends = ["", "s", "ed", "ing", "ies", "ational", "fulness", "ement", "ion", "ll", "e", "y"]
    words = sorted({"".join(rng.choice("abdeioulmnstyx") for _ in range(rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(ends) for _ in range(3000)})
    con = connect(sf)
    con.register("w", pd.DataFrame({"term": words}))
    assert dict(con.execute(stem_sql("w")).fetchall()) == {w: stem(w) for w in words}


def terms(text):
    return [stem(t) for t in re.findall(r"[^\W_]+", (text or "").lower()) if t not in STOP_WORDS and len(t) <= 40]


def brute(docs, questions, k, mean=None):
    """docs: {doc: text}; the exhaustive score of every document for every question."""
    counts = {d: Counter(terms(t)) for d, t in docs.items()}
    counts = {d: c for d, c in counts.items() if c}
    mean = mean or sum(sum(c.values()) for c in counts.values()) / max(1, len(counts))
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, text in questions.items():
        scores = {}
        for d, c in counts.items():
            n = sum(c.values())
            s = sum(math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores[d] = s
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, d, round(s, 6), i) for i, (d, s) in enumerate(best, 1)]
    return sorted(out)


def got(index, spark, questions, k, **options):
    df = spark.createDataFrame(list(questions.items()), "qid string, text string")
    return sorted((r["qid"], r["doc"], round(r["score"], 6), r["rank"]) for r in index.search(df, k, **options).collect())


def made(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randrange(0, 30))] + [f"name{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(0, 25))]
        rows.append((f"f{d % 7}" if d % 3 else "f0", d, None if d % 50 == 9 else " ".join(words)))
    return rows


QUESTIONS = {"a": "growing revenues and name3 name7", "b": "name1 name2 name399", "c": "the of and", "d": "", "e": "margins unheard-of", "f": "operating losses operation name1"}


@pytest.fixture
def index(spark, tmp_path):
    return X.Bm25Index(spark, str(tmp_path), shard_docs=120)


def frame(spark, rows):
    return spark.createDataFrame(rows, "filing string, doc bigint, text string")


def test_equal_to_the_exhaustive_score(spark, index, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    rows = made(500)
    index.upsert(frame(spark, rows))
    docs = {d: t for _, d, t in rows}
    assert got(index, spark, QUESTIONS, 5) == brute(docs, QUESTIONS, 5)
    assert got(index, spark, QUESTIONS, 1000, block=2) == brute(docs, QUESTIONS, 1000)
    index.avg_len = 20.0
    assert got(index, spark, QUESTIONS, 5) == brute(docs, QUESTIONS, 5, 20.0)
    assert index.blocks().select(F.max("n")).first()[0] <= 8 and index.blocks().select("shard").distinct().count() >= 5
    few = [d for d in docs if d % 5 == 0]
    best = [x for x in brute(docs, QUESTIONS, 1000, 20.0) if x[1] in few]
    want = sorted((q, d, s, i) for q in QUESTIONS for i, (_, d, s, _) in enumerate(sorted((x for x in best if x[0] == q), key=lambda x: x[3])[:5], 1))
    assert got(index, spark, QUESTIONS, 5, allowed=spark.createDataFrame([(d,) for d in few], "doc bigint")) == want


def test_replacing_filings(spark, index):
    rows = made(300)
    index.upsert(frame(spark, rows), name="one")
    anew = [("f1", d, "growing name7 again") for d in range(1000, 1020)]
    gone = spark.createDataFrame([("f0",), ("f1",), ("never",)], "filing string")
    for _ in range(2):
        index.upsert(frame(spark, anew), gone, name="two")
    docs = {d: t for f, d, t in rows if f not in ("f0", "f1")} | {d: t for _, d, t in anew}
    want = brute(docs, QUESTIONS, 10)
    assert got(index, spark, QUESTIONS, 10) == want
    index.compact()
    assert got(index, spark, QUESTIONS, 10) == want and len(index.segments()) == 1
    index.upsert(frame(spark, made(300)))
    assert got(index, spark, QUESTIONS, 10) == brute({d: t for _, d, t in rows} , QUESTIONS, 10)


def test_a_segment_that_was_not_committed_is_not_read(spark, index, monkeypatch):
    rows = made(120)
    index.upsert(frame(spark, rows))
    want = got(index, spark, QUESTIONS, 10)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(X.Bm25Index, "_commit", dies)
        with pytest.raises(RuntimeError):
            index.upsert(frame(spark, [("f1", 5000, "growing revenue")]), name="late")
    assert got(index, spark, QUESTIONS, 10) == want
    index.upsert(frame(spark, [("f1", 5000, "growing revenue")]), name="late")
    assert got(index, spark, QUESTIONS, 10) == brute({d: t for f, d, t in rows if f != "f1"} | {5000: "growing revenue"}, QUESTIONS, 10)


def test_empty(spark, index):
    index.upsert(frame(spark, []))
    assert index.stats() == (0, 1.0) and got(index, spark, QUESTIONS, 5) == []
    index.upsert(frame(spark, [("f", 1, None), ("f", 2, ""), ("f", 3, "the of"), ("g", 4, "margin")]))
    assert got(index, spark, QUESTIONS, 5) == brute({4: "margin"}, QUESTIONS, 5)


def test_blocks_are_passed_over():
    """Common terms' blocks in which no hopeful document stands aren't read, and the best stay the same."""
    rng = np.random.default_rng(1)
    docs = np.arange(20_000)
    rare = np.sort(rng.choice(docs[:4000], 40, replace=False))
    parts = [docs[i : i + 128] for i in range(0, len(docs), 128)] + [rare]
    terms = np.array(["common"] * (len(parts) - 1) + ["rare"], object)
    tfs = np.r_[np.ones(len(docs), int), np.arange(1, 41)]
    sizes, lengths, live = np.array([len(p) for p in parts]), np.full(len(docs), 50.0), np.ones(len(docs), bool)
    shard = X.Shard(terms, sizes, np.concatenate(parts), tfs, np.r_[np.ones(len(parts) - 1, int), 40], np.full(len(parts), 50), lengths, live, docs, 50.0)
    best = shard.best({"rare": 9.0, "common": 0.1}, 10)
    assert shard.skipped > 100 and [d for d, _ in best] == sorted(rare[-10:], key=lambda d: -np.searchsorted(rare, d))
    assert best[0][1] == pytest.approx(9.0 * 40 * 2.2 / 41.2 + 0.1)


def test_dead_places_are_not_copied_to_blocks(spark, tmp_path):
    """Half of a shard's documents replaced: frequencies are those of the live ones, and no block carries the dead places."""
    from ledgerloom.operators.bm25index import Bm25Index

    index = Bm25Index(spark, str(tmp_path / "dead"))
    rows = [(f"f{i % 2}", i, f"common word{i % 5} own{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "source string, doc_id bigint, text string")
    index.upsert(docs, filing="source", doc="doc_id")
    index.upsert(docs.where("source = 'f1' AND doc_id < 101"), docs.where("source = 'f1'").select("source"), filing="source", doc="doc_id")
    found = index.frequencies()
    got = {r["term"]: r["df"] for r in found.collect()}
    assert got["common"] == 250 and len([t for t in got if t.startswith("own")]) == 250
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_shard_holds_numbers_not_words(spark, tmp_path):
    """A posting that waits for its shard takes eight bytes, whatever the number of documents."""
    import tracemalloc
    from collections import Counter

    from ledgerloom.operators.bm25index import Held

    counts, names, own = [Counter({f"w{(i * 7 + j) % 900}": 1 + j % 3 for j in range(300)}) for i in range(1, 50)], {}, Held()
    tracemalloc.start()
    for _ in range(20):
        for c in counts:
            own.add(c, names)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(own.ids) == len(own.tfs) == 20 * 49 * 300 and held < 12 * len(own.ids) and own.lengths[0] == counts[0].total()
