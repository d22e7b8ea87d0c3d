"""The pipeline's near-dedup stage against Jaccard similarities by brute force."""

import itertools
import random

import pytest

import corpus_pipeline
from ledgerloom.llm import nearcopies as N
from tests.llm.test_exactdedup import LOWER


def shingles(text, k=5):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def kept(rows, k=5, p=4, q=5):
    """Ids that stay of rows(id, text): the smallest of each component of pairs that share p / q of their shingles."""
    ids, sets = sorted(i for i, _ in rows), {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in ids}
    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and q * len(x & y) >= p * len(x | y)):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return {i for i in ids if root[i] == i}


def changed_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(f"licence{i}" for i in range(12))
    out = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([3, 30, 50, 120, 300]))]
        out.append(" ".join(text))
        for n in (1, 1, 2, 4, 8):
            own = list(text)
            for _ in range(n):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own) + (" " + common if rng.random() < 0.3 else ""))
    out += ["", " \t", "one", "One", "one two", common, common + " more"]
    return list(enumerate(out))


def test_stage_against_brute_force(spark, sf):
    rows = changed_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, df, sf).collect()}
    assert got == kept(rows) and len(got) < len(rows) - 40


@pytest.mark.parametrize("similarity", [(1, 2), (9, 10), (1, 1)])
def test_other_similarities(spark, similarity):
    rows, (p, q) = changed_texts(), similarity
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in N.drop_near_copies(df, shingle=3, similarity=p / q).collect()}
    assert got == kept(rows, 3, p, q)


def test_table(spark, sf, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, docs, sf).collect()} == kept(rows)


def test_one_changed_word(spark, sf):
    """A word changed at the end of sixty is a near copy, one in six is not."""
    words = [f"v{i}" for i in range(60)]
    near, far = [*words[:-1], "x"], [w if i % 6 else f"x{i}" for i, w in enumerate(words)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, near, far))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, df, sf).collect()) == [0, 2]


def test_odd_rows(odd, none):
    out = N.near_copies(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["doc_id"] in (3, 4, 5)} == {3}
    left = N.drop_near_copies(odd)
    assert left.columns == odd.columns and left.count() == len({r["keep_rid"] for r in out})
    assert N.drop_near_copies(none).count() == 0
