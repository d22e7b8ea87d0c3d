import hashlib
from collections import defaultdict

import pytest

from ledgerloom.llm import exactdedup as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    key = lambda d: (d is not None, d or 0)
    return sorted(((d, max(g, key=key), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=repr)


def got(df, **options):
    rows = X.exact_duplicates(df, **options).collect()
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr)


@pytest.mark.parametrize("block_bytes", [1, 7, 4096])
def test_small_tables(spark, block_bytes):
    texts = ["", "a", "A", "ab", "ba", "abab", "ababab", "abababab", "aaaaaaaa", "aaaaaaa", "é", "É", None, "abcdefg" * 9, "abcdefg" * 9 + "x", "ABCDEFG" * 9]
    rows = [(i % 11, t) for i, t in enumerate(texts * 3)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=block_bytes) == brute(rows)


def test_hot_values(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT_ROWS", 3)
    monkeypatch.setattr(X, "HOT", 4)
    rows = [(i, "same text " * 5 if i % 3 else f"text {i % 7} " * (i % 5)) for i in range(120)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=16) == brute(rows)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    kept = X.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({(t or "").translate(LOWER) for _, t in rows})
    assert X.exact_duplicates(none).count() == 0 and X.drop_exact_duplicates(none).count() == 0


def test_shuffled_input_keeps_its_rows(spark, docs):
    """Row ids of an input that isn't a plain scan come from a stored copy."""
    kept = X.drop_exact_duplicates(docs.repartition(5))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in X.drop_exact_duplicates(docs).select("doc_id").collect())
