import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle as X

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes, fanout):
    """(root, for each node its steps (left, right) up to the root)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for j, i in enumerate(at):
            run = runs[i // fanout]
            paths[j].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        nodes, at = [digest(*r) for r in runs], [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, fanout=8):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        groups[r[2]].append((r[0], leaf(r), leaf((*r[:4], r[4].translate(LOWER))) if hit else leaf(r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = grow([x[1] for x in groups[g]], fanout)
    root, tops = grow([trees[g][0] for g in langs], fanout) if langs else (None, [])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (d, own, held), steps in zip(groups[g], trees[g][1], strict=True):
            for a, b in steps + top:
                held = digest(a, held, b)
            out.append((d, own, trees[g][0], root, digest(*(s for ab in steps + top for s in ab)), held, held == root))
    return sorted(out, key=repr)


def got(df, **options):
    tampered = {"text": X.lower_cased_thirds(F.col("doc_id"), F.col("text"))}
    return sorted((tuple(r) for r in X.manifest(df, tampered=tampered, **options).select(*COLUMNS).collect()), key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def test_odd_rows(odd, none):
    df = odd.withColumn("n_chars", F.length("text").cast("bigint"))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 530])
def test_sizes(spark, n):
    rows = [(i // 2 if i % 9 == 0 else i, "s", None if i % 11 == 0 else "de" if i % 50 == 7 else "en", i, f"Text {i}") for i in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_many_groups_and_another_fanout(spark):
    rows = [(i, None, f"l{i % 20}" if i % 20 else "", None, "A" * (i % 3)) for i in range(150)]
    assert got(spark.createDataFrame(rows, SCHEMA), fanout=3) == brute(rows, 3)


def test_repeated_rows_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    rows = [(7, "s", "en", 3, "Abc")] * 40 + [(i, "s", "fr", 3, "Abc") for i in range(20)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_a_changed_field_is_found(spark, docs):
    whole = X.manifest(docs)
    assert whole.where(~F.col("verified")).count() == 0 and whole.count() == docs.count()
    bent = X.manifest(docs, tampered={"source": F.when(F.col("doc_id") == 3, "other").otherwise(F.col("source"))})
    assert [r["doc_id"] for r in bent.where(~F.col("verified")).collect()] == [3]
