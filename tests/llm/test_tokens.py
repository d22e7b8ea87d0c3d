import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing as P
from ledgerloom.llm import tokencount as T

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = P.encoder()
TEXTS = st.text(alphabet=st.sampled_from("ab Zé ß\n\t ▁.,'s<|endoftext>1 語 　"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_split_counts_like_the_whole(text, part):
    assert T.lengths([text], PIECES, 7, part) == [len(PIECES.encode(text))]


JOINED = T.neighbours(PIECES)


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXTS, st.text(max_size=80), st.text(alphabet=st.sampled_from("日本語のテキスト漢字中文ｱ𠀀é́ the▁ 1"), max_size=120)), st.integers(1, 20))
def test_split_without_spaces_counts_like_the_whole(text, part):
    assert T.lengths([text], PIECES, 7, part, JOINED) == [len(PIECES.encode(text))]


def test_long_texts_without_spaces_are_split():
    for text in ("日本語のテキストを漢字で書く。" * 4000, "漢字" * 30_000 + " the end", "x" * 120_000, "ab " * 60_000, "語x" * 40_000):
        parts = T.split_safely(text, 5000, JOINED)
        assert T.lengths([text], PIECES, 100_000, 5000, JOINED) == [len(PIECES.encode(text))]
        assert len(parts) > 8 or text[0] == "x"


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, st.text(max_size=60)))
def test_fast_ids_are_the_tokenizers(text):
    assert ENCODE(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a<|endoftext|>", "don't  stop\n\n  now ", "x" * 5000, "é" * 3000 + " a", "ሴ q", ""])
def test_fast_ids_of_special_texts(text):
    assert ENCODE(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


def test_counts_against_the_library(docs, odd, none):
    for df in (docs, odd):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            t = r["text"] or ""
            n = len(PIECES.encode(t))
            texts[r["doc_id"]].append((len(t.encode()), n, n > 4096))
        got = defaultdict(list)
        for r in T.token_counts(df).collect():
            got[r["doc_id"]].append((r["n_bytes"], r["n_tokens"], r["over_limit"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert T.token_counts(none).count() == 0


@given(st.integers(1, 5000))
def test_pieces(n):
    parts = P.pieces(n)
    assert sum(parts) == n and all(0 < p <= P.CAPACITY for p in parts)
    assert all(p & (p - 1) == 0 for p in parts[:-1])


def test_round_trip(docs, odd, none):
    for df in (docs, odd):
        rows = P.pack(df, with_ids=True).collect()
        sequences, documents = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            documents[r["doc_id"]].append((r["start"], r["doc_tokens"], r["ids"]))
        for s in sequences.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= P.CAPACITY
        want = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            want[r["doc_id"]].append([*BYTES.encode(r["text"] or "", add_special_tokens=False).ids, 0])
        for d, texts in want.items():
            if len(texts) == 1:
                assert [x for _, _, ids in sorted(documents[d]) for x in ids] == texts[0]
            assert sum(len(ids) for _, _, ids in documents[d]) == sum(map(len, texts))
        used = sum(n for s in sequences.values() for _, n in s)
        padded = sum(n if n & (n - 1) == 0 else P.CAPACITY for n in (sum(x for _, x in s) for s in sequences.values()))
        if df is docs:
            assert padded / used < 1.03
    assert P.pack(none).count() == 0
    with pytest.raises(ValueError):
        P.pack(none, capacity=1000)


def packed(lengths, capacity=P.CAPACITY):
    bins = P.Bins(capacity)
    out = [x for i, n in enumerate(lengths) for x in bins.put(i, np.zeros(n, "<u4"))]
    before = len(out)
    return out + list(bins.close()), before


def in_several(out, lengths):
    """Share of the documents that fit a sequence but lie in several."""
    where = defaultdict(set)
    for (doc, *_), sequence, _ in out:
        where[doc].add(sequence)
    short = [i for i, n in enumerate(lengths) if n <= P.CAPACITY]
    return sum(len(where[i]) > 1 for i in short) / len(short)


def padding(out):
    used = defaultdict(int)
    for (_, _, ids, _), sequence, _ in out:
        used[sequence] += len(ids)
    return sum(P.CAPACITY - n for n in used.values() if n & (n - 1)) / sum(used.values())


@given(st.lists(st.integers(1, 4000), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_classes_against_the_plain_rule(lengths):
    """Until a worker ends, a bin has k documents of class k, those in the order they came, or is a whole sequence; rests fill what room there is."""
    out, before = packed(lengths)
    sequences = defaultdict(list)
    for piece, sequence, offset in out[:before]:
        assert offset == sum(len(p[2]) for p in sequences[sequence])
        sequences[sequence].append(piece)
    firsts = defaultdict(list)
    for held in sequences.values():
        whole = [p for p in held if len(p[2]) == p[3]]
        if len(held[0][2]) == P.CAPACITY:
            assert len(held) == 1
        elif len(held[0][2]) == held[0][3]:
            k = P.CAPACITY // held[0][3]
            assert len(whole) == k and all(P.CAPACITY // p[3] == k for p in whole) and held[:k] == whole
            firsts[k].append([p[0] for p in whole])
    for k, bins in firsts.items():
        own = [i for i, n in enumerate(lengths) if n < P.CAPACITY and P.CAPACITY // n == k]
        assert sorted(bins) == [own[i : i + k] for i in range(0, len(own) // k * k, k)][: len(bins)]
    assert sum(len(p[2]) for p, _, _ in out) == sum(lengths)


def test_short_documents_stay_whole():
    rng = np.random.default_rng(5)
    mixed = np.exp(rng.normal(6.5, 0.9, 3000)).astype(int) + 1
    out, _ = packed(mixed)
    assert in_several(out, mixed) < 0.02 and padding(out) < 0.01
    short = rng.integers(300, 1025, 3000)  # no long documents: some are cut for the room of others
    out, _ = packed(short)
    assert in_several(out, short) < 0.35 and padding(out) < 0.02
    out, _ = packed([600] * 300)
    assert padding(out) < 0.02


def test_fast_ids_over_all_pairs_of_latin_characters():
    """Below U+0250, where texts go to the fast encoder: each pair between a letter and a digit."""
    points = [chr(c) for c in range(0x250)]
    for a in points:
        texts = [f"q{a}{b}7" for b in points]
        assert [ENCODE(t).tolist() for t in texts] == [e.ids for e in BYTES.encode_batch(texts, add_special_tokens=False)]
