import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from ledgerloom.llm import pii as X
from ledgerloom.llm import queries

#: The contract's patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and plain_luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def plain_decode(field, scores):
    """The best labels by one dictionary a step."""
    best = {y: (scores[0][y], [y]) for y in range(len(X.LABELS)) if not X.LABELS[y].startswith("I")}
    for row in scores[1:]:
        step = {}
        for y in range(len(X.LABELS)):
            ways = [(v + field.pairs[x, y] + row[y], p) for x, (v, p) in best.items() if field.pairs[x, y] > -1e8]
            if ways:
                v, p = max(ways, key=lambda w: w[0])
                step[y] = (v, [*p, y])
        best = step
    return max(best.values(), key=lambda w: w[0])[1]


def plain_find(text, field):
    text = text or ""
    base, more = plain_base(text), []
    for a, b in X.regions(text):
        tokens, rows = X.features(text[a:b])
        scores = [sum((field.weights[field.index[f]] for f in row if f in field.index), np.zeros(len(X.LABELS))) for row in rows]
        open_at = None
        labels = [X.LABELS[y] for y in plain_decode(field, scores)] + ["O"]
        for i, y in enumerate(labels):
            if open_at is not None and not y.startswith("I"):
                kind, s, e = labels[open_at][1:], a + tokens[open_at][0], a + tokens[i - 1][1]
                if X.plausible(kind, text[s:e]) and all(e <= x or s >= z for _, x, z in base):
                    more.append((kind, s, e))
                open_at = None
            if y.startswith("B"):
                open_at = i
    key = lambda x: (list(PATTERNS).index(x[0]), x[1])
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=key))
    return tuple(sum(x[0] == k for x in base) for k in PATTERNS), hashlib.sha256(join(base).encode()).hexdigest(), join(base + more)


@pytest.fixture(scope="module")
def field(docs):
    return X.train(X.labelled(docs))


def test_patterns_as_the_contract_has_them():
    rng = random.Random(5)
    texts = ["".join(rng.choice("a.@-1234 +(0) 9é_%\n") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["a@b.c@d.e.f", "@a.b x@y", "1.2.3.4.5.6.7.8", "1.2.3.256 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (234) 567-8901", "+12 34 5 67 8.", "a%b@c.d..e", "é@x.yé", "١٢٣.1.1.1"]
    for t in texts:
        assert X.base_spans(t) == plain_base(t), t


def test_long_runs_stay_linear():
    for t in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 100_000, "x" * 400_000 + "@a.b", "(at" * 100_000):
        X.base_spans(t)
        list(X.regions(t))


def test_viterbi_against_all_labelings():
    rng = np.random.default_rng(3)
    field = X.Field({}, np.zeros((1, len(X.LABELS))), rng.normal(size=(len(X.LABELS),) * 2))
    scores = [rng.normal(size=(n, len(X.LABELS))) * 2 for n in (1, 2, 3, 4, 4, 2)]
    for e, got in zip(scores, field.decode(scores), strict=True):
        value = lambda y, e=e: sum(e[t, y[t]] + (field.pairs[y[t - 1], y[t]] if t else 0 if X._START[y[0]] else -1e9) for t in range(len(y)))
        assert tuple(got) == max(product(range(len(X.LABELS)), repeat=len(e)), key=value)


def test_training_raises_the_likelihood_of_its_labels():
    """Against the likelihood summed over all labelings of short sequences."""
    rows = [([["a"], ["b"], ["a"]], [0, 1, 2]), ([["b"], ["c"]], [1, 0]), ([["c"]], [3])]

    def loss(field):
        total = 0.0
        for feats, labels in rows:
            e = field.scores(feats)
            value = lambda y, e=e: sum(e[t, y[t]] + (field.pairs[y[t - 1], y[t]] if t else 0 if X._START[y[0]] else -1e9) for t in range(len(y)))
            every = [value(y) for y in product(range(len(X.LABELS)), repeat=len(labels))]
            total += np.logaddexp.reduce(every) - value(labels)
        return total

    losses = [loss(X.fit(rows, rounds=r, step=0.05, penalty=0)) for r in (0, 5, 20, 60)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2 * losses[0]


def test_held_out_examples(field, monkeypatch):
    """Examples filled with other digits: what is found is what they mark, except where a pattern itself decides."""
    monkeypatch.setattr(X.random, "Random", lambda _, r=random.Random: r(99))
    right = found = marked = 0
    for text, spans in X.filled_examples(12):
        base, more = X.found_spans([text], field)[0]
        right += len(set(spans) & set(base + more))
        found += len(base + more)
        marked += len(spans)
    assert right / marked > 0.93 and right / found > 0.95


def test_finds_what_the_patterns_drop(field):
    texts = {
        "of the +1 (826) 555-4081 190.137.223.204 and": ["phone:7:24", "ip:25:40"],
        "were 7536784127813050 4845168114407329 here": ["card:5:21", "card:22:38"],
        "ask jane [at] example [dot] com soon": ["email:4:31"],
        "call (017) 555-7713 today": ["phone:5:19"],
    }
    for text, want in texts.items():
        base, more = X.found_spans([text], field)[0]
        assert X.written(base + more) == ",".join(sorted(want, key=lambda s: X.KINDS.index(s.split(":")[0]))), text


def test_leaves_clean_numbers_alone(field):
    for text in ("version 2.10.4 of 2024-03-17", "page 12 of 340", "token = \"9b0b3c6a43eb78aa99cbd7049c57\" x", "$1,234.56 and 3.14159", "the 1234567812345678 of", "at 12:30:45 on 1999", "64.147.79.300 is none", ""):
        assert X.found_spans([text], field)[0] == ([], []), text


def test_the_query(spark, sf, docs, field):
    rows = {r["doc_id"]: r for r in queries.op11_pii(spark, sf).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for d, t in texts:
        r = rows[d]
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"], r["spans"]) == plain_find(t, field), d


def test_odd_rows(odd, none, field):
    got = sorted(((r["doc_id"], r["base_sha256"], r["spans"]) for r in X.find(odd, field).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain_find(r["text"], field)[1:]) for r in odd.collect()), key=repr)
    assert X.find(none, field).count() == 0
    empty = X.train(X.table(none.sparkSession, []))  # nothing to learn from: the patterns alone
    assert X.found_spans(["a@b.c and 12"], empty)[0] == ([("email", 0, 5)], [])
    assert X.find(none, X.train(X.labelled(none))).count() == 0
