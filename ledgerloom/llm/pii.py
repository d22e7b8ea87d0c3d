"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail addresses, network addresses, card and phone numbers on their own, but drop a match that runs
into another number, and know one way of writing each. The field reads tokens by the shape of their words and
neighbours, is trained from a small labelled table on the driver, and decodes all texts by Viterbi in numpy batches.

Tokens far from any digit, `@` or spelt-out at sign are O by definition, so a chain falls into regions that are decoded
on their own: words with such a sign, those with at most one other word between them, and one word on either side.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Texts of the corpus in the labelled table, by hash, each of at most so many characters, and texts looked at for each.
TRAIN_TEXTS, TRAIN_CHARS, LOOKED_AT = 400, 20_000, 8
#: Regions of more tokens than this aren't trained on.
TRAIN_TOKENS = 60
ROUNDS, STEP, PENALTY = 60, 0.15, 0.02
#: Times each example is filled with other digits.
FILLS = 8

# Fixed patterns. Those of a network address and an e-mail address start only where a run starts, and never give a run
# back: any other start in the run fails as the first one does, and a text of one long run stays linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGN = re.compile("[0-9@]")
_TRIGGER = re.compile(r"(?<!\S)(?:[^\s0-9@\[({]++|[\[({](?!(?:at|dot)[\])}]))*+(?:[0-9@]|[\[({](?:at|dot)[\])}])\S*+")
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")
_WORD = re.compile(r"\S+")

#: Words that tell what a number is.
CUES = frozenset("tel telephone phone call fax mobile cell sms card visa credit ip host server address email mail contact version v isbn page order rows at dot com org net edu de fr es io token key date total price".split())

#: Labelled examples: {kind|value} is a span; # a digit, % the digit that makes the ones before it pass Luhn's check,
#: & a number up to 255, ~ a name.
EXAMPLES = (
    "call {phone|(###) ###-####} today", "tel. {phone|(0##) ###-####}, ext", "phone: {phone|###-###-####} or", "fax {phone|+## ### ### ####} now", "mobile {phone|0### ######} please",
    "the {phone|+1 (###) ###-####} {ip|&.&.&.&} host", "{phone|+1 (###) ###-####} {card|###############%} and", "that {phone|+1 (###) ###-####} {phone|+1 (###) ###-####} word", "{phone|+1 (###) ###-####} {card|###############%}",
    "paid {card|###############%} {card|###############%} twice", "the {card|###############%} {card|###############%} {card|###############%} end", "card {card|###############%} 42 of", "visa {card|#### #### #### ###%} ok", "a {card|#### #### #### ###%} 12 x", "card {card|####-####-####-###%}, and", "credit {card|#### ###### ####%} exp", "12 {card|###############%} items",
    "host {ip|&.&.&.&}:8080 up", "from {ip|&.&.&.&}, then", "ip {ip|&.&.&.&} {ip|&.&.&.&} both", "({ip|&.&.&.&})", "{ip|&.&.&.&}/24 net",
    "mail {email|~ [at] example [dot] com} now", "write to {email|~ (at) mail (dot) example (dot) org}, please", "{email|~ [at] example.com} and", "contact {email|~(at)example.com} or", "{email|~ @ example.com} for", "{email|~.##@mail#.example.com} said", "e-mail {email|~@example.org}.",
    "version #.##.# of", "v#.#.#.### build", "about #.##### and", "$#,###.## for", "on 20##-0#-1# we", "at 1#:##:## sharp", "ISBN 978-#-##-######-# by", "order ########## was", "page ## of ###", "rows ####-#### of", "net ###.9##.###.### bad", "a#b#c##d####e", 'token = "a##f##c#d####b##e#" is', "### of the #### rows", "number ################ is", "the ################ ################ of", "## % of ## items", "x# y## z###", "in 20## and 19##,", "#.#.# and #.#", "me @ home at #", "look (at) this and # more", "size ###x### px", "#### #### words", "id ############### and",
)
NAMES = ("jane", "li.wei", "Ana", "o.berg", "info", "Max-Lee", "support", "rao")


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2]) % 10 == sum(d * 2 - 9 * (d > 4) for d in own[1::2]) * 9 % 10


def _octets(parts: list[str]) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of all matches of the patterns, kind by kind."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield "email", start, end, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), _octets(m[0].split("."))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:  # fewer can't be a card
            d = _digits(m[0])
            yield "card", m.start(), m.end(), 16 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 8 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The valid matches by kind, then start."""
    return [(k, s, e) for k, s, e, ok in matches(text) if ok] if _SIGN.search(text) else []


def plausible(kind: str, value: str) -> bool:
    """Whether a span of the field can be what it says."""
    d = _digits(value)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({]at[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]+)+", value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", value)) and _octets(value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch("[0-9]+(?:[ -][0-9]+)*", value))
    return 8 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", value)) and value.count("(") == value.count(")")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of a text that are decoded."""
    if not _SIGN.search(text) and "(at)" not in text and "[at]" not in text and "{at}" not in text:
        return
    first = last = None
    for m in _TRIGGER.finditer(text):
        if first is not None and _near(text, last, m.start()):
            last = m.end()
            continue
        if first is not None:
            yield _before(text, first), _after(text, last)
        first, last = m.span()
    if first is not None:
        yield _before(text, first), _after(text, last)


def _near(text: str, a: int, b: int) -> bool:
    """At most one word between two others."""
    return b - a <= 64 and len(text[a:b].split()) <= 1


def _before(text: str, at: int) -> int:
    """The start of the word before one that starts at `at`, if it ends within a few spaces and isn't long."""
    near = text[max(0, at - 64) : at].rstrip()
    word = re.search(r"(?<=\s)\S+$" if at > 64 else r"\S+$", near)
    return max(0, at - 64) + word.start() if word else at


def _after(text: str, at: int) -> int:
    m = re.compile(r"\s{1,8}\S{1,48}(?!\S)").match(text, at)
    return m.end() if m else at


@lru_cache(65_536)
def shape(word: str) -> str:
    """A word with runs of digits as d and of letters as a, without marks at its ends that sentences have."""
    s = re.sub("[0-9]+", "d", re.sub(r"[^\W0-9_]+", "a", word.strip(".,;:!?\"'#$%&*|")[:80]))
    return s if len(s) <= 16 else s[:8] + "…" + s[-4:]


@lru_cache(65_536)
def token_class(t: str) -> str:
    if "0" <= t[0] <= "9":
        n = len(t)
        return f"d{n}" if n <= 4 else "d5+" if n < 13 else f"D{int(luhn(t))}" if n < 20 else "D+"
    if t.lower() in CUES:
        return t.lower()
    if t.isalpha():
        return "A" if t.isupper() else "Aa" if t[0].isupper() else "a"
    return t if t < "\x7f" else "u"


def features(text: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """(start, end) of a region's tokens, and the features of each."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    words = [(m.start(), m.end(), shape(m[0])) for m in _WORD.finditer(text)]
    cls = ["^^", "^", *(token_class(text[a:b]) for a, b in spans), "$", "$$"]
    glued = [False, *(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)), False]
    out, w = [], 0
    for i, (a, b) in enumerate(spans):
        while words[w][1] <= a:
            w += 1
        pp, p, c, n, nn = cls[i : i + 5]
        own, prev, nxt = words[w][2], words[w - 1][2] if w else "^", words[w + 1][2] if w + 1 < len(words) else "$"
        g = f"{int(glued[i])}{int(glued[i + 1])}"
        f = ["bias", c, f"p{p}|{c}|{g}", f"n{c}|{n}|{g}", f"pp{pp}|{p}|{c}", f"nn{c}|{n}|{nn}", f"w{own}|{c}", f"pw{prev}|{own}", f"nw{own}|{nxt}", f"x{prev}|{own}|{nxt}"]
        f += [f"q{x}" for x in cls[max(0, i - 2) : i + 2] if x in CUES]
        if b - a <= 3 and "0" <= text[a] <= "9":
            f.append(f"o{int(text[a:b]) <= 255}|{own}")
        out.append(f)
    return spans, out


LABELS = ("O", *(f"{x}{k}" for k in KINDS for x in "BI"))
_LABEL = {x: i for i, x in enumerate(LABELS)}
#: I of a kind follows only B or I of it.
_ALLOWED = np.array([[not b.startswith("I") or a[1:] == b[1:] and a != "O" for b in LABELS] for a in LABELS])
_START = np.array([not b.startswith("I") for b in LABELS])
_NEVER = -1e9


class Field:
    """A trained field: rows of weights by feature, and those of label pairs."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.weights, self.pairs = index, weights, np.where(_ALLOWED, pairs, _NEVER)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """One row of label scores for each token."""
        ids = [[self.index[x] for x in f if x in self.index] or [0] for f in rows]
        flat = np.fromiter((i for f in ids for i in f), np.int64)
        starts = np.cumsum([0, *map(len, ids[:-1])])
        return np.add.reduceat(self.weights[flat], starts)

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence, by Viterbi in padded batches of like lengths."""
        out: list[np.ndarray | None] = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        k = 0
        while k < len(order):
            longest = len(scores[order[k]]) * 5 // 4 + 4
            batch = [i for i in order[k : k + 256] if len(scores[i]) <= longest]
            k += len(batch)
            n = max(len(scores[i]) for i in batch)
            e = np.zeros((len(batch), n, len(LABELS)))
            for j, i in enumerate(batch):
                e[j, : len(scores[i])] = scores[i]
            lengths = np.array([len(scores[i]) for i in batch])
            best, back = np.where(_START, e[:, 0], _NEVER), np.zeros((len(batch), n, len(LABELS)), np.int8)
            for t in range(1, n):
                ways = best[:, :, None] + self.pairs
                back[:, t] = ways.argmax(1)
                live = (t < lengths)[:, None]
                best = np.where(live, ways.max(1) + e[:, t], best)
            label = best.argmax(1)
            path = np.zeros((len(batch), n), np.int8)
            for t in range(n - 1, -1, -1):
                path[:, t] = np.where(t < lengths, label, 0)
                label = np.where((t < lengths) & (t > 0), back[np.arange(len(batch)), t, label], label)
            for j, i in enumerate(batch):
                out[i] = path[j, : len(scores[i])]
        return out


def fit(examples: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS, step: float = STEP, penalty: float = PENALTY) -> Field:
    """A field from (features, labels) of sequences: penalised likelihood by Adam, with forward and backward sums in numpy."""
    index = {x: i for i, x in enumerate(dict.fromkeys(x for rows, _ in examples for f in rows for x in f))}
    k, n, most = len(LABELS), len(examples), max((len(y) for _, y in examples), default=1)
    weights, pairs = np.zeros((max(1, len(index)), k)), np.zeros((k, k))
    if not examples:
        return Field(index, weights, pairs)
    at = np.array([(i, t) for i, (rows, _) in enumerate(examples) for t, f in enumerate(rows) for _ in f])
    ids = np.array([index[x] for rows, _ in examples for f in rows for x in f])
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], at[order]
    firsts = np.searchsorted(ids, np.arange(len(index)))
    cell = at[:, 0] * most + at[:, 1]
    by_cell = np.argsort(cell, kind="stable")
    cells, cell_starts = np.unique(cell[by_cell], return_index=True)
    gold, lengths = np.zeros((n, most, k)), np.array([len(y) for _, y in examples])
    for i, (_, y) in enumerate(examples):
        gold[i, np.arange(len(y)), y] = 1
    gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pairs), np.zeros_like(pairs)]
    live = np.arange(most)[None, :] < lengths[:, None]
    for r in range(1, rounds + 1):
        e = np.zeros((n * most, k))
        e[cells] = np.add.reduceat(weights[ids[by_cell]], cell_starts)
        e = e.reshape(n, most, k)
        trans = np.exp(np.where(_ALLOWED, pairs, _NEVER))
        top = e.max(2, keepdims=True)
        x = np.exp(e - top)
        fwd, bwd = np.zeros((n, most, k)), np.ones((n, most, k))
        fwd[:, 0] = x[:, 0] * _START
        fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
        for t in range(1, most):
            f = (fwd[:, t - 1] @ trans) * x[:, t]
            fwd[:, t] = f / f.sum(1, keepdims=True)
        for t in range(most - 2, -1, -1):
            b = (x[:, t + 1] * bwd[:, t + 1]) @ trans.T
            bwd[:, t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        post = fwd * bwd
        post = np.where(live[:, :, None], post / post.sum(2, keepdims=True), 0)
        joint = fwd[:, :-1, :, None] * trans * (x[:, 1:] * bwd[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        got_pairs = (joint * live[:, 1:, None, None]).sum((0, 1))
        diff = (gold - post).reshape(n * most, k)
        slopes = np.add.reduceat(diff[cell], firsts) - penalty * weights, gold_pairs - got_pairs - penalty * pairs
        for j, (p, g) in enumerate(zip((weights, pairs), slopes, strict=True)):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p += step * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-8)
    return Field(index, weights, pairs)


def filled_examples(fills: int = FILLS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) of EXAMPLES, each filled `fills` times by a seeded generator."""
    rng, out = random.Random(11), []
    for template in EXAMPLES * fills:
        text, spans = "", []
        for kind, value, plain in re.findall(r"\{(\w+)\|([^}]*)\}|([^{]+|\{)", template):
            at, value = len(text), value or plain
            for c in value:
                if c == "#":
                    text += str(rng.randrange(10))
                elif c == "%" and kind == "card":
                    d = _digits(text[at:])
                    text += next(x for x in "0123456789" if luhn(d + x))
                elif c == "&" and kind:
                    text += str(rng.randrange(256))
                else:
                    text += rng.choice(NAMES) if c == "~" else c
            if kind:
                spans.append((kind, at, len(text)))
        out.append((text, spans))
    return out


def labelled(df: DataFrame, text: str = "text", order: str = "doc_id", texts: int = TRAIN_TEXTS) -> DataFrame:
    """The small labelled table (text, kinds, starts, ends): the filled examples, and regions of at most `texts` texts.

    A hash of `order` and text picks about LOOKED_AT times `texts` rows, however many there are, so that few go to the
    driver; of these, the texts are the first by that hash with a digit or `@` and at most TRAIN_CHARS characters. Their
    labels are the patterns' spans. A region in which the patterns drop a match is left out, as nothing tells what it
    holds.
    """
    spark = df.sparkSession
    share = min(1.0, LOOKED_AT * texts / max(1, df.count()))
    picked = df.select(F.xxhash64(order, text).alias("h"), F.col(text).alias("t")).where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = picked.where((F.char_length("t") <= TRAIN_CHARS) & F.rlike("t", F.lit("[0-9@]")))
    rows = []
    for r in some.orderBy("h").limit(texts).select("t").collect():
        found = list(matches(r["t"]))
        for a, b in regions(r["t"]):
            inside = [x for x in found if x[1] < b and x[2] > a]
            if all(ok for *_, ok in inside):
                rows.append((r["t"][a:b], [(k, s - a, e - a) for k, s, e, _ in inside]))
    return table(spark, [*filled_examples(), *rows])


def table(spark: SparkSession, rows: Iterable[tuple[str, list[tuple[str, int, int]]]]) -> DataFrame:
    data = [(t, [x[0] for x in s], [x[1] for x in s], [x[2] for x in s]) for t, s in rows]
    return spark.createDataFrame(data, "text string, kinds array<string>, starts array<int>, ends array<int>")


def train(examples: DataFrame, **options) -> Field:
    """A field from a small table (text, kinds, starts, ends), which is read by the driver: see labelled() for its bound.

    A text of which a span starts or ends within a token, or of more than TRAIN_TOKENS tokens, is passed over.
    """
    sequences = []
    for r in examples.collect():
        tokens, rows = features(r["text"])
        if not 0 < len(tokens) <= TRAIN_TOKENS:
            continue
        labels, fits = [0] * len(tokens), True
        for kind, a, b in zip(r["kinds"], r["starts"], r["ends"], strict=True):
            own = [i for i, (s, e) in enumerate(tokens) if s < b and e > a]
            fits &= bool(own) and tokens[own[0]][0] == a and tokens[own[-1]][1] == b
            for j, i in enumerate(own):
                labels[i] = _LABEL[("I" if j else "B") + kind]
        if fits:
            sequences.append((rows, labels))
    return fit(sequences, **options)


def found_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, added spans) of each text. Added ones lie apart from all base ones."""
    base = [base_spans(t) for t in texts]
    places = [(i, a, *features(t[a:b])) for i, t in enumerate(texts) for a, b in regions(t)]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, a, tokens, _), labels in zip(places, field.decode([field.scores(rows) for *_, rows in places]), strict=True):
        if not labels.any():
            continue
        spans: list[list] = []
        for (s, e), y in zip(tokens, (LABELS[x] for x in labels), strict=True):
            if y[0] == "B":
                spans.append([y[1:], a + s, a + e])
            elif y[0] == "I":
                spans[-1][2] = a + e
        for kind, s, e in spans:
            if plausible(kind, texts[i][s:e]) and not any(x < e and y > s for _, x, y in base[i]):
                added[i].append((kind, s, e))
    return list(zip(base, added, strict=True))


def written(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the patterns' spans; spans has those of the field too, n_added is their number.
    Places are in code points, the end exclusive. A null text counts as empty: no spans. Rows are independent, so
    repeated ones give repeated results; an empty table gives no rows; other columns of df are not used.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results = found_spans(b.column(1).to_pylist(), field)
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in results], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in results], pa.string())
            spans = pa.array([written(base + more) for base, more in results], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, spans, pa.array([len(m) for _, m in results], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")
