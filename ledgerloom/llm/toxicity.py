"""Toxicity by fuzzy lexicon matching.

The lexicon is learned: words and word beginnings that toxic training texts have far more often than others, each with
its log-odds as weight. It lies in a trie. A word that isn't in it, and doesn't begin as one of its beginnings, becomes
a Levenshtein automaton, whose intersection with the trie finds the strong terms it misspells: whole words within one
edit or swap of neighbours, and beginnings within one edit or swap of how the word begins. A filter by halves goes first:
an edit leaves one half of a term as it is, so it skips only words whose intersection is empty. A word that training knows as clean, or that begins, up to
where it departs from the term, as clean words do, misspells nothing.

Each hit is weighed by its context window: within quotation marks, or among reporting words, a term is quoted rather
than used, and counts less. A logistic model over the hits' weights gives the score; evidence never lowers it, and
quotation never raises it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, small_batches

#: At most so many labelled rows are used for training, those first in the order of their id's hash.
TRAIN_ROWS = 40_000
#: Lexicon: a term needs so many toxic texts, so large a log-odds, and so many standard
#: deviations more toxic texts than chance gives: with hundreds of thousands of candidates, chance alone reaches four.
SUPPORT, LOG_ODDS, PRIOR, DEVIATIONS = 3, 1.2, 2.0, 5.5
#: A term must also stand after several different words, a quarter as many as texts or 16: the words of one text that
#: has many near copies stand after the same each time.
#: Strong terms, which misspellings are matched to: their least log-odds, toxic texts (however many there are), and length.
STRONG_ODDS, STRONG_SUPPORT, STRONG_LENGTH, STRONG_STEM = 3.0, 5, 5, 6
#: A word or beginning in so many training texts whose own log-odds lie below this is known as clean.
KNOWN_TEXTS, KNOWN_ODDS = 3, 1.0
STEM_FROM, STEM_TO = 4, 10
WINDOW, QUOTED, FUZZY = 6, 0.25, 0.7
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»]")
#: Words that report what someone else said.
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quotes reported according dit écrit dijo dice escribió sagte sagt schrieb".split())
#: Best term, next three, number of strong hits, density, misspellings, share that is quoted; and the sign of each weight.
N_FEATURES, SIGNS = 6, (1, 1, 1, 1, 1, -1)


def terms_of(text: str) -> dict[str, int]:
    """The words of text and, marked by *, their beginnings, each with a bit set for the word before each place it stands at."""
    out: dict[str, int] = {}
    before = ""
    for w in _TOKEN.findall(text.lower()):
        if len(w) >= 3 and not w.isdigit():
            bit = 1 << zlib.crc32(before.encode()) % 62
            out[w] = out.get(w, 0) | bit
            for k in range(STEM_FROM, min(len(w), STEM_TO + 1)):
                stem = w[:k] + "*"
                out[stem] = out.get(stem, 0) | bit
        before = w
    return out


def log_odds(toxic, total, base: float, prior: float = PRIOR):
    return np.log((toxic + prior * base) / (total - toxic + prior * (1 - base))) - np.log(base / (1 - base))


class Automaton:
    """The Levenshtein automaton of a word: it accepts what lies within k edits.

    A state has one bit set for each number of edits; bit i: the first i characters of the word are used up.
    """

    def __init__(self, word: str, k: int) -> None:
        self.k, self.end = k, 1 << len(word)
        self.all = 2 * self.end - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        return tuple((2 << e) - 1 & self.all for e in range(self.k + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...] | None:
        """The next state, None if it accepts nothing."""
        same = self.masks.get(char, 0)
        out = [(state[0] & same) << 1]
        for e in range(1, self.k + 1):
            before = state[e - 1]
            out.append(((state[e] & same) << 1 | before | before << 1 | out[e - 1] << 1) & self.all)
        return tuple(out) if any(out) else None

    def accepts(self, state: tuple[int, ...]) -> int | None:
        """Edits of an accepting state."""
        return next((e for e, bits in enumerate(state) if bits & self.end), None)

    @staticmethod
    def begins(state: tuple[int, ...]) -> int | None:
        """Edits at which what led to the state is a beginning of the word."""
        return next((e for e, bits in enumerate(state) if bits), None)


def shorter(word: str) -> set[str]:
    """A word, and what is left of it without each one of its letters."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Halves:
    """Terms of one length by their halves, and by the first half with its last letter swapped with the next."""

    def __init__(self, length: int) -> None:
        self.length, self.half = length, length // 2
        self.first: set[str] = set()
        self.second: set[str] = set()
        self.crossed: set[str] = set()

    def add(self, term: str) -> None:
        h = self.half
        self.first.add(term[:h])
        self.second.add(term[h:])
        self.crossed.add(term[: h - 1] + term[h] + term[h - 1])

    def may_match(self, word: str) -> bool:
        """Whether word may begin within one edit or swap of a term."""
        h, n = self.half, self.length
        return word[:h] in self.first or word[h:n] in self.second or word[h - 1 : n - 1] in self.second or word[h + 1 : n + 1] in self.second or word[: h + 1] in self.crossed


def swaps(word: str) -> set[str]:
    """word with each two neighbours swapped."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}


@dataclass
class Lexicon:
    """Terms with their toxic and total text counts."""

    base: float
    counts: dict[str, tuple[int, int]]
    toxic: int = 0  # toxic training texts
    beta: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))

    def __post_init__(self) -> None:
        self.trie: dict = {}
        self.strong: set[str] = set()
        self.words: dict[int, Halves] = {}  # strong words by length
        self.stems: dict[int, Halves] = {}  # strong beginnings by length
        self.known: set[str] = set()  # clean words and beginnings that are near strong terms
        self.near_known: set[str] = set()  # beginnings of strong terms, whole and without each one of their letters
        self.memo: dict[str, tuple[str, int] | None] = {}
        self.weights = {t: float(log_odds(a, n, self.base)) for t, (a, n) in self.counts.items()}
        for t, (a, _) in self.counts.items():
            node = self.trie
            for c in t.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if t[-1] == "*" else ""] = t
            if a < STRONG_SUPPORT or self.weights[t] < STRONG_ODDS:
                continue
            if t[-1] != "*" and len(t) >= STRONG_LENGTH:
                self.strong.add(t)
                self.words.setdefault(len(t), Halves(len(t))).add(t)
            elif t[-1] == "*" and len(t) > STRONG_STEM:
                self.strong.add(t)
                self.stems.setdefault(len(t) - 1, Halves(len(t) - 1)).add(t[:-1])
            if t in self.strong:
                for k in range(STEM_FROM - 1, len(t.rstrip("*")) + 1):
                    self.near_known |= shorter(t[:k])

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best term for a word: itself, its longest learned beginning, or a strong term that it misspells."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 300_000:
            self.memo.clear()
        if word in self.counts:
            found = word, 0
        else:
            found = next(((s, 0) for k in range(min(len(word) - 1, STEM_TO), STEM_FROM - 1, -1) if (s := word[:k] + "*") in self.counts), None)
            if found is None and len(word) >= STRONG_LENGTH - 1:
                found = self.misspelt(word)
        self.memo[word] = found
        return found

    def misspelt(self, word: str) -> tuple[str, int] | None:
        """(term, 1) of the strong term that a word misspells: a whole word rather than a beginning, and the longest of these; of several, the first."""
        n = len(word)
        whole = any(k in self.words and self.words[k].may_match(word) for k in (n - 1, n, n + 1))
        stems = [k for k, halves in self.stems.items() if n >= k and halves.may_match(word)]
        if not (whole or stems) or word in self.known:
            return None
        if not whole:
            word = word[: STEM_TO + 2]  # only how it begins matters
        swapped = [w for w in swaps(word) if w in self.strong and not self._other(word, w)]
        if swapped:
            return min(swapped), 1
        auto, found = Automaton(word, 1), []
        todo = [(self.trie, auto.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if len(c) == 1 and c != "*":
                    if nxt := auto.step(state, c):
                        todo.append((child, nxt))
                elif child in self.strong and (auto.accepts(state) if c == "" else auto.begins(state)) is not None:
                    found.append(child)
        found += [s + "*" for k in stems for s in swaps(word[:k]) if s + "*" in self.strong]
        found = [t for t in found if not self._other(word, t)]
        return (min(found, key=lambda t: (t[-1] == "*", -len(t), t)), 1) if found else None

    def _other(self, word: str, term: str) -> bool:
        """Whether word belongs to clean words: it begins as they do from where it departs from the term on."""
        same = next((i for i, (a, b) in enumerate(zip(word, term, strict=False)) if a != b), min(len(word), len(term)))
        return any(word[:k] + "*" in self.known for k in range(max(same + 1, STEM_FROM), min(len(word), STEM_TO + 1)))

    def may_be_known(self, term: str) -> bool:
        """Whether it matters that a word or beginning is clean: it shares a form with a beginning of a strong term."""
        return term not in self.counts and not self.near_known.isdisjoint(shorter(term.rstrip("*")))

    def features(self, text: str, label: int | None = None) -> np.ndarray:
        """Features of a text. label: of a training text, whose own count is taken out of the terms' counts."""
        low = text.lower()
        words = set(_TOKEN.findall(low))
        hits = {w: m for w in words if len(w) >= 3 and (m := self.match(w))}
        out = np.zeros(N_FEATURES)
        if not hits:
            return out
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(low)]
        quotes = np.array([m.start() for m in _QUOTES.finditer(low)], int)
        weights, best, fuzzy, quoted = [], Counter(), 0, 0
        for i, (s, e, w) in enumerate(tokens):
            if w not in hits:
                continue
            term, edits = hits[w]
            weight = self.weights[term]
            if label is not None and not edits:  # a misspelling isn't counted for the term
                a, n = self.counts[term]
                weight = float(log_odds(max(a - label, 0), max(n - 1, 0), self.base))
            weight *= FUZZY if edits else 1
            if weight <= 0:
                continue
            if self._quoted(tokens, i, s, e, quotes):
                weight *= QUOTED
                quoted += 1
            fuzzy += bool(edits)
            weights.append(weight)
            best[term] = max(best[term], weight)
        if weights:
            top = sorted(best.values(), reverse=True)
            out[:] = top[0], sum(top[1:4]), np.log1p(sum(x > 2 for x in weights)), sum(weights) / (len(tokens) + 20) * 10, min(fuzzy, 3), quoted / len(weights)
        return out

    def _quoted(self, tokens: list[tuple], i: int, s: int, e: int, quotes: np.ndarray) -> bool:
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        if any(w in REPORTING for _, _, w in near):
            return True
        lo, hi = near[0][0], near[-1][1]
        return bool(((quotes >= lo) & (quotes < s)).sum() % 2 and ((quotes >= e) & (quotes <= hi)).any())

    def score(self, text: str) -> float:
        return self._logistic(self.features(text))

    def _logistic(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30))))

    def rejects(self, text: str, threshold: float) -> bool:
        """Whether the score reaches threshold on evidence: a text without a term is kept, however common toxic labels are."""
        x = self.features(text)
        return bool(x.any()) and self._logistic(x) >= threshold


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, signs: tuple[int, ...] = SIGNS) -> np.ndarray:
    """Logistic regression by Newton steps; the penalty leaves the constant free. A weight of the wrong sign becomes 0, the worst first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    free = list(range(x.shape[1]))
    while True:
        b = np.zeros(x.shape[1])
        b[free] = _newton(x[:, free], y, ridge)
        wrong = [k for k in free[1:] if b[k] * signs[k - 1] < 0]
        if not wrong:
            return b
        free.remove(max(wrong, key=lambda k: abs(b[k])))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon and weights from docs and labels(doc_id, toxic): of rows with a label, at most `rows` ids.

    Null ids, labels and texts don't count; of several labels of an id or a text the largest does. The lexicon has all
    terms that stand out in the sample, so it is bounded by the sample. Without a toxic or without a
    clean text nothing is learned, and any score is the share of toxic labels.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:  # a hash leaves little more than rows, so that what the limit compares doesn't grow with the labels
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_100_000 * rows / n) + 1)
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)  # bounded, hence broadcast
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").where("text is not null")
    texts = cut(texts.groupBy("text").agg(F.max("toxic").alias("toxic")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bad, seen = Counter(), Counter(), {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = terms_of(t)
                total.update(own.keys())
                total[""] += 1
                if y:
                    bad.update(own.keys())
                    bad[""] += 1
                    for w, bits in own.items():
                        seen[w] = seen.get(w, 0) | bits
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([bad[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64()), pa.array([seen.get(t, 0) for t in total], pa.int64())], names=["term", "a", "n", "places"])

    counts = texts.mapInArrow(count, "term string, a bigint, n bigint, places bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.bit_count(F.bit_or("places")).alias("places"))
    counts = cut(counts.where(f"a >= {SUPPORT} or n >= {KNOWN_TEXTS}"))
    whole = counts.where("term = ''").first()
    if whole is None or not 0 < whole["a"] < whole["n"]:
        share = (whole["a"] / whole["n"]) if whole else 0.0
        return Lexicon(0.5, {}, 0, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), *[0] * N_FEATURES]))
    base = whole["a"] / whole["n"]
    odds = F.log((F.col("a") + PRIOR * base) / (F.col("n") - F.col("a") + PRIOR * (1 - base))) - float(np.log(base / (1 - base)))
    best = counts.where(f"a >= {SUPPORT} and term <> ''").withColumn("w", odds).where((F.col("w") >= LOG_ODDS) & (F.col("a") - F.col("n") * base >= DEVIATIONS * F.sqrt(F.col("n") * base)) & (F.col("places") >= F.least(F.greatest(F.lit(float(SUPPORT)), F.col("a") / 4), F.lit(16.0)))).orderBy("term")
    lexicon = Lexicon(base, {r["term"]: (r["a"], r["n"]) for r in best.collect()}, whole["a"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([lexicon.may_be_known(t) for t in b.column(0).to_pylist()], pa.bool_()))

    clean = counts.where(f"n >= {KNOWN_TEXTS} and term <> ''").withColumn("w", odds).where(F.col("w") < KNOWN_ODDS).select("term")
    lexicon.known = {r["term"] for r in clean.mapInArrow(near, "term string").collect()}
    lexicon.memo.clear()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(t, y).tolist() for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = texts.mapInArrow(measure, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    x, y = np.repeat([r["x"] for r in got], [r["count"] for r in got], 0), np.repeat([r["y"] for r in got], [r["count"] for r in got])
    lexicon.beta = _fit(np.array(x), np.minimum(y, 1))
    lexicon.memo.clear()
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: doc_id, score (0 to 1), predicted (1 if score >= threshold), and the columns in keep.

    A null or empty text has no hits and the score of such. Repeated rows score alike.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [lexicon.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), *[b.column(k + 2) for k in range(len(keep))]], names=["doc_id", "score", "predicted", *keep])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int{more}")


def without_toxic(df: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the rows that the lexicon rejects; its columns stay as they are. Null and empty texts stay."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not lexicon.rejects(t or "", threshold) for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
