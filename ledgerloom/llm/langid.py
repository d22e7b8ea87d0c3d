"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point, so that every worker and run has the same. A
letter n-gram is bound from its letters' vectors, each rotated by its place and multiplied; a text is the bundle (sum)
of its n-grams, a language's prototype the bundle of its training texts. Texts are compared with the centred
prototypes by cosine. Training sends one vector per language and worker, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

DIM, NGRAM, SEED = 1024, 3, 7
#: Sharpness of the softmax that turns cosines into a score.
SHARPNESS = 20.0
#: More languages than this are refused: prototypes are held by the driver and each worker.
MAX_LANGUAGES = 5000
UNDETERMINED = "und"
#: A batch is cut where its texts pass this many letters, and a longer text's n-grams are counted in parts.
_CHARS, _CODES, _CELLS = 2_000_000, 4_000_000, 16_000_000


class Space:
    """Letter vectors and the encoding of texts."""

    def __init__(self, dim: int = DIM, n: int = NGRAM, seed: int = SEED) -> None:
        self.dim, self.n, self.seed, self.vectors = dim, n, seed, {}
        self.letter = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            self.vectors[code] = (np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)
        return self.vectors[code]

    def letters(self, text: str) -> np.ndarray:
        """Code points of the lower-cased letters of text, each run of others as one 0, with a 0 at both ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        new = np.unique(codes[~self.known[codes]])
        self.letter[new] = [chr(c).isalpha() for c in new.tolist()]
        self.known[new] = True
        codes = np.where(self.letter[codes], codes, 0)
        codes = np.concatenate([[0], codes, [0]])
        return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.int64)

    def counts(self, rows: list[np.ndarray], cells: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """(n-grams, one row of code points each; counts of rows x n-grams, None if they have more than cells, if not 0)."""
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        alphabet, flat = np.unique(flat, return_inverse=True)
        size, ends = len(alphabet), np.cumsum([len(r) for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n_codes = max(0, len(flat) - self.n + 1)
        code = np.zeros(n_codes, np.int64)
        for k in range(self.n):
            code = code * size + flat[k : k + n_codes]
        inside = np.ones(n_codes, bool)  # not over the border of two texts
        for e in ends[:-1]:
            inside[max(0, e - self.n + 1) : e] = False
        code, doc = code[inside], doc[:n_codes][inside]
        if size**self.n <= _CODES:
            present = np.flatnonzero(np.bincount(code, minlength=1))
            place = np.zeros(size**self.n, np.int64)
            place[present] = np.arange(len(present))
            code = place[code]
        else:
            present, code = np.unique(code, return_inverse=True)
        if cells and len(rows) * len(present) > cells:
            return present, None
        table = np.bincount(doc * max(1, len(present)) + code, minlength=len(rows) * len(present)).reshape(len(rows), len(present))
        grams = np.stack([alphabet[present // size ** (self.n - 1 - k) % size] for k in range(self.n)], 1) if len(present) else np.zeros((0, self.n), np.int64)
        return grams, table.astype(np.float32)

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: the product of their letters' vectors, rotated by n - 1, ..., 0 places."""
        out = np.ones((len(grams), self.dim), np.int8)
        for k in range(self.n):
            own, where = np.unique(grams[:, k], return_inverse=True)
            turned = np.stack([np.roll(self.vector(int(c)), self.n - 1 - k) for c in own]) if len(own) else np.zeros((0, self.dim), np.int8)
            out *= turned[where]
        return out.astype(np.float32)

    def bundles(self, texts: list[str]) -> np.ndarray:
        """One vector per text: the sum over its n-grams. A long text's are counted in parts, each n-gram in one of them."""
        out = np.zeros((len(texts), self.dim))
        group, held = [], 0

        def add(some: list[tuple[int, np.ndarray]]) -> None:
            grams, table = self.counts([part for _, part in some], _CELLS if len(some) > 1 else 0)
            if table is None:  # too many n-grams to count at once
                add(some[: len(some) // 2])
                add(some[len(some) // 2 :])
                return
            for k in range(0, len(grams), 8192):  # whole numbers that float32 holds
                np.add.at(out, [i for i, _ in some], table[:, k : k + 8192] @ self.bound(grams[k : k + 8192]))

        def flush() -> None:
            add(group)
            group.clear()

        for i, text in enumerate(texts):
            codes = self.letters(text)
            for k in range(0, max(1, len(codes) - self.n + 1), _CHARS):
                part = codes[k : k + _CHARS + self.n - 1]
                group.append((i, part))
                held += len(part)
                if held >= _CHARS:
                    flush()
                    held = 0
        if group:
            flush()
        return out


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, their prototypes) of rows(lang, text); null langs and texts don't count."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        for b in batches:
            langs = b.column(0).to_pylist()
            own = sorted(set(langs))
            texts = b.column(1).to_pylist()
            for x in own:
                bundle = space.bundles([t for t, y in zip(texts, langs, strict=True) if y == x]).sum(0, dtype=np.float64)
                sums[x] = sums.get(x, 0) + bundle
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], names=["lang", "v"])

    known = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    parts = known.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vectors = np.array([[p["x"] for p in r["v"]] for r in found]).reshape(len(found), DIM)
    return [r["lang"] for r in found], vectors


def identify(df: DataFrame, languages: list[str], prototypes: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, lang_pred, score (softmax of the cosines, 0 to 1).

    A text that is null or has no letters is `und` with score 0, as is any text if no language was learned. Ties go to
    the first language by name. Other columns of df are not used.
    """
    small_batches(df.sparkSession)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    mean = unit(prototypes).mean(0) if len(languages) > 1 else np.zeros(DIM)
    centred = unit(unit(prototypes) - mean).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            bundle = space.bundles(texts)
            none = np.array([not any(map(str.isalpha, t)) for t in texts], bool)
            if languages:
                cos = unit(unit(bundle) - mean.astype(np.float32)) @ centred.T
                e = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)))
                share, best = e / e.sum(1, keepdims=True), cos.argmax(1)
            else:
                share, best, none = np.zeros((len(bundle), 1)), np.zeros(len(bundle), int), np.ones(len(bundle), bool)
            pred = [UNDETERMINED if x else languages[k] for x, k in zip(none, best, strict=True)]
            score = np.where(none, 0.0, share[np.arange(len(best)), best]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
