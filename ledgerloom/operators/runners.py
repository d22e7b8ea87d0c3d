"""Running models over tables: replies remembered by key, vectors remembered by content, pairs scored in bounded batches.

A model is given as a factory, a plain function without arguments that each task calls once and that returns a function
of a list. Tables of what is known are append-only: a run reads what is there, calls the model for what isn't, and
appends. Of several rows for a key the one of the latest run counts. A run's rows are a folder of their own that is
there as a whole or not at all, so a run that dies midway is done again from what was there before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import PIECE
from ledgerloom.operators.retrieval import top_k

#: Texts of a call of the model at most, and characters of a call's texts at most; a longer text is a call of its own.
CALL_ROWS, CALL_CHARS = 64, 200_000
#: Tokens of a text that an embedder takes.
MAX_TOKENS = 512
#: Buckets of documents for pairs: a task holds one bucket's texts that the pool names.
PAIR_BUCKETS = 64

Model = Callable[[list], list]


def calls(sizes: list[int], rows: int = CALL_ROWS, chars: int = CALL_CHARS) -> Iterator[list[int]]:
    """Places of items in calls of bounded size, longest first, so that a call's items are of like size."""
    batch, held = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if batch and (len(batch) == rows or held + sizes[i] > chars):
            yield batch
            batch, held = [], 0
        batch.append(i)
        held += sizes[i]
    if batch:
        yield batch


class _Log:
    """An append-only table of runs under `path`; run numbers ascend."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def runs(self) -> list[int]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName().partition("=")[2]) for p in names if p.getName().startswith("run=") and fs.exists(jvm.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """All rows of finished runs, with run."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], f"{self.schema}, run int")
        return self.spark.read.schema(f"{self.schema}, run int").option("basePath", self.path).parquet(*[f"{self.path}/run={r}" for r in runs])

    def append(self, df: DataFrame) -> DataFrame:
        """Writes df as the next run and returns its rows as stored."""
        run = max(self.runs(), default=0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/run={run}")


@dataclass
class Memo:
    """Replies by key. reply_type: the type of a reply, a string if not given."""

    spark: SparkSession
    path: str
    reply_type: str = "string"

    def _log(self) -> _Log:
        return _Log(self.spark, self.path, f"key string, reply {self.reply_type}")

    def known(self) -> DataFrame:
        """(key, reply), the last written of each key."""
        return self._log().rows().groupBy("key").agg(F.max_by("reply", "run").alias("reply"))

    def put(self, rows: DataFrame) -> None:
        """Writes (key, reply) as a run of its own; of rows with the same key one is kept, the largest."""
        self._log().append(rows.groupBy("key").agg(F.max("reply").alias("reply")))

    def ask(self, rows: DataFrame, model: Callable[[], Model], key: str = "key", prompt: str = "prompt", rows_a_call: int = CALL_ROWS) -> DataFrame:
        """rows with reply: what is known of the key, else the model's reply to the prompt, which is remembered.

        The model is called once for each key that isn't known, in calls of bounded size; of rows with the same key
        the smallest prompt is asked. A null key isn't asked and has no reply.
        """
        wanted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(prompt).alias("prompt"))
        missing = wanted.join(self.known(), "key", "left_anti")
        reply = pa.from_numpy_dtype(np.float64) if self.reply_type == "double" else pa.string()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = None
            for b in batches:
                ready = ready or model()
                keys, prompts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for own in calls([len(p or "") for p in prompts], rows_a_call):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own]), pa.array(ready([prompts[i] for i in own]), reply)], names=["key", "reply"])

        self._log().append(missing.mapInArrow(run, f"key string, reply {self.reply_type}"))
        return rows.join(self.known().withColumnRenamed("key", key), key, "left")


def shortened(text: str, most: int) -> tuple[str, bool]:
    """The text up to its `most` first tokens, and whether that cuts it."""
    for n, m in enumerate(re.finditer(PIECE, text)):
        if n == most:
            return text[: m.start()].rstrip(), True
    return text, False


@dataclass
class Embeddings:
    """Vectors by the SHA-256 of the text that was embedded."""

    spark: SparkSession
    path: str
    max_tokens: int = MAX_TOKENS

    def _log(self) -> _Log:
        return _Log(self.spark, self.path, "hash string, v array<double>, truncated boolean")

    def embed(self, rows: DataFrame, model: Callable[[], Model], text: str = "text") -> DataFrame:
        """rows with v and truncated: a stored vector if the text's is there, else the model's, which is stored.

        Equal texts are embedded once, in calls of like lengths. A text of more than max_tokens tokens is cut to them
        first, and says so. A null text has no vector.
        """
        rows = rows.withColumn("_hash", F.sha2(text, 256))
        known = self._log().rows().select("hash")
        new = rows.where(F.col("_hash").isNotNull()).groupBy(F.col("_hash").alias("hash")).agg(F.first(text).alias("text")).join(known, "hash", "left_anti")
        most = self.max_tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = None
            for b in batches:
                ready = ready or model()
                hashes, cut = b.column(0).to_pylist(), [shortened(t, most) for t in b.column(1).to_pylist()]
                for own in calls([len(t) for t, _ in cut]):
                    vectors = [[float(x) for x in v] for v in ready([cut[i][0] for i in own])]
                    yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in own]), pa.array(vectors, pa.list_(pa.float64())), pa.array([cut[i][1] for i in own])], names=["hash", "v", "truncated"])

        self._log().append(new.mapInArrow(run, "hash string, v array<double>, truncated boolean"))
        stored = self._log().rows().groupBy("hash").agg(F.max_by(F.struct("v", "truncated"), "run").alias("_x"))
        return rows.join(stored.withColumnRenamed("hash", "_hash"), "_hash", "left").select(*[c for c in rows.columns if c != "_hash"], "_x.v", "_x.truncated")

    def last_run(self) -> DataFrame:
        """(embedded, truncated) of the last run: texts that it ran, and those of them that were cut."""
        runs = self._log().runs()
        rows = self._log().rows().where(F.col("run") == (runs[-1] if runs else 0))
        return rows.agg(F.count(F.lit(1)).alias("embedded"), F.count_if("truncated").alias("truncated"))


def matched_vectors(nodes: DataFrame, vectors: DataFrame, group: str = "filing_id") -> DataFrame:
    """nodes(group, pos, node_id, …) with v, by position within the group, and ok: the vector there is of this node.

    vectors: (group, pos, node_id, v). Either side may have rows that the other hasn't; those are not ok.
    """
    a, b = nodes.withColumn("_here", F.lit(True)), vectors.select(group, "pos", F.col("node_id").alias("_of"), "v")
    return a.join(b, [group, "pos"], "full_outer").withColumn("ok", F.coalesce(F.col("node_id") == F.col("_of"), F.lit(False))).drop("_of", "_here")


def rerank_batched(pool: DataFrame, questions: DataFrame, docs: DataFrame, query: str, doc: str, k: int, model: Callable[[], Model], text: str = "text", buckets: int = PAIR_BUCKETS, block: int = 2_000) -> DataFrame:
    """(query, doc, score, rank): a pool of pairs ordered by a model of (question, text), the best k of each question.

    Pairs meet the texts by buckets of documents, so that a text is moved and held once however many questions name
    it, and only texts that some pair names are moved. The stated questions are counted and go out in blocks of at most
    `block`. Pairs are scored in calls of like length; equal scores go by document.
    """
    pairs = pool.select(query, doc).distinct().withColumn("_b", F.pmod(F.xxhash64(doc), F.lit(buckets)))
    named = docs.select(doc, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(pairs.select(doc).distinct(), doc, "left_semi").withColumn("_b", F.pmod(F.xxhash64(doc), F.lit(buckets)))
    blocks = max(1, -(-questions.count() // block))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = []
    for n in range(blocks):
        some = questions.select(query, text)
        some = some.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == n) if blocks > 1 else some
        stated = {r[0]: r[1] or "" for r in some.collect()}
        out.append(pairs.groupBy("_b").cogroup(named.groupBy("_b")).applyInArrow(_pair_scores(stated, model, query, doc), f"{query} {kind(pairs, query)}, {doc} {kind(pairs, doc)}, score double"))
    return top_k(reduce(DataFrame.unionByName, out), k, query, doc)


def _pair_scores(stated: dict, model: Callable[[], Model], query: str, doc: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        held = dict(zip(texts.column(doc).to_pylist(), texts.column("_t").to_pylist(), strict=True))
        asked = pairs.column(query).to_pylist()
        rows = [(i, stated[q], held[d]) for i, (q, d) in enumerate(zip(asked, pairs.column(doc).to_pylist(), strict=True)) if q in stated and d in held]
        ready, scores = model() if rows else None, np.zeros(len(rows))
        for own in calls([len(q) + len(t) for _, q, t in rows]):
            scores[own] = ready([rows[i][1:] for i in own])
        at = pa.array([i for i, *_ in rows], pa.int64())
        return pa.table({query: pairs.column(query).take(at), doc: pairs.column(doc).take(at), "score": pa.array(scores)})

    return run


def lexical_pairs() -> Model:
    """Deterministic stand-in for a cross-encoder: the share of a question's distinct tokens that the text has."""

    def tokens(text: str) -> set[str]:
        return set(re.findall(r"[^\W_]+", text.lower()))

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            own = tokens(q)
            out.append(len(own & tokens(t)) / len(own) if own else 0.0)
        return out

    return score
