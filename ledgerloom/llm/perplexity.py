"""Quality classifier: an interpolated modified Kneser-Ney n-gram model, trained on trusted text.

The units are the bytes of a text, ORDER at a time, so that the table of n-grams levels off as the corpus grows. One
pass counts the n-grams of all documents within each worker and sends each distinct one once, with its count in
trusted text. The counts are sharded by n-gram; continuation counts, context sums and discounts come from grouped
counts, and joins by n-gram, context and suffix give each n-gram of the corpus its probability. A second pass looks
the documents' n-grams up, in one shard of at most SHARD_ROWS rows after the other, and sums the log-probabilities of
each document over the shards. A document is kept if its perplexity lies within the quantiles of its language's
trusted texts. One trusted text in FOLDS stays out of the training and gives the upper quantile: texts that the model
has seen are likelier than unseen ones of the same kind, the more so the less there is to train on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, cut, rereadable, small_batches, with_row_id

ORDER = 5
SHARD_ROWS = 4_000_000
#: Quantiles of trusted texts' perplexity, by language; texts with fewer bytes than SHORT aren't judged.
LOW, HIGH, SHORT = 0.001, 0.995, 100
#: A language with fewer trusted texts that stayed out of the training takes the quantiles of all.
FOLDS, LEAST_TRUSTED = 5, 30
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_MERGE = 3_000_000


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): the n-grams of each text, one for each byte, after order - 1 line feeds. Digits count as 0."""
    pad = b"\n" * (order - 1)
    data = [pad + t.encode("utf-8", "surrogatepass").translate(_DIGITS) for t in texts]
    lengths = np.array([len(d) - order + 1 for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    n = max(0, len(flat) - order + 1)
    code = np.zeros(n, np.int64)
    for k in range(order):
        code <<= 8
        code |= flat[k : k + n]
    ends = np.cumsum(np.array([len(d) for d in data], np.int64))
    inside = np.ones(n, bool)
    for k in range(1, order):  # windows over the border of two texts
        inside[ends[:-1] - k] = False
    return code[inside], lengths


def _counted(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(weights, first) if len(first) else weights


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c) for each n-gram of rows(text, trusted); c is its count in trusted texts, perhaps 0."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for trusted in (True, False):
                texts = [t for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and bool(y) == trusted]
                codes, n = np.unique(grams(texts, order)[0], return_counts=True)
                held.append((codes, n * trusted))
                size += len(codes)
            if size > _MERGE:
                held = [_counted(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))]
                size = len(held[0][0]) // 2  # so that merges don't follow one another
        if held:
            codes, n = _counted(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            for k in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + 100_000]), pa.array(n[k : k + 100_000].astype(np.int64))], names=["gram", "c"])

    return rows.select("text", "trusted").mapInArrow(run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; where one is 0, halves of the counts they lower."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k * 0.95) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) for each row of counts(gram, c), by interpolation over all orders; n-grams with c = 0 weren't seen."""
    mask = lambda k: F.lit((1 << (8 * k)) - 1).cast("long")
    seen = {order: counts.where("c > 0")}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct n-grams that end so
        seen[k] = cut(seen[k + 1].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    below: DataFrame | None = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(*seen[k].agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first())
        off: Column = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = seen[k].groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("c").alias("s"), F.sum(off).alias("off"))
        asked = counts.select("gram") if k == order else counts.select(F.col("gram").bitwiseAND(mask(k)).alias("gram")).distinct()
        asked = asked.withColumn("ctx", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram").bitwiseAND(mask(k - 1)))
        got = asked.join(seen[k], "gram", "left").join(context, "ctx", "left")
        got = got.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix") if below is not None else got.withColumn("lower", F.lit(1 / 256))
        own = F.coalesce(F.greatest(F.col("c") - off, F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("s").isNull(), F.col("lower")).otherwise((own + F.col("off") * F.col("lower")) / F.col("s"))
        below = got.select("gram", p.alias("p"))
    return below.select("gram", F.log("p").alias("logp"))


def _lookup(texts: list[str], codes: np.ndarray, logp: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the log-probabilities that this shard has, number of n-grams) of each text."""
    own, lengths = grams(texts, order)
    distinct, back = np.unique(own, return_inverse=True)
    if len(codes):
        at = np.minimum(np.searchsorted(codes, distinct), len(codes) - 1)
        value = np.where(codes[at] == distinct, logp[at], 0.0)
    else:
        value = np.zeros(len(distinct))
    doc = np.repeat(np.arange(len(texts)), lengths)
    return np.bincount(doc, value[back], len(texts)), lengths


def scores(rows: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows(_rid, doc_id, lang, role, text) with (n, logp) in place of the text."""
    spark = rows.sparkSession
    small_batches(spark)
    shards = max(1, math.ceil(model.count() / shard_rows))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    parts: DataFrame | None = None
    for k in range(shards):
        table = model.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == k).toArrow() if shards > 1 else model.toArrow()
        codes, logp = table.column("gram").to_numpy(), table.column("logp").to_numpy()
        by = np.argsort(codes)
        shard = spark.sparkContext.broadcast((codes[by], logp[by].astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            codes, logp = shard.value
            for b in batches:
                total, n = _lookup([t or "" for t in b.column(4).to_pylist()], codes, logp, order)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(n), pa.array(total)], names=["_rid", "doc_id", "lang", "role", "n", "logp"])

        part = rows.select("_rid", "doc_id", "lang", "role", "text").mapInArrow(run, f"{kinds}, n bigint, logp double")
        part = cut(part)  # a shard leaves the driver before the next comes
        shard.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    if shards == 1:
        return parts
    return parts.groupBy("_rid").agg(*[F.max(c).alias(c) for c in ("doc_id", "lang", "role", "n")], F.sum("logp").alias("logp"))


def classify(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", low: float = LOW, high: float = HIGH, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each row of df: doc_id, n_grams, perplexity, low, high, kept. trusted(doc_id) names the trusted texts.

    A null text counts as empty; texts shorter than SHORT bytes, and all if no trusted text stayed out, are kept. A null
    language, or one with few trusted texts, is held against the quantiles of all trusted texts.
    """
    ids = trusted.select(F.col(doc_id).alias("doc_id")).dropna().distinct().withColumn("trusted", F.lit(True))
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = with_row_id(rereadable(df).select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")))
    role = F.when(F.col("trusted").isNull(), "other").when(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, "held out").otherwise("trained")
    rows = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left").select("_rid", "doc_id", "lang", role.alias("role"), "text")
    counts = cut(gram_counts(rows.select("text", (F.col("role") == "trained").alias("trusted")), order))
    if counts.where("c > 0").isEmpty():
        model = counts.select("gram", F.lit(-math.log(256)).alias("logp"))
    else:
        model = cut(log_probabilities(counts, order))
    got = scores(rows, model, order, shard_rows).withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))))
    good = got.where("role <> 'other'").where(F.col("n") >= SHORT)
    held = F.when(F.col("role") == "held out", F.col("perplexity"))
    # What was trained on lies low, so the lower quantile is that of all.
    agg = [F.count(held).alias("m"), F.percentile_approx("perplexity", low, 10_000).alias("low"), F.percentile_approx(held, high, 10_000).alias("high")]
    by_lang = cut(good.where("lang is not null").groupBy("lang").agg(*agg).where(F.col("m") >= LEAST_TRUSTED).select("lang", "low", "high"))
    every = good.agg(*agg).first()
    small = by_lang.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = got.join(F.broadcast(by_lang) if small else by_lang, "lang", "left")
    out = out.withColumn("low", F.coalesce("low", F.lit(every["low"]))).withColumn("high", F.coalesce("high", F.lit(every["high"])))
    kept = (F.col("n") < SHORT) | F.col("high").isNull() | F.col("perplexity").between(F.col("low"), F.col("high"))
    return out.select("doc_id", F.col("n").alias("n_grams"), "perplexity", "low", "high", kept.alias("kept"))
