"""Mixing sources to target weights.

Tokens are summed for each source; a source's target is its share of all tokens by weight, but at most max_repeats
times what it has, the excess being shared again by weight among the others. Its rate is target / tokens. A document
is emitted floor(rate) times and once more if a number drawn from the hash of its id is below rate's fraction, so a
rerun on any cluster draws the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, cut, word_count

SEED = "mix-1"
#: 52 bits of the hash: exact as a double.
_HEX, _RANGE = 13, float(16**13)


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) drawn from the hash of key; null keys draw as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long") / F.lit(_RANGE)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: float = 3.0, key: str = "source") -> DataFrame:
    """One row (key, source_size, target) for each source of sizes(key, size).

    Sources in code-point order, null last, get the weights in turn. Water-filling in closed form: in order of
    capacity / weight, sources are full up to some place, and the rest share what is left by weight. This works on one
    row per source; documents are summed before it.
    """
    per = sizes.groupBy(key).agg(F.sum("size").cast("long").alias("source_size"))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(key).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col(key).asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before, upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("w").over(upto))
    # From the first source that isn't filled on, its level holds for all.
    open_level = F.first(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select(key, "source_size", F.when(open_level.isNull(), F.col("cap")).otherwise(open_level * F.col("w")).alias("target"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), seed: str = SEED, **options) -> DataFrame:
    """One row for each row of df: doc_id, size, source_size, target, rate, copies, taken, and the columns in keep.

    Size is the number of words; a null text has none. A source without words has target and rate 0. Rows that share a
    doc_id draw alike. An empty table gives no rows.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.struct(F.col(source).alias("v")).alias("_s"), word_count(F.col(text)).alias("size"), *keep)
    targets = cut(source_targets(rows.select(F.col("_s.v").alias("source"), "size"), **options).select(F.struct(F.col("source").alias("v")).alias("_t"), "source_size", "target"))
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(targets) if few else targets, F.col("_s").eqNullSafe(F.col("_t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)
    extra = (uniform(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    out = out.withColumn("copies", F.floor("rate") + extra).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", "taken", *keep)


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """df with each row repeated as often as mix() says; its columns stay as they are."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    rows = whole.select(F.col("_row").getField(doc_id).alias(doc_id), F.col("_row").getField(text).alias(text), F.col("_row").getField(source).alias(source), "_row")
    copies = mix(rows, doc_id, text, source, keep=("_row",), **options)
    return copies.where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
