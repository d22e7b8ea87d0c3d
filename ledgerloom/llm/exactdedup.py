"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted, and a block's place in that order is
its integer name. Then the names of adjacent blocks are paired, and the distinct pairs are sorted and named in turn,
until one integer is left for each document. Two documents have the same (level, name) exactly if their texts are
equal: names are ranks, not hashes, so nothing collides.

Sorting is spread over BUCKETS hash buckets; a name is rank * BUCKETS + bucket, hence unique and the same in each run.
Each text is shuffled once. A value that many rows share would fill one bucket, so the HOT most frequent values are
named beforehand from their distinct values (at most HOT of them, combined before the shuffle, hence broadcast), and
their rows go on without the value, spread over all buckets. Any other value has fewer than 1/HOT of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, cut, rereadable, with_row_id, without_rows

BLOCK_BYTES = 4096
BUCKETS = 65_536
HOT = 512
#: A value with fewer rows than this isn't worth separate treatment.
HOT_ROWS = 64


def _named(df: DataFrame) -> DataFrame:
    """df with `value` replaced by its integer `name`; hot values get negative names."""
    counts = df.groupBy(F.xxhash64("value").alias("h")).count()
    hot = [r["h"] for r in counts.where(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "h").limit(HOT).collect()]
    if hot:
        values = df.where(F.xxhash64("value").isin(hot)).groupBy("value").agg(F.lit(True).alias("hot"))
        ranked = values.select("value", (-F.row_number().over(Window.partitionBy("hot").orderBy("value"))).cast("long").alias("hot_name"))
        df = df.join(F.broadcast(ranked), "value", "left")
        df = df.withColumn("value", F.when(F.col("hot_name").isNull(), F.col("value")))
    else:
        df = df.withColumn("hot_name", F.lit(None).cast("long"))
    spread = F.when(F.col("hot_name").isNull(), F.xxhash64("value")).otherwise(F.xxhash64("_rid", "pos"))
    df = df.withColumn("bucket", F.pmod(spread, F.lit(BUCKETS)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("value")).cast("long")
    return df.withColumn("name", F.coalesce("hot_name", rank * BUCKETS + F.col("bucket"))).drop("value", "hot_name", "bucket")


def identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, normalise=ascii_lower) -> DataFrame:
    """One row (_rid, doc_id, text_sha256, level, name) for each row of df, in which (level, name) is the text's identity.

    A null text counts as empty. Repeated rows and doc_ids are rows of their own. Other columns of df are not used.
    """
    rows = with_row_id(df.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(normalise(F.col(text)), F.lit("")), "UTF-8").alias("bytes")))
    last = F.greatest(F.floor((F.octet_length("bytes") - 1) / block_bytes), F.lit(0)).cast("int")
    block: Column = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    first = lambda c: F.when(F.col("pos") == 0, c)
    blocks = rows.select("_rid", "doc_id", "bytes", (last + 1).alias("n"), F.posexplode(block).alias("pos", "value"))
    blocks = blocks.select("_rid", "pos", "n", "value", first(F.col("doc_id")).alias("doc_id"), first(F.sha2("bytes", 256)).alias("text_sha256"))
    level, done = 0, None
    while True:
        named = cut(_named(blocks).withColumn("level", F.lit(level)))
        ended = named.where("n = 1").select("_rid", "doc_id", "text_sha256", "level", "name")
        done = ended if done is None else done.unionByName(ended)
        more = named.where("n > 1")
        if more.isEmpty():
            return done
        at = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = more.groupBy("_rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.struct(at(0).alias("a"), at(1).alias("b")).alias("value"), F.max(F.ceil(F.col("n") / 2)).cast("int").alias("n"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"))
        blocks, level = pairs.select("_rid", "pos", "n", "value", "doc_id", "text_sha256"), level + 1


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of df: _rid, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept; of rows that share that doc_id too, the last read. A null
    doc_id counts as the smallest. An empty table gives no rows.
    """
    ids = identities(rereadable(df), doc_id, text, **options)
    groups = ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "_rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups)  # so that the join gets an exchange on both sides
    out = ids.join(groups, ["level", "name"])  # a hot identity is split by the adaptive skew join
    return out.select("_rid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("keep._rid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df without the rows that exact_duplicates doesn't keep; its columns stay as they are."""
    df = rereadable(df)
    dropped = cut(exact_duplicates(df, doc_id, text, **options).where(~F.col("kept")).select("_rid"))
    return without_rows(df, dropped)
