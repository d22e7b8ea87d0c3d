"""Which filter removes what: each document is run through its filters in every order.

Five filters give each document five flags. The documents are crossed with the 120 orders, which are broadcast (their
number is that of the permutations and doesn't grow), each pair is exploded into five steps, and the first step whose
filter fails the document tells what each step does with it. Counts by part, order and step are combined in the task
that makes the rows, so that only one row for each part, order, step and task is shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, WORD, cut

FILTERS = "ABCDE"
#: Failure conditions: fewest words, distinct words in a hundred words, capitals in a hundred code points, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"


def orders(spark: SparkSession) -> DataFrame:
    """One row (filter_order, b1 … b5) for each of the 120 orders; b holds the bit of each step's filter."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = ", ".join(f"('{''.join(p)}', {', '.join(str(bit[f]) for f in p)})" for p in permutations(FILTERS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS o(filter_order, {', '.join(f'b{i}' for i in range(1, len(FILTERS) + 1))})")


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D of a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [sizes["n"] < LEAST_WORDS, 100 * sizes["d"].cast("long") < LEAST_DISTINCT * sizes["n"].cast("long"), 100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), F.rlike(text, F.lit(f"[{SYMBOLS}]"))]


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if its counted rows are few; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def flags(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row (part, mask, good, toxic) for each row of df; mask has the bits of the filters that fail it.

    Filter E fails what is identical to the text of any smaller doc_id. Texts are told apart by length and SHA-256.
    A document is good (toxic) if any of its labels has quality = 1 (toxic = 1).
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).alias("doc_id"), body.alias("text"))
    own = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    facts = cut(rows.select("part", "doc_id", own.alias("own"), F.struct(F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("h")).alias("key")))
    groups = facts.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", "least")
    groups = cut(groups)
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("labelled IS NOT NULL AND (good OR toxic)")
    known = cut(known)
    out = facts.join(_few(groups), "key", "left").join(_few(known), F.col("doc_id") == F.col("labelled"), "left")  # hot texts are split by the adaptive skew join
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select("part", (F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), yes("good"), yes("toxic"))


def replay(flagged: DataFrame) -> DataFrame:
    """One row for each part, order and step, with what the step does to the part's documents.

    flagged: flags(). Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley.
    """
    n = len(FILTERS)
    crossed = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession)))
    fails = lambda i: F.col("mask").bitwiseAND(F.col(f"b{i}")) != 0
    first = F.lit(n + 1)
    for i in range(n, 0, -1):
        first = F.when(fails(i), i).otherwise(first)
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"b{i}").alias("bit")) for i in range(1, n + 1)])))
    here = F.col("first") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (F.col("mask").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        F.count_if(F.col("mask") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("_filter", letter).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_filter"))).drop("_filter")


def audit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """replay() of the rows of df in each part: 600 rows for each value of `part`, zeros included.

    A null text counts as empty (it fails A only), a null part as the empty string. Equal rows each count; of rows with
    the same text and the same smallest doc_id none fails E, and a row without a doc_id neither fails E nor makes
    others fail. Labels of other documents count for nothing, repeated ones once. An empty table gives no rows. Other
    columns of df aren't used.
    """
    return replay(flags(df, labels, doc_id, text, part))
