"""Relational building blocks over ordered rows. Order is always a column, with a unique last key, never the rows' own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; n may be an expression, such as a quota by form."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def quota(column: str, quotas: dict[str, int]) -> Column:
    """Quota of a row by its value of column; others have none."""
    return reduce(lambda c, kv: F.when(F.col(column) == kv[0], kv[1]).otherwise(c), quotas.items(), F.lit(0))


def disambiguate(df: DataFrame, key: str, suffix: Column) -> DataFrame:
    """Keys that occur repeatedly get `_` and a suffix; the others stay."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit("_"), suffix)).otherwise(F.col(key)))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't unique, with their counts; empty if all are."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pending(work: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet marked done, by id and whatever else (version, time) must agree."""
    return work.join(state.where("status = 'done'").select(*keys).distinct(), keys, "left_anti")


def finished(work: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(state.where("status = 'done'").select(*keys).distinct(), keys, "left_semi")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows that new replaces (null keys equal), and new; columns may be added."""
    a, b = table.alias("a"), new.select(*keys).distinct().alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, same, "left_anti").unionByName(new, allowMissingColumns=True)


def neighbours(df: DataFrame, key: str, partition: list[str], order: list[Column]) -> DataFrame:
    """prev_ and next_ key in order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(f"prev_{key}", F.lag(key).over(w)).withColumn(f"next_{key}", F.lead(key).over(w))


def islands(df: DataFrame, starts: Column, partition: list[str], order: list[Column], name: str = "island") -> DataFrame:
    """Number of starts up to each row: runs of rows between starts share it. starts may use window functions."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_starts", starts.cast("int")).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def carry_forward(df: DataFrame, value: Column, reset: Column, partition: list[str], order: list[Column], name: str = "carried") -> DataFrame:
    """The last non-null value since the last reset."""
    df = islands(df, reset, partition, order, "_island")
    w = Window.partitionBy(*partition, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w)).drop("_island")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of the same keys at or before it; null if there is none.

    Both sides are sorted together and values carried forward, so the join costs one shuffle and no pairs.
    """
    packed = F.struct(*[F.col(v) for v in values])
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_value"))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), packed.alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", *[F.col("_last").getField(v).alias(v) for v in values])


def best_unique(df: DataFrame, partition: list[str], score: str, order: list[Column]) -> DataFrame:
    """The best-scored row of each group, the first of equals, and whether it is alone with its score."""
    w = Window.partitionBy(*partition).orderBy(F.desc(score), *order)
    ranked = df.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where("_k = 1").withColumn("is_unique", F.col("_next").isNull() | (F.col(score) > F.col("_next"))).drop("_k", "_next")


def ordered_distinct(value: str, order: str) -> Column:
    """Aggregate: distinct values by first place."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]))


def nearest_rank(values: Column, p: float) -> Column:
    """Quantile of a sorted array by nearest rank."""
    n = F.size(values)
    return F.element_at(values, F.least(n, F.floor(F.lit(p) * (n - 1) + 0.5).cast("int") + 1))


def cell_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """Crosstab with margins in long form: a null row or column is the margin."""
    return df.cube(row, column).agg(F.count(F.lit(1)).alias("n"))


def hashed_order(key: Column, seed: str) -> Column:
    """A seeded order that each engine computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def greedy_groups(items: Column, cost: str, limit: int, base: int = 0) -> Column:
    """Group number of each item of an array when packed in order: an item that would pass limit opens a group."""
    zero = F.struct(F.lit(0).alias("g"), F.lit(base).cast("long").alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def put(acc: Column, item: Column) -> Column:
        opens = (acc["n"] > 0) & (acc["size"] + item[cost] > limit)
        g = acc["g"] + opens.cast("int")
        size = F.when(opens, F.lit(base).cast("long")).otherwise(acc["size"]) + item[cost]
        return F.struct(g.alias("g"), size.cast("long").alias("size"), F.when(opens, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(items, zero, put, lambda acc: acc["out"])
