"""Evaluation: ranking metrics, summaries, paired tests. One row per question and list; metrics are grouped sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import draws

CUTS = (1, 3, 5, 10)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, doc: str, group: str = "fact") -> DataFrame:
    """One row per query of gold(query, group, doc): the metrics of ranked(query, doc, rank).

    Precision at 3 is over 3; recall at 5 is over at most 5; nDCG is binary and ideal over at most 10; all_hit asks each
    group for a hit, fact_recall gives the share of groups with one in the first ten. first_rank is null without a hit.
    """
    golds = gold.select(query, doc).distinct()
    size = golds.groupBy(query).agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranked.join(golds, [query, doc], "left_semi")
    facts = gold.select(query, group, doc).join(ranked, [query, doc], "left").groupBy(query, group).agg(F.min("rank").alias("r"))
    return _metrics(size, hits, facts, [query])


def class_metrics(ranked: DataFrame, asked: DataFrame, docs: DataFrame, query: str, doc: str, kind: str, group: str, runs: dict[str, list[str]] | None = None) -> DataFrame:
    """ranking_metrics() where the gold of asked(query, kind) is all of docs(doc, kind, group) of its kind but itself.

    The gold is counted by kind and group, so no row is made for a pair of a query and a gold document. A document has one
    kind and group. Where runs names a column of ranked and its values, there is a row for each of them and each query.
    """
    asked, docs, per = _by_class(asked, docs, query, doc, kind, group)
    keys = [*(runs or ()), query]
    for run, names in (runs or {}).items():
        per = per.withColumn(run, F.explode(F.array(*map(F.lit, names))))
    size = per.groupBy(*keys).agg(F.sum("_c").alias("n_gold"))
    hits = _class_hits(ranked, asked, docs, query, doc, kind).select(*keys, group, "rank")
    facts = per.select(*keys, group).join(hits.groupBy(*keys, group).agg(F.min("rank").alias("r")), [*keys, group], "left")
    return _metrics(size, hits, facts, keys)


def _by_class(asked: DataFrame, docs: DataFrame, query: str, doc: str, kind: str, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct queries and documents, and (query, group, _c): the documents of each group of a query's kind but itself."""
    asked = asked.select(query, kind).where(F.col(query).isNotNull()).distinct()
    docs = docs.select(doc, kind, group).where(F.col(doc).isNotNull()).distinct()
    sizes = docs.groupBy(kind, group).agg(F.count(F.lit(1)).alias("_n"))
    own = docs.select(F.col(doc).alias(query), kind, group, F.lit(1).alias("_own"))
    per = asked.join(sizes, kind).join(own, [query, kind, group], "left")
    return asked, docs, per.select(query, group, (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("_c")).where("_c > 0")


def _class_hits(ranked: DataFrame, asked: DataFrame, docs: DataFrame, query: str, doc: str, kind: str) -> DataFrame:
    return ranked.join(asked, query).join(docs, [doc, kind]).where(F.col(query) != F.col(doc))


def _metrics(size: DataFrame, hits: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics from (*keys, n_gold), ranked gold documents (*keys, rank), and (*keys, group, r) with each group's first rank."""
    at = lambda k: F.count_if(F.col("rank") <= k)
    hit = hits.groupBy(*keys).agg(F.min("rank").alias("first_rank"), *[at(k).alias(f"_h{k}") for k in CUTS], F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("_dcg"))
    facts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f"), F.count_if(F.col("r") <= 5).alias("_f5"), F.count_if(F.col("r") <= 10).alias("_f10"))
    rows = size.join(facts, keys).join(hit, keys, "left").na.fill(0, [f"_h{k}" for k in CUTS]).na.fill(0.0, ["_dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return rows.select(
        *keys,
        (F.col("_h3") / 3).alias("precision_3"),
        (F.col("_h5") / F.least("n_gold", F.lit(5))).alias("recall_5"),
        *[(F.col(f"_h{k}") > 0).cast("int").alias(f"hit_{k}") for k in CUTS],
        F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")).otherwise(F.lit(0.0)).alias("mrr_10"),
        (F.col("_dcg") / ideal).alias("ndcg_10"),
        (F.col("_f5") == F.col("_f")).cast("int").alias("all_hit_5"),
        (F.col("_f10") == F.col("_f")).cast("int").alias("all_hit_10"),
        (F.col("_f10") / F.col("_f")).alias("fact_recall_10"),
        F.col("first_rank").cast("long"),
    )


def summary(per_query: DataFrame, metrics: list[str], by: str, latency: str | None = None) -> DataFrame:
    """Means overall (by is null) and by type, and exact latency quantiles."""
    means = [F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics]
    times = [F.round(F.percentile(latency, F.lit(q)), 6).alias(f"{latency}_p{round(q * 100)}") for q in (0.5, 0.95)] if latency else []
    n = F.count(F.lit(1)).alias("n")
    total = per_query.agg(n, *means, *times).select(F.lit(None).cast(per_query.schema[by].dataType).alias(by), "*")
    return total.unionByName(per_query.groupBy(by).agg(n, *means, *times))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: fixed (only b), broke (only a), exact two-sided p.

    Binomial terms come by the recurrence C(n, i) = C(n, i - 1) (n - i + 1) / i in logarithms, so that none underflows early.
    """
    counts = pairs.agg(F.count_if(~F.col(a) & F.col(b)).alias("fixed"), F.count_if(F.col(a) & ~F.col(b)).alias("broke"))
    n, k = F.col("fixed") + F.col("broke"), F.least("fixed", "broke")
    log0 = -n * F.log(F.lit(2.0))
    first = F.struct(log0.alias("t"), F.exp(log0).alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("t"), (acc["s"] + F.exp(term)).alias("s"))

    p = F.least(F.lit(1.0), 2 * F.aggregate(steps, first, add, lambda acc: acc["s"]))
    return counts.select("fixed", "broke", F.when(n == 0, F.lit(1.0)).otherwise(p).alias("p"))


#: Rows that one task numbers, about.
NUMBERED_ROWS = 100_000


def numbered(rows: DataFrame, key: str, count: int, most: int = NUMBERED_ROWS) -> DataFrame:
    """rows(key, ...) with i from 0 in the order of the key, null last: ranges of the key are numbered each on its own.

    The ranges' bounds are keys picked by hash, about a hundred for each range, and their sizes are counted.
    """
    parts = -(-count // most)
    bounds = []
    if parts > 1:
        some = rows.where(f"{key} IS NOT NULL").where(F.pmod(F.xxhash64(key), F.lit(max(1, count // (100 * parts)))) == 0)
        picked = sorted(r[0] for r in some.select(key).distinct().collect())
        bounds = sorted({picked[len(picked) * b // parts] for b in range(1, parts)} if picked else set())
    at = sum((F.when(F.col(key) < b, 0).otherwise(1) for b in bounds), F.lit(0))
    rows = rows.withColumn("_part", at)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(key))) - 1
    if not bounds:
        return rows.withColumn("i", place.cast("long")).drop("_part")
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # a row for each range
    before = F.element_at(F.create_map(*[F.lit(x).cast(t) for p in range(len(bounds) + 1) for x, t in ((p, "int"), (sum(sizes.get(q, 0) for q in range(p)), "long"))]), F.col("_part"))
    return rows.withColumn("i", before + place).drop("_part")


#: Rounds of a bootstrap.
ROUNDS = 10_000
#: Differences that every worker may hold, 32 MB; draws from more are joined with them.
HELD_ROWS = 4_000_000
#: Slots that one row of work covers at most, and its draws, about; rows of work of a task.
SLOTS, DRAWS, TASK = 16_384, 1_048_576, 8


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, n: int = ROUNDS, seed: str = "0", held: int = HELD_ROWS) -> DataFrame:
    """One row: the mean difference b - a, its 2.5 and 97.5 % bootstrap bounds, and whether 0 lies outside.

    Each round draws as many rows as there are, by hash of seed, round and place, so any engine draws the same. Draws are
    made in tasks, each of some slots in some rounds, and summed there: no draw is a row, unless there are more differences
    than are held.
    """
    count = pairs.count()
    rows = pairs.select(F.col(key).alias("_k"), (F.col(b).cast("double") - F.col(a).cast("double")).alias("d"))
    mean = rows.agg(F.avg("d").alias("diff"))
    values = numbered(rows, "_k", count).select("i", "d")
    if count <= held:
        means = _drawn(values, count, n, seed).groupBy("round").agg((F.sum("s") / F.sum("c")).alias("m"))
    else:
        means = _draws(values, count, n, seed).join(values.hint("shuffle_hash"), "i").groupBy("round").agg(F.avg("d").alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return mean.crossJoin(bounds).select("diff", "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def _work(like: DataFrame, count: int, n: int) -> tuple[DataFrame, Callable[[int], tuple[range, range]]]:
    """Ids of the rows of work, spread over tasks, and the rounds and slots of an id: some slots in some rounds each."""
    slots = max(1, min(count, SLOTS))
    rounds = max(1, DRAWS // slots)
    blocks = -(-count // slots)
    units = blocks * -(-n // rounds)

    def of(i: int) -> tuple[range, range]:
        r, s = i // blocks * rounds, i % blocks * slots
        return range(r, min(n, r + rounds)), range(s, min(count, s + slots))

    spark = like.sparkSession
    return spark.range(0, units, 1, max(1, min(units, max(spark.sparkContext.defaultParallelism, -(-units // TASK))))), of


def _drawn(values: DataFrame, count: int, n: int, seed: str) -> DataFrame:
    """(round, s, c): sum and count of the differences that are no null, of some draws of a round."""
    got = values.toArrow()  # 16 bytes a row, as many rows as are held
    diffs, known = np.zeros(count), np.zeros(count, bool)
    at, d = got["i"].to_numpy(), got["d"]
    diffs[at], known[at] = d.fill_null(0.0).to_numpy(), d.is_valid().to_numpy()
    shared = values.sparkSession.sparkContext.broadcast((diffs, None if known.all() else known))
    ids, of = _work(values, count, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        diffs, known = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for rounds, at in draws.places(seed, *of(i), count):
                    c = np.full(len(rounds), at.shape[1]) if known is None else known[at].sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(rounds, pa.int64()), pa.array(diffs[at].sum(axis=1)), pa.array(c, pa.int64())], names=["round", "s", "c"])

    return ids.mapInArrow(run, "round bigint, s double, c bigint").where("c > 0")


def _draws(values: DataFrame, count: int, n: int, seed: str) -> DataFrame:
    """(round, i): the place of each draw."""
    ids, of = _work(values, count, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for rounds, at in draws.places(seed, *of(i), count):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rounds, at.shape[1]), pa.int64()), pa.array(at.ravel())], names=["round", "i"])

    return ids.mapInArrow(run, "round bigint, i bigint")


def agreement(rows: DataFrame, a: str, b: str, side: float = 0.5) -> DataFrame:
    """One row: n, Pearson, Spearman (average ranks), mean absolute difference, share on the same side, over rows both judged."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))).select(F.col(a).alias("_a"), F.col(b).alias("_b"))

    def ranks(c: str) -> DataFrame:
        """Average rank of each distinct value: the running sum goes over values, not rows."""
        counts = both.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        upto = F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy(c))
        return counts.select(c, (upto - (F.col("k") - 1) / 2).alias(f"{c}_rank"))

    ranked = both.join(ranks("_a"), "_a").join(ranks("_b"), "_b")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("pearson"), F.corr("_a_rank", "_b_rank").alias("spearman"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_abs_diff"), F.avg(((F.col("_a") >= side) == (F.col("_b") >= side)).cast("double")).alias("same_side"))


def pool_recall(pool: DataFrame, gold: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, hit, recall) of each query of gold: recall is over the smaller of gold and pool."""
    golds = gold.select(query, doc).distinct()
    return _recall(pool, golds.groupBy(query).agg(F.count(F.lit(1)).alias("_g")), pool.join(golds, [query, doc], "left_semi"), query)


def class_pool_recall(pool: DataFrame, asked: DataFrame, docs: DataFrame, query: str, doc: str, kind: str, group: str) -> DataFrame:
    """pool_recall() where the gold is that of class_metrics()."""
    asked, docs, per = _by_class(asked, docs, query, doc, kind, group)
    return _recall(pool, per.groupBy(query).agg(F.sum("_c").alias("_g")), _class_hits(pool, asked, docs, query, doc, kind), query)


def _recall(pool: DataFrame, golds: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    sizes = pool.groupBy(query).agg(F.count(F.lit(1)).alias("_p"))
    found = hits.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    rows = golds.join(sizes, query, "left").join(found, query, "left").na.fill(0, ["_p", "_n"])
    base = F.least("_g", "_p")
    return rows.select(query, (F.col("_n") > 0).cast("int").alias("hit"), F.when(base > 0, F.col("_n") / base).otherwise(F.lit(0.0)).alias("recall"))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows(qid, type, answer, answer_values, expected_change, expected_pct) with values_ok, calc_ok (nullable) and correct."""
    from ledgerloom.functions import numbers as N

    plain = F.regexp_replace("answer", r"\[\d+\]", " ")
    said = F.filter(F.transform(N.number_tokens(plain), lambda t: F.abs(N.token_value(t))), lambda v: v.isNotNull())
    rows = rows.withColumn("_said", said)
    stated = lambda v: F.exists("_said", lambda s: N.matches(s, F.abs(N.token_value(v))) | (s == F.round(F.abs(N.token_value(v)) / 1000, 1)) | (s == F.round(F.abs(N.token_value(v)) / 1000, 2)))
    values = F.forall("answer_values", lambda v: F.coalesce(stated(v), F.lit(False)))
    change, pct = F.abs(F.col("expected_change")), F.abs(F.col("expected_pct"))
    change_ok = F.exists("_said", lambda s: (F.abs(s - change) < 0.5) | (s == F.round(change / 1000, 1)) | (s == F.round(change / 1000, 2)))
    pct_ok = F.exists("_said", lambda s: F.abs(s - pct) <= 0.06)
    calc = F.when(F.col("type") == "pct_change", pct_ok).when(F.col("expected_change").isNotNull(), change_ok)
    rows = rows.withColumn("values_ok", values).withColumn("calc_ok", calc)
    correct = F.when(F.col("type") == "pct_change", F.col("calc_ok")).otherwise(F.col("values_ok") & F.coalesce("calc_ok", F.lit(True)))
    return rows.withColumn("correct", F.coalesce(correct, F.lit(False))).drop("_said")
