"""Registered queries: selection, joins, aggregation, windows and sets over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import relational as R
from ledgerloom.plans.registry import Registry, table

registry = Registry()
query = registry.query


@query("SELECT o_orderkey, o_custkey, o_totalprice, round(o_totalprice / 1000, 2) AS in_thousands FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def scan_project_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", F.round(F.col("o_totalprice") / 1000, 2).alias("in_thousands"))


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END""")
def topn_per_group_quota(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    top = R.top_per_group(rows, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.col("o_orderkey")], R.quota("o_orderstatus", {"F": 1, "O": 2}))
    return top.drop("o_orderdate")


@query("SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_custkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name").dropna(subset=["c_custkey"])
    return R.keep_first(rows, ["c_nationkey"], [F.col("c_custkey")])


@query("SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN o_custkey || '_' || right(CAST(o_orderkey AS VARCHAR), 6) ELSE CAST(o_custkey AS VARCHAR) END AS filing_id FROM orders")
def dup_disambiguate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("filing_id"))
    return R.disambiguate(rows, "filing_id", F.right(F.col("o_orderkey").cast("string"), F.lit(6)))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.repeated_keys(table(spark, sf, "orders"), ["o_custkey"])


@query("""SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def pivot_counts_fill(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    rows = table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0)
    return rows.select("c_custkey", *[F.col(s).alias(f"n_{s.lower()}") for s in ("F", "O", "P")])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark: SparkSession, sf: str) -> DataFrame:
    return R.cell_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((), (event_type))")
def grouping_sets_all_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "value")
    return rows.groupingSets([[], [F.col("event_type")]], "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT c_custkey, coalesce(a.n_name, b.n_name) AS nation FROM customer LEFT JOIN nation a ON c_nationkey = a.n_nationkey AND a.n_regionkey < 2
LEFT JOIN nation b ON c_nationkey % 10 = b.n_nationkey""")
def left_join_fallback_key(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    first = nation.where("n_regionkey < 2").select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("name1"))
    second = nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name2"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = rows.join(first, F.col("c_nationkey") == F.col("k1"), "left").join(second, F.col("c_nationkey") % 10 == F.col("k2"), "left")
    return rows.select("c_custkey", F.coalesce("name1", "name2").alias("nation"))


def _order_state(spark: SparkSession, sf: str) -> DataFrame:
    done = F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), done.alias("status"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def semi_join_done(spark: SparkSession, sf: str) -> DataFrame:
    return R.finished(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), _order_state(spark, sf), ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def anti_join_pending(spark: SparkSession, sf: str) -> DataFrame:
    return R.pending(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), _order_state(spark, sf), ["l_orderkey"])


@query("SELECT a.n_regionkey AS region, a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    rows = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return rows.select(F.col("a.n_regionkey").alias("region"), F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part),
t AS (SELECT p_brand, size, count(*) AS n_same FROM p GROUP BY ALL)
SELECT p_partkey, n_same FROM p JOIN t ON p.p_brand = t.p_brand AND p.size IS NOT DISTINCT FROM t.size""")
def null_safe_self_join(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    t = p.groupBy(F.col("p_brand").alias("b"), F.col("size").alias("s")).agg(F.count(F.lit(1)).alias("n_same"))
    return p.join(t, (p["p_brand"] == t["b"]) & p["size"].eqNullSafe(t["s"])).select("p_partkey", "n_same")


@query("""SELECT a.event_id, b.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_last_event(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    rest = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return R.as_of(rest, bought, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query("""WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, 0.0::DOUBLE AS ms FROM region UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.0::DOUBLE FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer),
up AS (SELECT id, parent AS top, ms FROM edges WHERE id LIKE 'c%' UNION ALL SELECT up.id, e.parent, up.ms FROM up JOIN edges e ON up.top = e.id WHERE e.parent IS NOT NULL)
SELECT top AS root, count(*) AS n, round(sum(ms), 2) AS total FROM up WHERE top LIKE 'r%' GROUP BY 1""")
def recursive_tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves summed at their root by climbing parents one level a round; a round ends when nothing is left to climb."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"))
    edges = edges.unionByName(region.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    at = customer.groupBy(name("n", "c_nationkey").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"))
    for _ in range(2):  # the depth of the tree
        at = at.join(edges, at["at"] == edges["id"], "left").groupBy(F.coalesce("parent", "at").alias("at")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return at.select(F.col("at").alias("root"), "n", F.round("total", 2).alias("total"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top FROM events GROUP BY 1")
def quantile_p50_p95(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return table(spark, sf, "events").groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("value").alias("top"))


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS p95 FROM v WHERE k = least(n, CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1)""")
def nearest_rank_quantile(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("event_type")
    rows = table(spark, sf, "events").select("event_type", "value").where("value is not null")
    rows = rows.withColumn("k", F.row_number().over(by.orderBy("value"))).withColumn("n", F.count(F.lit(1)).over(by))
    return rows.where(F.col("k") == F.least("n", F.floor(F.lit(0.95) * (F.col("n") - 1) + 0.5) + 1)).select("event_type", F.col("value").alias("p95"))


@query("""WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a,
rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part)
SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def corr_spearman(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_brand", "p_size", "p_retailprice")
    rank = lambda c: F.rank().over(Window.partitionBy("p_brand").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("p_brand", c)) - 1) / 2
    rows = rows.withColumn("a", rank("p_size")).withColumn("b", rank("p_retailprice"))
    return rows.groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("pearson"), F.round(F.corr("a", "b"), 6).alias("spearman"))


@query("SELECT user_id, event_type FROM events WHERE value > 20 EXCEPT ALL SELECT user_id, event_type FROM events WHERE value <= 20")
def multiset_except(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    side = lambda test: e.where(test).select("user_id", "event_type")
    return side("value > 20").exceptAll(side("value <= 20"))


@query("""SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier)""")
def set_union_intersect_except(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.exceptAll(b).distinct().join(b, "k", "left_anti")))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def ordered_distinct_list(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return first.groupBy("user_id").agg(F.array_join(R.ordered_distinct("event_type", "at"), ",").alias("kinds"))


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lag_lead_links(spark: SparkSession, sf: str) -> DataFrame:
    return R.neighbours(table(spark, sf, "conversations").select("conv_id", "turn"), "turn", ["conv_id"], [F.col("turn")])


@query("""WITH s AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n FROM g GROUP BY ALL""")
def gaps_islands_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = R.islands(rows, ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), ["user_id"], [F.col("ts"), F.col("event_id")])
    return rows.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM s""")
def carry_forward_reset(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    out = R.carry_forward(rows, F.when(F.col("event_type") == "click", F.col("value")), F.col("event_type") == "purchase", ["user_id"], [F.col("ts"), F.col("event_id")])
    return out.select("event_id", "carried")


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1")
def argmax_per_group(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("p_partkey")
    return table(spark, sf, "part").groupBy("p_brand").agg(best, F.max("p_retailprice").alias("p_retailprice"))


@query("""SELECT o_custkey, o_orderkey, next_score IS NULL OR score > next_score AS is_unique FROM (SELECT o_custkey, o_orderkey, score,
lead(score) OVER w AS next_score, row_number() OVER w AS k FROM (SELECT *, CAST(floor(o_totalprice / 100000) AS BIGINT) AS score FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey)) WHERE k = 1""")
def best_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100_000).alias("score"))
    return R.best_unique(rows, ["o_custkey"], "score", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "is_unique")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('11:' || event_id), event_id) <= 12")
def stratified_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "event_id")
    return R.top_per_group(rows, ["event_type"], [R.hashed_order(F.col("event_id"), "11"), F.col("event_id")], 12).drop("rank")


@query("""SELECT 'all' AS stage, c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'new', c_custkey, c_acctbal + 1 FROM customer WHERE c_acctbal < 0""")
def upsert_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.lit("all").alias("stage"), "c_custkey", "c_acctbal")
    new = rows.where("c_acctbal < 0").select(F.lit("new").alias("stage"), "c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return R.upsert(rows, new, ["c_custkey"])


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS found FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11', 'CHINA', 'JAPAN', 'FRANCE') GROUP BY 1")
def member_probe(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("NATION_3", "NATION_7", "NATION_11", "CHINA", "JAPAN", "FRANCE")))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.array_intersect(F.collect_set("n_name"), wanted)).alias("f"))
    return rows.where(F.size("f") > 0).select("n_regionkey", F.array_join("f", ",").alias("found"))


@query("""SELECT count(*) AS n, round(avg(value), 6) AS mean, round(avg((value > 50)::INT), 6) AS over_50, round(quantile_cont(value, 0.5), 6) AS p50
FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)""")
def service_window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").select("ts", "event_id", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    over = (F.col("value") > 50).cast("int")
    return last.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(over), 6).alias("over_50"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
