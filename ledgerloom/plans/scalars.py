"""Registered queries: scalar functions and grid expressions over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import grid_columns as G
from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.operators import locate as L
from ledgerloom.plans.registry import Registry, table

registry = Registry()
query = registry.query

_SUFFIX = "CASE s_suppkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Corp' WHEN 2 THEN ' Corporation' WHEN 3 THEN ' plc' ELSE ' Trust' END"


@query(rf"SELECT s_suppkey, trim(regexp_replace(s_name || {_SUFFIX}, '(?i),?\s+(inc\.?|corp\.?|corporation|incorporated|co\.?|ltd\.?|plc)$', '')) AS short FROM supplier")
def company_short_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr(f"s_name || {_SUFFIX}")
    return table(spark, sf, "supplier").select("s_suppkey", T.short_company(name).alias("short"))


@query(r"""SELECT p_partkey, CASE WHEN lower(substr(p_name, 2, 1)) = substr(p_name, 2, 1) THEN lower(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END AS label,
lower(trim(regexp_replace(replace(' ' || p_type || '* :', '*', ''), '\s+', ' ', 'g'), ' :')) AS norm FROM part""")
def label_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.lower_label(F.col("p_name")).alias("label"), T.norm_label(F.concat(F.lit(" "), F.col("p_type"), F.lit("* :"))).alias("norm"))


_CELL = "CASE o_orderkey % 4 WHEN 0 THEN '$' || c WHEN 1 THEN '(' || c || ')' WHEN 2 THEN c || '%' ELSE 'n/a' END"


@query(f"""WITH x AS (SELECT o_orderkey, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS c FROM orders), y AS (SELECT o_orderkey, {_CELL} AS cell FROM x),
z AS (SELECT o_orderkey, cell, translate(cell, '$, %', '') AS t FROM y)
SELECT o_orderkey, cell, CASE WHEN starts_with(t, '(') THEN -TRY_CAST(trim(t, '()') AS DOUBLE) ELSE TRY_CAST(trim(t, '()') AS DOUBLE) END AS value FROM z""")
def cell_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("c"))
    return rows.select("o_orderkey", F.expr(_CELL).alias("cell")).withColumn("value", N.to_float(F.col("cell")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'fiscal ' || year(o_orderdate) || ' (fiscal year ended ' ELSE 'fiscal ' || year(o_orderdate) || ' Q' || quarter(o_orderdate) || ' (quarter ended ' END || strftime(o_orderdate, '%B %-d, %Y') || ')' AS label FROM orders""")
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    form = F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("10-Q")
    label = T.period_label(form, F.year(day).cast("string"), F.concat(F.lit("Q"), F.quarter(day).cast("string")), day)
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, (o_orderkey % 5)::INT AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 4 THEN 1 ELSE (k <> 3)::INT + (k IN (0, 2))::INT END AS score FROM d""")
def period_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a quarter's column headers: right end and length, right end, other length, other end, year alone."""
    day = F.col("o_orderdate").cast("date")
    written = lambda d: F.date_format(d, "MMMM d, yyyy")
    k = F.col("o_orderkey") % 5
    head = (
        F.when(k == 0, F.concat(F.lit("Three Months Ended "), written(day)))
        .when(k == 1, F.concat(F.lit("Nine Months Ended "), written(day)))
        .when(k == 2, F.concat(F.lit("three months to "), written(day)))
        .when(k == 3, F.concat(F.lit("As of "), written(F.date_add(day, 400))))
        .otherwise(F.year(day).cast("string"))
    )
    score = L.period_score(F.date_sub(day, 91).cast("string"), day.cast("string"), F.lit(None).cast("string"), head)
    return table(spark, sf, "orders").select("o_orderkey", score.alias("score"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


_GRID = "list_transform(list(struct_pack(l := l_linenumber, a := CAST(l_partkey AS VARCHAR), b := l_returnflag || '|' || l_linestatus) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus), lambda x: [CAST(x.l AS VARCHAR), x.a, x.b])"


@query(f"""WITH g AS (SELECT l_orderkey, {_GRID} AS g FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, len(g) AS n, array_to_string(list_transform(g, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\\|')), ' | ') || ' |'), chr(10)) AS body FROM g)
SELECT l_orderkey, CAST(2 * n AS BIGINT) AS n_cells, md5(CASE WHEN contains(body, chr(10)) THEN regexp_replace(body, chr(10), chr(10) || '|---|---|---|' || chr(10)) ELSE body || chr(10) || '|---|---|---|' END) AS digest FROM m""")
def grid_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as a grid, rendered as markdown without Python."""
    row = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    cells = lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), F.concat(x["l_returnflag"], F.lit("|"), x["l_linestatus"]))
    grids = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r")).select("l_orderkey", F.transform("r", cells).alias("g"))
    return grids.select("l_orderkey", F.size(G.cells(F.col("g"))).cast("long").alias("n_cells"), F.md5(G.to_markdown(F.col("g"))).alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'thousands' WHEN doc_id % 4 = 1 THEN 'millions' END AS units,
CASE doc_id % 4 WHEN 0 THEN 'balance' WHEN 1 THEN 'income' WHEN 2 THEN 'cashflow' END AS statement FROM documents""")
def caption_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    caption = (
        F.when(k == 0, "CONSOLIDATED BALANCE SHEETS (Dollars in Thousands)")
        .when(k == 1, "Statements of Operations (in millions)")
        .when(k == 2, "Consolidated statements of cash flows")
        .otherwise("Statements of Comprehensive Income")
    )
    return table(spark, sf, "documents").select("doc_id", T.find_units(caption).alias("units"), T.statement_kind(caption).alias("statement"))
