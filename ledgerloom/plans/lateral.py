"""Registered queries: table functions in SQL, by LATERAL joins and with a partitioned table as their argument."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import tables
from ledgerloom.plans.filings import _BASE, _PLACED, _ROWS, _figures, _id, _money, _statement
from ledgerloom.plans.registry import Registry, table

registry = Registry()
query = registry.query


def _sql(spark: SparkSession, text: str, rows: DataFrame) -> DataFrame:
    """The result of SQL over `rows` under a name of its own, written {t} in the text."""
    tables.register(spark)
    name = f"t_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return spark.sql(text.format(t=name))
    finally:
        spark.catalog.dropTempView(name)


@query(f"""WITH {_BASE}, {_ROWS}, {_PLACED} SELECT k, 'cell' AS kind, "row", col, label, val::DOUBLE AS value, "column" FROM m
UNION ALL SELECT k, 'header', NULL, NULL, 'company', NULL, NULL FROM v UNION ALL SELECT k, 'prose', NULL, NULL, NULL, v1, NULL FROM v""")
def lateral_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Header lines, cells with their column headers, and numbers of text of each passage."""
    text = F.concat(F.lit("Source 4:\ncompany: Supplier & Co\n\n"), _statement(), F.lit("\nSales of $"), _money("v1"), F.lit(" in all."))
    rows = _figures(spark, sf).select("k", text.alias("context"))
    return _sql(spark, "SELECT k, p.kind, p.`row`, p.col, p.label, p.value, p.`column` FROM {t}, LATERAL passage_parts(context) p", rows)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(w, ' ')) AS words, true AS fit FROM w WHERE len(w) > 0""")
def lateral_text_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in parts of whole sentences: together they have all words in order, and none has more words than tokens are allowed."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    parts = _sql(spark, "SELECT doc_id, p.part, p.text FROM {t}, LATERAL text_parts(text, 200, 0) p", rows)
    fit = F.regexp_count("text", F.lit(r"\S+")) <= 200
    both = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"), F.bool_and(fit).alias("fit"))
    return both.select("doc_id", F.md5(F.array_join(F.regexp_extract_all(F.array_join("x.text", " "), F.lit(r"\S+"), F.lit(0)), " ")).alias("words"), "fit")


@query(f"""WITH {_BASE} SELECT 'F' || k AS filing_id, 'us-gaap:Revenues' AS concept, 'f-' || k AS fact_id, v1::DOUBLE AS value, 'net sales' AS row_label, '2' AS item, '2025-03-31' AS day FROM v
UNION ALL SELECT 'F' || k, 'us-gaap:Cash', 'g-' || k, p3, 'cash', '2', '2024-12-31' FROM v""")
def lateral_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged facts of filings with their row, Item and last day."""
    context = lambda name, inner: F.lit(f'<xbrli:context id="{name}"><xbrli:period>{inner}</xbrli:period></xbrli:context>')
    fact = lambda name, prefix, ref, label, value: F.concat(F.lit(f'<tr><td>{label}</td><td><ix:nonFraction name="us-gaap:{name}" contextRef="{ref}" id="'), _id(prefix), F.lit('">'), value, F.lit("</ix:nonFraction></td></tr>"))
    page = F.concat(F.lit('<html><body><div style="display:none">'), context("q", "<xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-03-31</xbrli:endDate>"), context("i", "<xbrli:instant>2024-12-31</xbrli:instant>"), F.lit("</div><p>Item 2. Discussion</p><table>"), fact("Revenues", "f-", "q", "Net sales", _money("v1")), fact("Cash", "g-", "i", "Cash", _money("p3")), F.lit("</table></body></html>"))
    rows = _figures(spark, sf).select(_id("F").alias("filing_id"), page.alias("content"))
    return _sql(spark, "SELECT filing_id, p.concept, p.fact_id, p.value, p.row_label, p.item, p.day FROM {t}, LATERAL tagged_facts(content) p", rows)


@query("""WITH e AS (SELECT user_id AS doc, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM events),
g AS (SELECT *, count(*) FILTER (event_type = 'view') OVER (PARTITION BY doc ORDER BY pos) AS run FROM e)
SELECT doc, pos, CAST(run AS INTEGER) AS run, CAST(pos - min(pos) OVER (PARTITION BY doc, run) + CASE WHEN run = 0 THEN 1 ELSE 0 END AS INTEGER) AS place FROM g""")
def ordered_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in order, numbered by runs that a view opens: state kept along a partition."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = events.selectExpr("user_id AS doc", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos", "event_type = 'view' AS starts")
    return _sql(spark, "SELECT * FROM run_numbers(TABLE({t}) PARTITION BY doc ORDER BY pos)", rows)
