"""Registered queries: streams over the events table, each run to its end and held against the batch's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.registry import Registry, table
from ledgerloom.plans.registry import shared as _shared
from ledgerloom.streaming import incremental as S

registry = Registry()
query = registry.query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_stream(spark, sf, "events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 10")
def stream_incremental_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """The same source taken twice from one checkpoint: the second run finds nothing new."""
    at = _shared(spark)
    rows = _events(spark, sf).where("value > 10").select("event_id", "user_id", "event_type")
    for _ in range(2):
        S.to_table(rows, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows in complete mode: each batch's result replaces the table."""
    at = _shared(spark)
    out = S.windowed(_events(spark, sf), late="0 seconds")

    def put(batch: DataFrame, _: int) -> None:
        batch.withColumn("start", F.col("start").cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{at}/out")

    out.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("""WITH s AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return S.sessions(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts"))


@query("""WITH s AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session_live(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a stream in complete mode, their state kept by Spark: each batch's result replaces the table."""
    at = _shared(spark)

    def put(batch: DataFrame, _: int) -> None:
        batch.withColumn("start", F.col("start").cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{at}/out")

    out = S.sessions(_events(spark, sf).select("user_id", "ts"))
    out.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT event_type, least(count(*), 200) AS n FROM events GROUP BY 1")
def stream_last_n(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the last-200 windows by type, from keyed state."""
    at = _shared(spark)
    rows = S.last_n(_events(spark, sf).select("event_type", "value"), "event_type", "value")

    def put(batch: DataFrame, _: int) -> None:
        batch.select("event_type", F.col("n")).write.mode("overwrite").parquet(f"{at}/out")

    rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all pages."""
    from ledgerloom.operators import parsing

    rows = parsing.html_blocks(table(spark, sf, "pages"), "page_id", "html")
    return rows.select("page_id", "idx", "kind", F.length("text").alias("n_chars"), "bold")


@query()
def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of all pages' elements, without running headers."""
    from ledgerloom.operators import parsing

    rows = parsing.document_elements(table(spark, sf, "pages").withColumn("form_type", F.lit("10-Q")), "page_id", "html")
    return parsing.stats(rows, "page_id").select("page_id", "n_heading", "n_paragraph", "n_table", "n_footnote", "chars", "pct_chars_unsectioned")


@query()
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Parents and children of all pages with their ids."""
    from ledgerloom.operators import chunking

    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("filing_id"), "html")
    facts = {"form_type": F.lit("10-Q"), "accession_number": F.concat(F.lit("acc-"), F.col("filing_id")), "fiscal_year": F.lit("2025"), "fiscal_period": F.lit("Q1"), "period_of_report": F.lit("2025-03-31")}
    nodes = chunking.document_chunks(pages.withColumns(facts), content="html")
    return nodes.select("filing_id", "node_id", "parent_id", "node_type", "section", "n_tokens")
