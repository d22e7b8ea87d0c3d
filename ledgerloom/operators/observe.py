"""Traces and service figures: spans as rows, time by stage, last-N windows."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.relational import nearest_rank
from ledgerloom.schemas import SPANS

# The stage that a span's name belongs to, and the name of a whole answer.
STAGES = {"query.decompose": "decompose", "retrieve.candidate_pool": "pool", "rerank.cross_encoder": "rerank", "answer.calc_and_verify": "calc_verify"}
NAMES = ("decompose", "pool", "rerank", "llm", "calc_verify")
ROOT = "rag.answer"
#: Spans deeper than this are an error.
DEPTH = 64


class Tracer:
    """Collects spans; without one, span() does nothing."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.open: list[tuple[str, str]] = []

    @contextlib.contextmanager
    def span(self, name: str, kind: str = "CHAIN", value: object = None) -> Iterator[dict]:
        trace = self.open[-1][0] if self.open else uuid.uuid4().hex
        own, parent, notes = uuid.uuid4().hex[:16], self.open[-1][1] if self.open else None, {}
        start, began = datetime.now(timezone.utc), time.perf_counter()
        self.open.append((trace, own))
        try:
            yield notes
        finally:
            self.open.pop()
            text = value if isinstance(value, str) or value is None else json.dumps(value, default=str)
            self.rows.append((trace, own, parent, name, kind, start, datetime.now(timezone.utc), text, 1000 * (time.perf_counter() - began)))

    def flush(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame(self.rows, SPANS)
        self.rows = []
        return out


@contextlib.contextmanager
def span(name: str, kind: str = "CHAIN", value: object = None, tracer: Tracer | None = None) -> Iterator[dict]:
    if tracer is None:
        yield {}
    else:
        with tracer.span(name, kind, value) as notes:
            yield notes


def stage_of(name: Column, kind: Column) -> Column:
    out = F.when(kind == "LLM", F.lit("llm"))
    for n, s in reversed(STAGES.items()):
        out = F.when(name == n, F.lit(s)).otherwise(out)
    return out


def breakdown(spans: DataFrame, last: int) -> DataFrame:
    """(trace, question, total_ms, ms by stage, other) of the newest answers. Only outermost stage spans count.

    A staged span is followed up to its root one level a round, and dropped at a staged ancestor; a round takes the
    parents of what is left, so the rounds are the depth of the deepest trace. Spans deeper than DEPTH, or above
    themselves, are an error.
    """
    roots = spans.where(F.col("name") == ROOT).orderBy(F.desc("start"), "trace").limit(last)
    spans = spans.join(roots.select("trace"), "trace", "left_semi").withColumn("stage", stage_of(F.col("name"), F.col("kind")))
    parents = spans.select("trace", F.col("span").alias("at"), F.col("parent").alias("_up"), F.col("stage").isNotNull().alias("_staged"))
    left = spans.where("stage is not null").select("trace", "span", "stage", "ms", F.col("parent").alias("at"))
    outer = None
    for _ in range(DEPTH):
        step = left.join(parents, ["trace", "at"], "left")
        top = step.where("_staged is null").select("trace", "stage", "ms")
        outer = top if outer is None else outer.unionByName(top)
        left = step.where("not _staged").select("trace", "span", "stage", "ms", F.col("_up").alias("at"))
        if left.isEmpty():
            break
    else:
        raise ValueError(f"spans deeper than {DEPTH}")
    totals = outer.groupBy("trace").pivot("stage", list(NAMES)).agg(F.sum("ms")).na.fill(0.0)
    rows = roots.select("trace", F.substring(F.coalesce("input", F.lit("")), 1, 60).alias("question"), F.col("ms").alias("total_ms")).join(totals, "trace", "left").na.fill(0.0)
    other = F.greatest(F.col("total_ms") - sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0])), F.lit(0.0))
    return rows.withColumn("other", other)


def service_metrics(requests: DataFrame, last: int = 200) -> DataFrame:
    """One row over the last requests(at, total_ms, refused, unverified): count, nearest-rank latency, rates."""
    rows = requests.orderBy(F.desc("at")).limit(last)
    times = F.array_sort(F.collect_list("total_ms"))
    return rows.agg(F.count(F.lit(1)).alias("requests"), nearest_rank(times, 0.5).alias("p50_ms"), nearest_rank(times, 0.95).alias("p95_ms"), F.avg(F.col("refused").cast("int")).alias("refusal_rate"), F.avg((F.col("unverified") > 0).cast("int")).alias("unverified_rate"))


def scaling_stages(order: list[str], stages: list[dict], run) -> list[dict]:
    """run(name, tickers) for each stage over growing prefixes of an ordered universe; its figures with the stage's."""
    return [{"stage": s["name"], "companies": s["companies"], "filings": s["filings"], **run(s["name"], order[: s["companies"]])} for s in stages]
