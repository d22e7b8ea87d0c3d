"""Answers judged: summaries of runs, sweeps over variants, model judges behind a call guard."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.parsing import frame

# How a rate limit reads.
PER_DAY = re.compile(r"per[ -]day|\bTPD\b|\bRPD\b", re.I)
RETRY_IN = re.compile(r"try again in (?:(\d+)m)?([\d.]+)s", re.I)


class BudgetExhausted(RuntimeError):
    """No more calls in this run."""


class CallGuard:
    """Wraps a model call: at most `per_minute` a minute and `most` at all; waits out a limit by the minute, stops at one by the day."""

    def __init__(self, call: Callable, per_minute: float, most: int, waits: int, sleep: Callable[[float], None] = time.sleep) -> None:
        self.call, self.gap, self.most, self.allowed, self.sleep = call, 60.0 / per_minute, most, waits, sleep
        self.calls = self.waited = 0
        self.last = float("-inf")
        self.stopped: str | None = None

    def _stop(self, why: str) -> BudgetExhausted:
        self.stopped = why
        return BudgetExhausted(why)

    def __call__(self, *args, **kwargs):
        for _ in range(self.allowed + 1):
            if self.stopped:
                raise BudgetExhausted(self.stopped)
            if self.calls >= self.most:
                raise self._stop(f"call cap reached ({self.most})")
            self.sleep(max(0.0, self.last + self.gap - time.monotonic()))
            self.last = time.monotonic()
            self.calls += 1
            try:
                return self.call(*args, **kwargs)
            except Exception as e:
                text = str(e)
                if "429" not in text and "rate limit" not in text.lower():
                    raise
                if PER_DAY.search(text):
                    raise self._stop(f"daily limit reached: {text[:200]}") from e
                hint = RETRY_IN.search(text)
                self.waited += 1
                self.sleep(min(60 * int(hint.group(1) or 0) + float(hint.group(2)) + 1 if hint else 20.0, 120.0))
        raise self._stop(f"still limited after {self.allowed} waits")


def word_overlap_judge(question: str, answer: str, contexts: list[str]) -> dict[str, float]:
    """Deterministic stand-in for a model judge: shares of words that contexts support, and that the question asks for."""
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    said, known, asked = words(answer), words(" ".join(contexts)), words(question)
    return {"faithfulness": len(said & known) / len(said) if said else 0.0, "answer_relevancy": len(said & asked) / len(asked) if asked else 0.0}


def judge(answers: DataFrame, judge: Callable[[str, str, list[str]], dict[str, float]] = word_overlap_judge) -> DataFrame:
    """(qid, refused, faithfulness, answer_relevancy, error) of answers(qid, question, answer, contexts); refusals aren't judged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                row = {"qid": r["qid"], "refused": bool(r["refused"])}
                if not row["refused"]:
                    try:
                        row |= judge(r["question"], r["answer"], list(r["contexts"]))
                    except BudgetExhausted:
                        raise
                    except Exception as e:  # an error is that answer's result
                        row["error"] = str(e)
                out.append(row)
            yield frame(out, ["qid", "refused", "faithfulness", "answer_relevancy", "error"])

    rows = answers.withColumn("refused", T.is_refusal(F.col("answer"))).select("qid", "question", "answer", "contexts", "refused")
    return rows.mapInPandas(run, "qid string, refused boolean, faithfulness double, answer_relevancy double, error string")


def run_summary(results: DataFrame) -> DataFrame:
    """By type and overall (type null): what results(type, correct, all_facts_in_context, values_ok, calc_ok, refused, cited, unverified, latency_ms) say; narrative questions have no key and don't count."""
    rate = lambda c: F.avg(c.cast("double"))
    known = F.col("all_facts_in_context")
    agg = [
        F.count(F.lit(1)).alias("n"),
        rate(F.col("correct")).alias("correct"),
        rate(known).alias("facts_in_context"),
        rate(F.when(known, F.col("correct"))).alias("correct_given_context"),
        rate(F.col("values_ok")).alias("values_ok"),
        rate(F.col("calc_ok")).alias("calc_ok"),
        rate(F.col("refused")).alias("refused"),
        F.count_if(F.col("refused") & known).alias("refused_with_facts"),
        rate(F.col("unverified") > 0).alias("unverified"),
        rate(F.col("cited")).alias("cited"),
        F.percentile("latency_ms", F.lit(0.5)).alias("p50_ms"),
        F.percentile("latency_ms", F.lit(0.95)).alias("p95_ms"),
    ]
    rows = results.where("type <> 'narrative'")
    return rows.groupBy("type").agg(*agg).unionByName(rows.agg(*agg).select(F.lit(None).cast("string").alias("type"), "*"))


def sweep(per_query: DataFrame, metric: str = "mrr_10", others: tuple[str, ...] = ()) -> DataFrame:
    """Variants of per_query(variant, split, metric, *others, latency_ms): means by split (3 places), and which variant is best on dev, of several the first by name."""
    mean = lambda c: F.round(F.round(F.avg(c), 9), 3).alias(c)
    means = per_query.groupBy("variant", "split").agg(F.round(F.avg(metric), 3).alias(metric), *map(mean, others), F.median("latency_ms").alias("p50_ms"), F.count(F.lit(1)).alias("n"))
    best = means.where("split = 'dev'").agg(F.min_by("variant", F.struct(-F.col(metric), F.col("variant"))).alias("_best"))
    return means.join(F.broadcast(best), F.lit(True), "left").withColumn("chosen", F.col("variant") == F.col("_best")).drop("_best")


def outcome_table(audited: DataFrame) -> DataFrame:
    """Outcomes by run with margins (null), as a crosstab in long form."""
    return audited.cube("run", "outcome").agg(F.count(F.lit(1)).alias("n"))
