"""Incremental work as Structured Streaming: idempotent ingest, last-N windows, section state, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions.sections import Place, Sections
from ledgerloom.sources.landing import NodeStore


def ingest(files: DataFrame, store: NodeStore, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Takes all new files once: build() makes nodes(filing_id, ...) of a batch, which replace their filings' nodes; a
    filing of the batch (its filing_id) that has none any more loses those it had.

    A batch that is run again after a failure writes the same partitions again, so each file counts once.
    """

    def put(batch: DataFrame, _: int) -> None:
        store.replace(build(batch), batch.select("filing_id") if "filing_id" in batch.columns else None)

    files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new to a Parquet table; the sink's log keeps a repeated batch from counting twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums by type, for a stream or a batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: ended by a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def last_n(stream: DataFrame, key: str, value: str, n: int = 200) -> DataFrame:
    """(key, n, mean) over the last n values of each key, by arrival: a count-based window, which time windows aren't."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            held = (held + b[value].tolist())[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "n": [len(held)], "mean": [sum(held) / len(held) if held else None]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, mean double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def section_labels(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, idx, section) of lines(doc, idx, form_type, text, bold) that come in order: the section fold as keyed state."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        form, *place, numbered = state.get if state.exists else (None, "0")
        s = Sections(form, Place(*[x or None for x in place]), numbered == "1") if state.exists else None
        for b in batches:
            out = []
            for r in b.sort_values("idx").to_dict("records"):
                s = s or Sections(r["form_type"])
                s.see(r["text"], bool(r["bold"]))
                out.append((k[0], r["idx"], s.labels()["section"]))
            yield pd.DataFrame(out, columns=[doc, "idx", "section"])
        if s is not None:
            state.update((s.form, *[x or "" for x in s.place], "1" if s.numbered else "0"))

    kind = lines.schema[doc].dataType.simpleString()
    return lines.groupBy(doc).applyInPandasWithState(update, f"{doc} {kind}, idx int, section string", "form string, part string, item string, title string, note string, heading string, named string", "append", GroupStateTimeout.NoTimeout)


def read_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A stream over Parquet files as they are or come; glob names those to take."""
    schema = spark.read.parquet(f"{path}/{glob}" if glob else path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
