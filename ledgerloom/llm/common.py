"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key table with at most this many rows (16 bytes each) may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows in one Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only if the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that on pure ASCII, and faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words of a text, null: 0. A word starts at each non-space that follows a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """At most `rows` rows in each Arrow batch of this session from here on; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't in dropped: a broadcast join if the counted keys are few, else by shuffle."""
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def without_rows(df: DataFrame, dropped: DataFrame, key: str = "_rid") -> DataFrame:
    """df without the rows whose with_row_id() is in dropped; its columns stay, whatever their names."""
    whole = with_row_id(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")), key)
    return without(whole, dropped, key).select("_row.*")


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """df with a unique integer for each row; the same for each read of the same files."""
    return df.withColumn(name, F.monotonically_increasing_id())


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again; discard() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored() table, which nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def rereadable(df: DataFrame) -> DataFrame:
    """df if each run gives its rows the same ids, as a scan of files does; else a stored copy."""

    def narrow(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in ("LogicalRelation", "LogicalRDD", "LocalRelation", "Project", "Filter", "SubqueryAlias") and all(narrow(children.apply(i)) for i in range(children.size()))

    return df if narrow(df._jdf.queryExecution().analyzed()) else stored(df)
