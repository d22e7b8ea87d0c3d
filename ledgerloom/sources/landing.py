"""Documents on their way in and out: landed files, node tables, state tables, a polite HTTP client."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions import text as T
from ledgerloom.operators import relational as R

# Answers worth another try, and how a throttled one reads.
RETRY = (403, 429, 500, 502, 503, 504)
THROTTLED = ("Request Rate Threshold Exceeded", "Undeclared Automated Tool")


class ClientError(Exception):
    """A request that failed for good."""


def check_agent(agent: str) -> str:
    """A User-Agent must name a real contact."""
    if "@" not in agent or "example.com" in agent:
        raise ValueError("the User-Agent must name a contact address")
    return agent


class Client:
    """GETs at most `rate` times a second, with retries; anything else fails at once. `opener` is for tests."""

    def __init__(self, agent: str, rate: float = 8.0, attempts: int = 5, base: float = 2.0, opener=None, sleep=time.sleep) -> None:
        self.agent, self.gap, self.attempts, self.base = check_agent(agent), 1 / rate, attempts, base
        self.open, self.sleep, self.last = opener or self._urlopen, sleep, 0.0

    def _urlopen(self, url: str) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=60) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def get(self, url: str) -> bytes:
        for attempt in range(self.attempts):
            self.sleep(max(0.0, self.last + self.gap - time.monotonic()))
            self.last = time.monotonic()
            status, body = self.open(url)
            head = body[:2000].decode("utf-8", "replace")
            slow = any(t in head for t in THROTTLED)
            if status == 200 and not slow:
                return body
            if status not in RETRY and not slow:
                raise ClientError(f"{status} for {url}")
            self.sleep(self.base**attempt)
        raise ClientError(f"gave up on {url} after {self.attempts} attempts")

    def get_json(self, url: str):
        return json.loads(self.get(url))


class HttpSource(DataSource):
    """spark.read.format("polite_http").option("urls", json list).option("agent", ...).option("rate", total per second)

    One row (url, status, content, error) per URL; the rate is shared out over the partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "polite_http"

    def schema(self) -> str:
        return "url string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "1"))
        urls = json.loads(self.options["urls"])
        return [InputPartition(urls[i::n]) for i in range(n)]

    def read(self, partition: InputPartition):
        client = Client(self.options["agent"], float(self.options.get("rate", "8")) / int(self.options.get("partitions", "1")))
        for url in partition.value:
            try:
                yield url, client.get(url), None
            except (ClientError, OSError) as e:
                yield url, None, str(e)


def landed(spark: SparkSession, path: str, glob: str = "*.htm") -> DataFrame:
    """(path, filing_id, bytes, sha256, content) of landed files, at any depth."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select("path", name.alias("filing_id"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def validated(files: DataFrame, manifest: DataFrame, min_bytes: int = 20_000) -> DataFrame:
    """Landed files with the reason to refuse them, null if there is none."""
    return files.join(manifest.select("filing_id", "form_type"), "filing_id").withColumn("reason", T.validate_document(F.col("content"), F.col("form_type"), min_bytes))


# ------------------------------------------------------------------ node tables


class NodeStore:
    """A Parquet table partitioned by filing: replacing a filing is one atomic overwrite of its partition."""

    def __init__(self, spark: SparkSession, path: str, readonly: bool = False) -> None:
        self.spark, self.path, self.readonly = spark, path, readonly

    def replace(self, nodes: DataFrame, filings: DataFrame | None = None) -> None:
        """Writes nodes(filing_id, node_id, ...): each of their filings, and of filings(filing_id), has these nodes and no others from now on.

        A filing of `filings` without nodes loses its partition after the others are written; a run that dies between
        is done by running it again.
        """
        if self.readonly:
            raise PermissionError("the store is read-only")
        nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filing_id").parquet(self.path)
        if filings is not None:
            empty = filings.select(F.col("filing_id").cast("string")).distinct().join(nodes.select(F.col("filing_id").cast("string")).distinct(), "filing_id", "left_anti")
            for r in empty.toLocalIterator():  # folder names, one after the other
                folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["filing_id"])
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filing_id={folder}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, ids: DataFrame) -> DataFrame:
        """Nodes with the ids of ids(node_id); those the store lacks are left out."""
        return self.read().join(ids.select("node_id").distinct(), "node_id", "left_semi")

    def count(self) -> int:
        return self.read().count()

    def stale(self, ids: DataFrame) -> DataFrame:
        """Ids of ids(filing_id, node_id) and of the store that the other lacks."""
        mine = self.read().select(F.col("filing_id").cast("string"), "node_id", F.lit(1).alias("_a"))
        both = mine.join(ids.select("filing_id", "node_id", F.lit(1).alias("_b")), ["filing_id", "node_id"], "full_outer")
        return both.where("_a is null or _b is null").select("filing_id", "node_id", F.col("_a").isNull().alias("missing"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """A headed CSV by an explicit schema, so that leading zeros stay; fields may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", multiline).option("quote", '"').option("escape", '"').csv(path)


# ------------------------------------------------------------------ state of a resumable job


def mark(state: DataFrame, marks: DataFrame) -> DataFrame:
    """state(id, status, attempts, ...) after marks(id, status, ...): attempts go up by one for each mark."""
    old = state.select("id", F.col("attempts").alias("_old"))
    new = marks.join(old, "id", "left").withColumn("attempts", F.coalesce("_old", F.lit(0)) + 1).drop("_old")
    return R.upsert(state, new, ["id"])


def state_summary(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def config(path: str | Path, overrides: dict[str, tuple[str, ...]] | None = None) -> dict:
    """A JSON or, where PyYAML is there, YAML file; overrides names keys that an environment variable replaces."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        out = json.loads(text)
    else:
        import yaml

        out = yaml.safe_load(text)
    for variable, keys in (overrides or {}).items():
        if value := os.environ.get(variable):
            at = out
            for k in keys[:-1]:
                at = at.setdefault(k, {})
            at[keys[-1]] = value
    return out
