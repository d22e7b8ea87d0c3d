"""A stored vector index: coarse centroids, lists in folders, probes, exact scores of what is probed, filters.

Centroids are fitted to a bounded sample; every vector is then written to the list of its nearest one. A list has its
radius, the widest angle between its centroid and its vectors, so no vector of a list can be nearer to a question than
the angle to the centroid less that radius. An exact search probes the nearest lists first and then only those that
this bound doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import QUERY_ROWS, top_k

#: Vectors that centroids are fitted to, at most; lists at most; vectors of a list that one task scores at most.
TRAIN_VECTORS, MOST_LISTS, LIST_ROWS = 20_000, 1024, 50_000
ROUNDS = 12


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on the sphere, from far-apart rows of the sample; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(sample)))]
    near = sample @ sample[at[0]]
    for _ in range(1, min(lists, len(sample))):
        far = np.clip(1 - near, 0, None)
        at.append(int(rng.choice(len(sample), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(sample))))
        near = np.maximum(near, sample @ sample[at[-1]])
    c = sample[at]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit_rows(sums), c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class VectorIndex:
    """An index under `path`: `vectors` by list, and `lists` with centroid, radius and size."""

    spark: SparkSession
    path: str
    doc_type: str = "bigint"

    def build(self, vectors: DataFrame, doc: str, vector: str, lists: int | None = None) -> None:
        """Writes an index of all rows of vectors; their other columns are kept for filters.

        A null vector, or one of zeros, has no direction and is left out. lists: the square root of the number of
        vectors, if not given.
        """
        rows = vectors.where(F.exists(vector, lambda x: x != 0))
        n = rows.count()
        lists = min(MOST_LISTS, lists or max(1, int(n**0.5)))
        share = min(1.0, TRAIN_VECTORS / max(1, n))
        some = rows.where(F.pmod(F.xxhash64(doc), F.lit(1 << 30)) < int(share * (1 << 30))).select(vector).limit(TRAIN_VECTORS)
        c = centroids(unit_rows(_matrix(some.toArrow().column(0).combine_chunks())), lists) if n else np.zeros((1, 1))
        kept = [x for x in rows.columns if x != vector]
        schema = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in kept)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = unit_rows(_matrix(b.column(len(kept))))
                    near = x @ c.T
                    own = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())), pa.array(own, pa.int32()), pa.array(angle)], names=[*kept, "_v", "list", "angle"])

        at = f"{self.path}/assigned"
        rows.select(*kept, vector).mapInArrow(assign, f"{schema}, _v array<double>, list int, angle double").write.mode("overwrite").parquet(at)
        own = self.spark.read.parquet(at)
        sizes = own.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size")).collect()  # a row for each list
        table = [(r["list"], [float(v) for v in c[r["list"]]], r["radius"], r["size"]) for r in sizes]
        self.spark.createDataFrame(table, "list int, centroid array<double>, radius double, size bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists")
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["list"], -(-r["size"] // LIST_ROWS))]), F.col("list")), F.lit(1)) if sizes else F.lit(1)
        own = own.drop("angle").withColumn("part", F.pmod(F.xxhash64(doc), parts).cast("int"))  # a large list is several tasks
        own.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, query: str, doc: str, vector: str = "q", probes: int = 8, exact: bool = False, where: Column | None = None, block: int = QUERY_ROWS) -> DataFrame:
        """(query, doc, score, rank): the k nearest vectors by cosine of each query among the lists that are probed.

        exact: all lists that may hold a nearer one are probed too. where: a condition on the kept columns, which the
        scan takes in. Queries are counted and go out in blocks of at most `block`; one without direction has no rows.
        """
        table = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").toArrow()
        stated = queries.select(query, vector).where(F.exists(vector, lambda x: x != 0))
        blocks = max(1, -(-queries.count() // block))
        out = []
        for b in range(blocks):
            some = (stated.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) if blocks > 1 else stated).toArrow()
            out += self._probed(some.combine_chunks(), table, k, query, doc, probes, exact, where)
        schema = f"{query} {queries.schema[query].dataType.simpleString()}, {doc} {self.doc_type}, score double"
        return top_k(reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], schema), k, query, doc)

    def probes_for(self, queries: DataFrame, exact: DataFrame, k: int, query: str, doc: str, target: float = 0.9, least: int = 16) -> int:
        """Probes that reach the recall against exact(query, doc): doubled from the least until they do, all lists at most."""
        lists, probes = self.spark.read.parquet(f"{self.path}/lists").count(), least
        while probes < lists:
            reached = recall(self.search(queries, k, query, doc, probes=probes), exact, query, doc).first()["recall"]
            if reached is None or reached >= target:
                break
            probes *= 2
        return min(probes, max(1, lists))

    def _probed(self, some: pa.Table, table: pa.Table, k: int, query: str, doc: str, probes: int, exact: bool, where: Column | None) -> list[DataFrame]:
        """Scores of one block of queries: those of the first probes, and those of further lists if the search is exact."""
        if not some.num_rows or not table.num_rows:
            return []
        names, q = some.column(0).combine_chunks(), unit_rows(_matrix(some.column(1).combine_chunks()))
        lists, near = table.column("list").to_numpy(), q @ _matrix(table.column("centroid").combine_chunks()).T
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
        rows = self._scores(names, q, first, lists, k, query, doc, where)
        if not exact:
            return [rows]
        found = top_k(rows, k, query, doc).select(query, doc, "score").toArrow()  # k rows at most for each stated query
        least = {x.as_py(): -1.0 for x in names}
        best: dict = {}
        for name, score in zip(found.column(0).to_pylist(), found.column(2).to_pylist(), strict=True):
            best.setdefault(name, []).append(score)
        least |= {name: min(s) for name, s in best.items() if len(s) == k}
        bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - table.column("radius").to_numpy() - 1e-9))
        rest = ~first & (bound + 1e-8 >= np.array([least[x.as_py()] for x in names])[:, None])
        known = self.spark.createDataFrame(found) if found.num_rows else rows.limit(0)
        return [known, self._scores(names, q, rest, lists, k, query, doc, where)] if rest.any() else [known]

    def _scores(self, names: pa.Array, q: np.ndarray, pairs: np.ndarray, lists: np.ndarray, k: int, query: str, doc: str, where: Column | None) -> DataFrame:
        """The k best of each part of a list for each query that probes it; pairs: by query and list."""
        asked = {int(x): np.flatnonzero(pairs[:, j]) for j, x in enumerate(lists) if pairs[:, j].any()}
        rows = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(list(asked)))
        rows = rows if where is None else rows.where(where)
        kind = lambda t: "bigint" if pa.types.is_int64(t) else "int" if pa.types.is_int32(t) else "string"
        return rows.select("list", "part", doc, "_v").groupBy("list", "part").applyInArrow(_best_of(asked, names, q, k, query, doc), f"{query} {kind(names.type)}, {doc} {self.doc_type}, score double")


def _best_of(asked: dict[int, np.ndarray], names: pa.Array, q: np.ndarray, k: int, query: str, doc: str) -> Callable[[pa.Table], pa.Table]:
    """Scores one part of a list against the queries that probe it by a matrix product."""

    def run(part: pa.Table) -> pa.Table:
        own = asked[part.column("list")[0].as_py()]
        docs = part.column(doc).combine_chunks()
        x = _matrix(part.column("_v").combine_chunks())[pc.sort_indices(docs).to_numpy()]
        docs = docs.take(pc.sort_indices(docs))
        who, what, scores = [], [], []
        for i in own:
            s = np.round(x @ q[i], 12)
            rounded = np.round(s, 9)
            some = np.arange(len(s)) if len(s) <= k else np.flatnonzero(rounded >= np.partition(rounded, len(s) - k)[len(s) - k])
            some = some[np.lexsort((some, -rounded[some]))][:k]
            who.append(np.full(len(some), i)), what.append(some), scores.append(s[some])
        return pa.table({query: names.take(pa.array(np.concatenate(who))), doc: docs.take(pa.array(np.concatenate(what))), "score": pa.array(np.concatenate(scores))})

    return run


def recall(found: DataFrame, exact: DataFrame, query: str, doc: str) -> DataFrame:
    """One row (queries, recall): the mean share of each query's exact documents that were found."""
    hit = exact.select(query, doc).join(found.select(query, doc).withColumn("_hit", F.lit(1)), [query, doc], "left")
    return hit.groupBy(query).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("r")).agg(F.count(F.lit(1)).alias("queries"), F.avg("r").alias("recall"))
