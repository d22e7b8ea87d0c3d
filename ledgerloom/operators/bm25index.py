"""A stored inverted index for BM25: stemmed terms in buckets, postings in blocks, segments that replace each other's documents.

A task inverts the documents that it reads in shards of bounded size, so texts and single postings are never shuffled;
only blocks are, to the folders of their terms' hash buckets. A posting is six bytes: its document's place in the shard
and its count. A block has at most BLOCK postings, the largest count and the least length, by which a question passes
over blocks that hold none of its best documents. A shard is what one task scores.

Each upsert writes one segment: its shards, its blocks, and a row for each older document that it replaces. A segment
counts once its row in `segments` is there, which is written last, so an upsert that dies midway leaves nothing that a
reader sees, and runs of one upsert give one segment.
"""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions import text as T
from ledgerloom.functions.stem import MAX_TOKEN, STOP_WORDS, stem
from ledgerloom.operators.retrieval import BLOCK_ROWS, K1, B, idf, top_k

#: Documents of a shard at most (a place takes two bytes), and tokens after which a shard ends.
BUCKETS, SHARD_DOCS, SHARD_TOKENS, BLOCK = 64, 10_000, 4_000_000, 128
#: Rows that a worker tokenises at once.
BATCH_ROWS = 256
#: Blocks that are unpacked at once.
BLOCKS_AT_ONCE = 5_000
#: Tables of replaced documents and of asked terms are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 500_000
_ORD, _TF = np.dtype("<u2"), np.dtype("<u4")


def kept_tokens(text: Column) -> Column:
    """The tokens of a text that are indexed, before stemming: no stop words, none longer than MAX_TOKEN."""
    return F.filter(T.tokens(text), lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) <= MAX_TOKEN))


def _counts(column: pa.Array) -> Iterator[Counter]:
    return (Counter(map(stem, (t or "").split())) for t in column.to_pylist())


def terms_of(questions: DataFrame, query: str, text: str) -> DataFrame:
    """(q, term): the distinct stems of each question. Stems are remembered by each worker."""
    rows = questions.select(F.col(query).alias("q"), F.array_join(kept_tokens(F.col(text)), " ").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t) for i, c in enumerate(_counts(b.column(1))) for t in c]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([t for _, t in found], pa.string())], names=["q", "term"])

    return rows.mapInArrow(run, f"q {rows.schema['q'].dataType.simpleString()}, term string")


def weight(tf, length, avg_len: float, k1: float = K1, b: float = B):
    """A term's weight in a document, without its rarity; of columns or arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def _packed(values: np.ndarray, dtype: np.dtype, starts: np.ndarray) -> pa.Array:
    """Runs of values as binaries: one buffer for all."""
    offsets = np.r_[starts, len(values)].astype(np.int32) * dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.astype(dtype).tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    """All values of a column of binaries, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.int64)


class Held:
    """The postings of a shard's documents as flat numbers, eight bytes each: ids of terms and counts, and each document's terms and length."""

    def __init__(self) -> None:
        self.ids, self.tfs, self.sizes, self.lengths = array("i"), array("i"), [], []

    def add(self, counts: Counter, names: dict[str, int]) -> None:
        self.ids.extend([names.setdefault(t, len(names)) for t in counts])
        self.tfs.extend(counts.values())
        self.sizes.append(len(counts))
        self.lengths.append(counts.total())


_COLUMNS = "shard bigint, filings array<{filing}>, docs array<{doc}>, lengths array<int>, term string, ords binary, tfs binary, n int, most int, least int"


def _inverted(rows: DataFrame, filing_type: str, doc_type: str, shard_docs: int) -> DataFrame:
    """A row for each shard (filings, docs, lengths) and one for each of its blocks (term, ords, tfs, n, most, least)."""
    rows = rows.select("filing", "doc", F.array_join(kept_tokens(F.col("text")), " ").alias("_t"), F.spark_partition_id().cast("long").alias("_p"))
    schema = _COLUMNS.format(filing=filing_type, doc=doc_type)
    size = BLOCK
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def shard(number: int, filings: list, docs: list, names: dict[str, int], own: Held) -> Iterator[pa.RecordBatch]:
        lengths = np.array(own.lengths, np.int32)
        first = {"shard": [number], "filings": [filings], "docs": [docs], "lengths": [own.lengths]}
        yield pa.RecordBatch.from_arrays([pa.array(first.get(f.name, [None]), f.type) for f in fields], schema=fields)
        if not len(own.ids):
            return
        ids = np.frombuffer(own.ids, np.int32)
        order = np.argsort(ids, kind="stable").astype(np.int32)
        ids, ords, tfs = ids[order], np.repeat(np.arange(len(docs), dtype=_ORD), own.sizes)[order], np.frombuffer(own.tfs, np.int32)[order]
        del order
        runs = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        starts = np.concatenate([np.arange(x, y, size) for x, y in itertools.pairwise(np.r_[runs, len(ids)].tolist())])
        n = len(starts)
        blocks = {
            "shard": pa.array(np.full(n, number)), "term": pa.array(list(names)).take(pa.array(ids[starts])), "ords": _packed(ords, _ORD, starts), "tfs": _packed(tfs, _TF, starts),
            "n": pa.array(np.diff(np.r_[starts, len(ids)]), pa.int32()), "most": pa.array(np.maximum.reduceat(tfs, starts), pa.int32()), "least": pa.array(np.minimum.reduceat(lengths[ords], starts), pa.int32()),
        }
        yield pa.RecordBatch.from_arrays([blocks.get(f.name, pa.nulls(n, f.type)) for f in fields], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filings, docs, names, own = None, [], [], {}, Held()
        for b in (x.slice(i, BATCH_ROWS) for x in batches for i in range(0, x.num_rows, BATCH_ROWS)):
            number = b.column(3)[0].as_py() << 32 if number is None else number
            for f, d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _counts(b.column(2)), strict=True):
                filings.append(f), docs.append(d), own.add(c, names)
                if len(docs) == shard_docs or len(own.ids) >= SHARD_TOKENS:
                    yield from shard(number, filings, docs, names, own)
                    number, filings, docs, names, own = number + 1, [], [], {}, Held()
        if docs:
            yield from shard(number, filings, docs, names, own)

    return rows.mapInArrow(run, schema)


@dataclass
class Bm25Index:
    """An index under `path`. avg_len: a fixed mean length, else that of the documents at the time of asking.

    doc_type, filing_type: the types of the ids.
    """

    spark: SparkSession
    path: str
    avg_len: float | None = None
    doc_type: str = "bigint"
    filing_type: str = "string"
    buckets: int = BUCKETS
    shard_docs: int = SHARD_DOCS

    # ---------------------------------------------------------------- reading

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[Row]:
        """(segment, docs, length, ends) of all upserts that were finished, a row each; none without an index."""
        root, fs = self._at("segments")
        return self.spark.read.schema("segment string, docs bigint, length bigint, ends array<string>").parquet(f"{self.path}/segments").collect() if fs.exists(root) else []

    def segments(self) -> list[Row]:
        """The committed segments that no compaction has ended."""
        rows = self._committed()
        ended = {x for r in rows for x in r["ends"]}
        return [r for r in rows if r["segment"] not in ended]

    def _read(self, name: str) -> DataFrame:
        schemas = {
            "shards": f"shard bigint, filings array<{self.filing_type}>, docs array<{self.doc_type}>, lengths array<int>, segment string",
            "replaced": f"segment string, shard bigint, ord int, doc {self.doc_type}, length int, by string",
            "postings": "shard bigint, term string, ords binary, tfs binary, n int, most int, least int, segment string, bucket int",
        }
        return self.spark.read.schema(schemas[name]).parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        """The rows of a table that live segments wrote."""
        return self._read(name).where(F.col("segment").isin([r["segment"] for r in self.segments()]))

    def replaced(self) -> DataFrame:
        """(segment, shard, ord, doc, length) of documents of live segments that a later segment replaced."""
        return self._table("replaced").where(F.col("by").isin([r["segment"] for r in self._committed()])).drop("by")

    def documents(self) -> DataFrame:
        """(filing, doc, length, segment, shard, ord) of the live documents."""
        rows = self._table("shards").select("segment", "shard", F.posexplode(F.arrays_zip("filings", "docs", "lengths")).alias("ord", "x"))
        rows = rows.select(F.col("x.filings").alias("filing"), F.col("x.docs").alias("doc"), F.col("x.lengths").alias("length"), "segment", "shard", "ord").where("length IS NOT NULL")
        return rows.join(_bounded(self.replaced().select("segment", "shard", "ord")), ["segment", "shard", "ord"], "left_anti")

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """Blocks (segment, bucket, shard, term, ords, tfs, n, most, least), of all terms or of those of terms(term)."""
        rows = self._table("postings")
        if terms is None:
            return rows
        asked = terms.select("term", _bucket(F.col("term"), self.buckets).alias("bucket")).distinct()
        wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most `buckets`: folders that are read
        return rows.where(F.col("bucket").isin(wanted)).join(_bounded(asked.select("term")), "term", "left_semi")

    def _shards(self, dead: DataFrame) -> DataFrame:
        """(segment, shard, docs, lengths, dead): a row for each shard, with the places in dead(segment, shard, ord)."""
        gone = dead.groupBy("segment", "shard").agg(F.collect_set("ord").alias("dead"))
        return self._table("shards").select("segment", "shard", "docs", "lengths").join(gone, ["segment", "shard"], "left")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, doc, tf) of live documents."""

        def run(hits: pa.Table, shard: pa.Table) -> pa.Table:
            _, live, docs, _ = _shard(shard)

            def part(some: pa.Table) -> pa.Table:
                at, tfs = unpacked(some.column("ords"), _ORD), unpacked(some.column("tfs"), _TF)
                term = np.repeat(np.arange(some.num_rows), some.column("n").to_numpy())
                on = live[at]
                return pa.table({"term": some.column("term").combine_chunks().take(pa.array(term[on])), "doc": docs.take(pa.array(at[on])), "tf": pa.array(tfs[on])})

            return pa.concat_tables([part(hits.slice(i, BLOCKS_AT_ONCE)) for i in range(0, max(1, hits.num_rows), BLOCKS_AT_ONCE)])

        rows = self.blocks(terms).select("segment", "shard", "term", "ords", "tfs", "n")
        return rows.groupBy("segment", "shard").cogroup(self._shards(self.replaced()).groupBy("segment", "shard")).applyInArrow(run, f"term string, doc {self.doc_type}, tf bigint")

    def stats(self) -> tuple[int, float]:
        """Live documents with a term, and their mean length."""
        own = self.segments()
        gone = self.replaced().where("length > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("l")).first()
        n, length = sum(r["docs"] for r in own) - gone["n"], sum(r["length"] for r in own) - (gone["l"] or 0)
        return n, length / n if n else 1.0

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) of the asked terms over the live documents: block sizes, less the postings of replaced documents."""
        found, dead = self.blocks(terms).select("segment", "shard", "term", "ords", "n"), self.replaced().select("segment", "shard", "ord")
        if not dead.isEmpty():  # a shard's blocks meet its dead places once, not each with a copy of them
            found = found.groupBy("segment", "shard").cogroup(dead.groupBy("segment", "shard")).applyInArrow(_live_sizes, "term string, n bigint")
        return found.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    # ---------------------------------------------------------------- writing

    def upsert(self, docs: DataFrame, filings: DataFrame | None = None, filing: str = "filing", doc: str = "doc", text: str = "text", name: str | None = None) -> str:
        """Replaces the documents of the filings that docs(filing, doc, text) or filings(filing) names; returns the segment.

        A filing of `filings` without rows in docs loses its documents. A document's id is its own in all filings. name:
        a name for the segment, with which a rerun of an upsert that was committed does nothing.
        """
        name = name or uuid.uuid4().hex
        if any(r["segment"] == name for r in self._committed()):
            return name
        rows = docs.select(F.col(filing).cast(self.filing_type).alias("filing"), F.col(doc).cast(self.doc_type).alias("doc"), F.col(text).alias("text"))
        built = _inverted(rows, self.filing_type, self.doc_type, self.shard_docs)
        # One job writes shards and blocks, so that both are of the same reading of the documents.
        built.withColumn("kind", F.when(F.col("term").isNull(), "shard").otherwise("block")).write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/built/{name}")
        built = self.spark.read.schema(f"{_COLUMNS.format(filing=self.filing_type, doc=self.doc_type)}, kind string").parquet(f"{self.path}/built/{name}")
        stored = built.where("kind = 'shard'").select("shard", "filings", "docs", "lengths")
        touched = stored.select(F.explode("filings").alias("filing")).distinct()
        if filings is not None:
            touched = touched.unionByName(filings.select(F.col(filing).cast(self.filing_type).alias("filing"))).distinct()
        live = self.documents() if self.segments() else self.spark.createDataFrame([], f"filing {self.filing_type}, segment string, shard bigint, ord int, doc {self.doc_type}, length int")
        gone = live.join(_bounded(touched), "filing", "left_semi").select("segment", "shard", "ord", "doc", "length")
        self._write(gone.withColumn("by", F.lit(name)), "replaced", "by")
        self._commit(stored, built.where("kind = 'block'").drop("kind", "filings", "docs", "lengths"), name, [])
        path, fs = self._at(f"built/{name}")
        fs.delete(path, True)
        return name

    def compact(self) -> str:
        """All live segments as one that ends them, without their replaced documents' postings."""
        name, ended, dead = uuid.uuid4().hex, [r["segment"] for r in self.segments()], self.replaced()
        gone = dead.groupBy("segment", "shard").agg(F.collect_set("ord").alias("dead"))
        key = F.xxhash64("segment", "shard").alias("shard")
        shards = self._table("shards").join(gone, ["segment", "shard"], "left")
        keep = lambda c: F.transform(c, lambda x, i: F.when(~F.coalesce(F.array_contains("dead", i), F.lit(False)), x)).alias(c)
        stored = shards.select(key, keep("filings"), keep("docs"), keep("lengths"))
        held = self._table("postings").join(_bounded(gone), ["segment", "shard"], "left").select(key, "term", "ords", "tfs", "n", "most", "least", "dead")
        schema = "shard bigint, term string, ords binary, tfs binary, n int, most int, least int"
        self._commit(stored, held.mapInArrow(_without_dead, schema), name, ended)
        return name

    def _commit(self, stored: DataFrame, blocks: DataFrame, name: str, ends: list[str]) -> None:
        """Writes a segment's shards and blocks, and last its row in `segments`."""
        self._write(stored.withColumn("segment", F.lit(name)), "shards", "segment")
        rows = blocks.withColumn("bucket", _bucket(F.col("term"), self.buckets)).withColumn("segment", F.lit(name))
        self._write(rows.repartition("bucket", "shard").sortWithinPartitions("bucket"), "postings", "segment", "bucket")
        lengths = self._read("shards").where(F.col("segment") == name).select(F.explode("lengths").alias("l")).where("l > 0")
        full = lengths.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("l"), F.lit(0)).alias("length"))
        row = full.select(F.lit(name).alias("segment"), "docs", "length", F.lit(ends).cast("array<string>").alias("ends"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _write(self, df: DataFrame, table: str, *by: str) -> None:
        """One segment's part of a table; what a run that died has left of it is overwritten, and nothing else."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{table}")

    # ---------------------------------------------------------------- asking

    def search(self, questions: DataFrame, k: int, query: str = "qid", text: str = "text", allowed: DataFrame | None = None, block: int = BLOCK_ROWS) -> DataFrame:
        """(query, doc, score, rank): the best k documents of each question, equal to those of the exhaustive score.

        Each distinct stem of a question counts once; a term's rarity is that of the whole index. allowed: (doc) that
        may be ranked, all if None. Questions are counted and go out in blocks of at most `block`; documents whose
        scores agree to nine places are ranked by id.
        """
        asked = terms_of(questions, query, text)
        n, mean = self.stats()
        mean = self.avg_len or mean
        blocks = max(1, -(-questions.count() // block))
        schema = f"q {questions.schema[query].dataType.simpleString()}, doc {self.doc_type}, score double"
        dead = self.replaced().select("segment", "shard", "ord")
        if allowed is not None:
            dead = dead.unionByName(self.documents().join(allowed.select("doc").distinct(), "doc", "left_anti").select("segment", "shard", "ord"))
        shards = self._shards(dead)
        kinds = [x.type for x in to_arrow_schema(StructType.fromDDL(schema))][:2]
        out = []
        for b in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked
            own = some.toPandas()  # the stated questions' terms
            terms = self.spark.createDataFrame(pd.DataFrame({"term": sorted(set(own["term"]))}, dtype=object), "term string")
            known = self.frequencies(terms).select("term", idf(F.lit(n), F.col("df")).alias("idf")).toPandas()
            own = own.merge(known, on="term")
            hits = self.blocks(terms).select("segment", "shard", "term", "ords", "tfs", "n", "most", "least")
            out.append(hits.groupBy("segment", "shard").cogroup(shards.groupBy("segment", "shard")).applyInArrow(_scorer(own, k, mean, *kinds), schema))
        return top_k(reduce(DataFrame.unionByName, out), k, "q", "doc").withColumnRenamed("q", query)


def _bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _on(ords: np.ndarray, dead: list | None) -> np.ndarray:
    return ~np.isin(ords, dead) if dead else np.ones(len(ords), bool)


def _live_sizes(blocks: pa.Table, dead: pa.Table) -> pa.Table:
    """(term, n) of what isn't dead in the blocks of a shard."""
    if not blocks.num_rows:
        return pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    live = np.ones(1 << 16, bool)
    live[dead.column("ord").to_numpy()] = False
    upto = np.concatenate([[0], np.cumsum(live[unpacked(blocks.column("ords"), _ORD)])])
    sizes = blocks.column("n").to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    return pa.table({"term": blocks.column("term").combine_chunks(), "n": pa.array(upto[ends] - upto[ends - sizes], pa.int64())})


def _without_dead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks without the postings of dead places; their bounds stay, which are no less right for it."""
    for b in batches:
        rows = []
        for s, t, o, f, most, least, d in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7)), strict=True):
            on = _on(np.frombuffer(o, _ORD), d)
            if on.any():
                rows.append((s, t, np.frombuffer(o, _ORD)[on].tobytes(), np.frombuffer(f, _TF)[on].tobytes(), int(on.sum()), most, least))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], b.schema.field(i).type) for i in range(7)], names=b.schema.names[:7])


def _shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(rank of each place by document id, whether it is live, ids, lengths) of a shard's one row."""
    docs = table.column("docs").combine_chunks().flatten()
    lengths = table.column("lengths").combine_chunks().flatten().fill_null(0).to_numpy().astype(float)
    live = np.ones(len(docs), bool)
    live[table.column("dead")[0].as_py() or []] = False
    rank = np.empty(len(docs), np.int64)
    rank[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
    return rank, live, docs, lengths


def _scorer(asked: pd.DataFrame, k: int, mean: float, query: pa.DataType, doc: pa.DataType):
    """Scores the blocks of a shard for asked(q, term, idf); see Shard.best()."""
    questions = {q: dict(zip(g["term"], g["idf"], strict=True)) for q, g in asked.groupby("q", sort=False)}

    def run(hits: pa.Table, table: pa.Table) -> pa.Table:
        rows, found = [], pa.array([], doc)
        if hits.num_rows:
            rank, live, docs, lengths = _shard(table)
            shard = Shard(hits.column("term").to_numpy(), hits.column("n").to_numpy(), unpacked(hits.column("ords"), _ORD), unpacked(hits.column("tfs"), _TF), hits.column("most").to_numpy(), hits.column("least").to_numpy(), lengths, live, rank, mean)
            rows = [(q, d, x) for q, idfs in questions.items() for d, x in shard.best(idfs, k)]
            found = docs.take(pa.array([d for _, d, _ in rows], pa.int64()))
        return pa.table({"q": pa.array([q for q, _, _ in rows], query), "doc": found, "score": pa.array([x for _, _, x in rows], pa.float64())})

    return run


class Shard:
    """A shard's blocks of the asked terms as flat arrays; documents are their places.

    terms, sizes, most, least: of each block; at, tfs: of each posting, block by block; lengths, live, rank: of each
    document. skipped: blocks that best() has passed over so far.
    """

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, at: np.ndarray, tfs: np.ndarray, most: np.ndarray, least: np.ndarray, lengths: np.ndarray, live: np.ndarray, rank: np.ndarray, mean: float):
        ends = np.cumsum(sizes)
        order = np.argsort(terms, kind="stable")
        self.at, self.live, self.rank, self.w = at, live, rank, weight(tfs.astype(float), lengths[at], mean)
        self.starts, self.ends = (ends - sizes)[order], ends[order]
        self.bound = weight(most.astype(float), least.astype(float), mean)[order]
        terms = terms[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        self.blocks = {terms[a]: (a, b) for a, b in zip(first, np.r_[first[1:], len(terms)], strict=True)}
        self.low, self.high = at[self.starts], at[self.ends - 1]
        self.skipped = 0

    def best(self, idfs: dict[str, float], k: int) -> list[tuple]:
        """The best k live documents of one question, by score to nine places, then id.

        Terms are taken by what they can add at most. Once the rest of them can't lift an unseen document to the k-th
        best score so far, only blocks between whose ends a document stands that may still be among the best are read.
        """
        own = sorted(((i * self.bound[a:b].max(), i, a, b) for t, i in idfs.items() for a, b in [self.blocks.get(t, (0, 0))] if b > a), key=lambda x: (-x[0], x[2]))
        rest = np.cumsum([0.0, *(x[0] for x in reversed(own))])[::-1]
        scores, hopeful = np.zeros(len(self.live)), None
        for j, (_, i, a, b) in enumerate(own):
            if hopeful is None and j:
                seen = scores[self.live]
                if len(seen) > k and (least := np.partition(seen, len(seen) - k)[len(seen) - k]) > rest[j] + 1e-6:
                    hopeful = np.flatnonzero(self.live & (scores + rest[j] + 1e-6 >= least))
            held = range(a, b)
            if hopeful is not None:
                some = np.searchsorted(hopeful, self.high[a:b], "right") > np.searchsorted(hopeful, self.low[a:b])
                self.skipped += int((~some).sum())
                held = np.flatnonzero(some) + a
            for x in held:
                s, e = self.starts[x], self.ends[x]
                scores[self.at[s:e]] += i * self.w[s:e]  # a document is in a term's blocks once
        scores[~self.live] = 0
        if hopeful is not None:
            only = np.zeros(len(scores), bool)
            only[hopeful] = True
            scores[~only] = 0
        rounded = np.round(scores, 9)
        some = np.flatnonzero(scores > 0)
        if len(some) > k:
            some = some[rounded[some] >= np.partition(rounded[some], len(some) - k)[len(some) - k]]
        order = some[np.lexsort((self.rank[some], -rounded[some]))][:k]
        return [(int(x), scores[x]) for x in order]
