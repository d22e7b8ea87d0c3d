"""SimHash near-dedup by similarity: texts whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

Each distinct set of shingles has a SimHash fingerprint of two 64-bit words. Pairs whose fingerprints lie within the
radius that such a similarity gives are found by the tiled comparison of `simhash`, in cells by the set's size (a
similarity bounds the sizes' ratio) and by population count; then an exact check of the whole sets decides. Of pairs
that similar, the radius leaves out fewer than one in a thousand, those of sets with few shingles apart: there a few per cent
at the threshold itself.

The comparison runs twice. First each group of fingerprints gives a spanning forest of its nearest pairs, which are
checked. Where a check fails, the fingerprints of that group are compared again, their whole sets beside them: the
worker checks each pair whose ends the first check hasn't joined, and emits a forest of the similar ones. So no pairs
are emitted within a group of copies, and no link is lost for want of a check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, cut, rereadable, small_batches, with_row_id, without_rows
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import SEED, compare_cells, grams, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Standard deviations that a radius lies above the distance expected at the similarity.
DEVIATIONS = 3.6
#: Largest size class and population count of a cell; sizes of 2 ** 63 at similarities up to 0.999 are below it.
_CLASSES, _BASE = 50_000, 130


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(grams(text, shingle).view(np.int64))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes, one drawn from each: for the second word of a fingerprint."""
    z = hashes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def radius(similarity: float, bits: int, deviations: float = DEVIATIONS) -> int:
    """Bits within which all but a few fingerprints of sets that similar lie: a bit differs with the chance angle / pi."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return min(bits, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(_rid, key, n, f0, f1) for each row of rows(_rid, text): its set's hash, size and fingerprint."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t, shingle).view(np.uint64) for t in b.column(1).to_pylist()]
            keys = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in own]
            words = [np.array(x, np.uint64).view(np.int64) for x in (keys, [majority(s) for s in own], [majority(mixed(s)) for s in own])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words[0]), pa.array([len(s) for s in own], pa.int64()), *map(pa.array, words[1:])], names=["_rid", "key", "n", "f0", "f1"])

    return rows.mapInArrow(run, "_rid bigint, key bigint, n bigint, f0 bigint, f1 bigint")


def _whole(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t, shingle) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["_rid", "s"])

    return rows.mapInArrow(run, "_rid bigint, s array<bigint>")


def _cells(nodes: DataFrame, least: Fraction, far: int) -> DataFrame:
    """nodes(node, n, f0, f1, ...) with their cell and the cells that they visit."""
    width = math.log(1 / float(least)) * (1 + 1e-9) + 1e-9  # sizes that fit each other lie in one class or in neighbours
    size = F.least(F.floor(F.log("n") / width), F.lit(_CLASSES))
    pops = F.floor((F.bit_count("f0") + F.bit_count("f1")) / (far + 1)).cast("long")
    at = lambda up, more: (F.col("_size") + up) * _BASE + F.col("_pops") + more
    placed = nodes.withColumns({"_size": size, "_pops": pops})
    return placed.withColumn("targets", F.array(at(0, 1), *[at(1, more) for more in (-1, 0, 1)])).withColumn("cell", at(0, 0))


def _similar(pairs: DataFrame, rows: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The rows of pairs(a, b) whose whole sets are similar. rows(_rid, text) are read again for the texts asked for only."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_rid")).distinct().persist()
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    whole = cut(_whole(rows.join(F.broadcast(asked) if few else asked, "_rid", "left_semi"), shingle))
    sa, sb = (whole.select(F.col("_rid").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    asked.unpersist()
    both = pairs.join(sa, "a").join(sb, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    p, q = least.numerator, least.denominator
    return both.where(F.col("common") * (p + q) >= (F.size("sa") + F.size("sb")) * p).select("a", "b")


def _roots(nodes: DataFrame, rows: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(node, root) of the nodes(node, n, f0, f1) that all similar pairs within the radius join to others."""
    far, first = radius(float(least), 128), radius(float(least), 64)
    bound = (_CLASSES + 2) * _BASE if least > Fraction(9, 10) else math.ceil(math.log(2**63) / math.log(1 / float(least)) + 2) * _BASE
    words = ["f0", "f1"]
    cells = _cells(nodes, least, far)
    forest = cut(compare_cells(cells.select("cell", "targets", *words, "node"), words, far, first, "node", bound=bound).distinct())
    joined = cut(_similar(forest, rows, shingle, least))
    label = cut(components(joined).withColumnRenamed("root", "label"))
    failed = forest.join(joined, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # A forest's path from one label to another has a failed pair next to each of the labels between which it runs.
    labelled = failed.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    members = label.join(labelled.select("label").distinct(), "label", "left_semi").select("node", "label")
    again = cut(members.unionByName(labelled).distinct())
    if again.isEmpty():
        return label.withColumnRenamed("label", "root")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = again.select(F.col("node").alias("_rid"))
    whole = _whole(rows.join(F.broadcast(keys) if few else keys, "_rid", "left_semi"), shingle).withColumnRenamed("_rid", "node")
    cells = cut(cells.select("cell", "targets", *words, "node").join(again, "node").join(whole, "node"))
    more = compare_cells(cells, words, far, first, "node", ("label", "s"), (least.numerator, least.denominator), bound=bound)
    of = lambda end: again.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    higher = components(between).withColumnRenamed("node", "label")
    every = label.unionByName(again.select("node", "label")).distinct()
    return every.join(higher, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of df: _rid, doc_id, component_id, keep_rid, as simhash.near_duplicates names them.

    Components are those of the pairs with a Jaccard similarity of `similarity` (above 0, at most 1) or more. Texts
    without words, null ones among them, are copies of each other and of nothing else. An empty table gives no rows.
    """
    least = Fraction(str(similarity))
    small_batches(df.sparkSession)
    df = rereadable(df)
    rows = with_row_id(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    ids, texts = rows.select("_rid", "doc_id"), rows.select("_rid", "text")
    sets = cut(_sets(texts, shingle))
    nodes = cut(sets.groupBy("key").agg(F.min("_rid").alias("node"), *[F.first(c).alias(c) for c in ("n", "f0", "f1")]))
    named = sets.select("_rid", "key").join(nodes.select("key", "node"), "key").select("_rid", "node")
    if least < 1:  # equal sets are one node
        roots = cut(_roots(nodes.where("n > 0").drop("key"), texts, shingle, least))
        named = named.join(roots, "node", "left").select("_rid", F.coalesce("root", "node").alias("root"))
    named = named.withColumnRenamed("node", "root").join(ids, "_rid")
    least_id = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rid")).alias("least"))
    return named.join(least_id, "root").select("_rid", "doc_id", F.col("least.doc_id").alias("component_id"), F.col("least._rid").alias("keep_rid"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """df with one row of each component: the one with the smallest doc_id. Its columns stay as they are."""
    df = rereadable(df)
    dropped = cut(near_copies(df, doc_id, text, shingle, similarity).where("_rid <> keep_rid").select("_rid"))
    return without_rows(df, dropped)
