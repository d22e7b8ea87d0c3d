"""A manifest of a table as a tree of hashes: a root for all, a root for each group, and a proof for each row.

Rows are numbered within their group by one range-partitioned sort and counts by partition, so that a group of any size
is spread over all tasks. Each level is a window over group and parent index, whose ordered full frame collects the
hashes of a run: they are what the parent is the hash of, and a node's siblings. The first row of a run stands for the
parent at the next level, which drops the repeats without a shuffle. Proofs are put together from the root down: a
level has an eighth of the rows below it, so the siblings of all upper levels travel with an eighth of the leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, LOWER, UPPER, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field's bytes in the leaf: `-` for null, else its length in bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with i, their place within their group from 0, and n, the rows of the group. rows must be a stored table.

    One sort by range over all tasks; a place is the row's place in its task's part of the group and the rows of the
    parts before, of which there are as many as tasks and groups.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    pieces = at.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_m"))
    pieces = stored(pieces)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("n", F.sum("_m").over(Window.partitionBy("_group"))).drop("_m")
    few = pieces.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = at.join(F.broadcast(pieces) if few else pieces, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("i", F.col("_before") + F.col("_at") - F.col("_lo")).drop("_at", "_part", "_group", "_lo", "_before")


def _runs(nodes: DataFrame, group: str, fanout: int) -> DataFrame:
    """nodes with run, the hashes of the node's run in order."""
    frame = Window.partitionBy(group, "_parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("_parent", F.floor(F.col("i") / fanout).cast("long")).withColumn("run", F.collect_list("h").over(frame))


def _step(fanout: int) -> Column:
    """What stands left and right of a node in its run."""
    k = (F.col("i") % fanout).cast("int")
    return F.struct(F.array_join(F.slice("run", F.lit(1), k), "").alias("l"), F.array_join(F.slice("run", k + 2, F.lit(fanout)), "").alias("r"))


def tree(leaves: DataFrame, group: str, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """(tops, levels): one row (group, h) for each group, and the nodes of each level, of leaves(group, i, n, h, …)."""
    levels, height = [leaves], 0
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most, height = -(-most // fanout), height + 1
        below = _runs(levels[-1].where("n > 1").select(group, "i", "n", "h"), group, fanout).where(F.col("i") % fanout == 0)
        levels.append(stored(below.select(group, F.col("_parent").alias("i"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("h"))))
    return reduce(DataFrame.unionByName, [x.where("n = 1").select(group, "h") for x in levels]), levels


def with_paths(levels: list[DataFrame], tops: DataFrame, group: str, fanout: int = FANOUT) -> DataFrame:
    """The leaves with the columns of tops and path, the steps up to the root. tops: (group, path, …) for each group."""
    few = tops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    tops = tops.withColumnRenamed(group, "_top")
    kept = [c for c in tops.columns if c != "_top"]
    above = None
    for nodes in reversed(levels):
        out = nodes.where("n = 1").join(F.broadcast(tops) if few else tops, F.col(group).eqNullSafe(F.col("_top"))).drop("_top")
        if above is not None:
            runs = _runs(nodes.where("n > 1"), group, fanout)
            up = above.select(F.col(group).alias("_g"), F.col("i").alias("_i"), *kept)
            more = runs.join(up, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_parent") == F.col("_i"))).withColumn("path", F.concat(F.array(_step(fanout)), "path"))
            out = more.drop("_g", "_i", "_parent", "run").unionByName(out)
        above = out
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of df: `order`, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the row's fields. The leaves of a group ascend by `order`; while there are several nodes, each
    `fanout` neighbours become one. The tops of the groups, by group with null first, make up a tree of their own with
    the root. tampered: other values of fields with which each row is held against the manifest; those not given are
    the row's own. Nulls are fields of their own kind; rows with the same `order` follow each other by leaf, and equal
    rows have equal leaves in places of their own. An empty table gives no rows. Other columns of df aren't used.
    """
    tampered = tampered or {}
    # The leaves are stored, so that each text is read and hashed once.
    rows = df.select(F.col(group).cast("string").alias("_lang"), F.col(order).alias("_id"), leaf_hash(*[F.col(c) for c in fields]).alias("h"), leaf_hash(*[tampered.get(c, F.col(c)) for c in fields]).alias("held"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    leaves = numbered(rows, "_lang", ["_id", "h", "_row"]).drop("_row")
    tops, levels = tree(leaves, "_lang", fanout)
    tops = stored(tops.withColumn("_all", F.lit(0)))
    groups = numbered(tops, "_all", ["_lang"])
    top, above = tree(groups, "_all", fanout)
    top = stored(top.select("_all", F.col("h").alias("root"), F.array().cast("array<struct<l:string,r:string>>").alias("path")))
    roots = stored(with_paths(above, top, "_all", fanout).select("_lang", F.col("h").alias("subroot"), "root", "path"))
    out = with_paths(levels, roots, "_lang", fanout)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    out = out.select(F.col("_id").alias(order), F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("held"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased_thirds(doc_id: Column, text: Column) -> Column:
    """text with A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id (a row without one stays)."""
    return F.when(F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False)), F.translate(text, UPPER, LOWER)).otherwise(text)
