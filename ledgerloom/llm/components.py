"""Connected components of a link table, by alternating large-star and small-star steps.

Each step moves links to smaller neighbours with a grouped minimum (combined before the shuffle) and a join, so no
group is ever gathered; a hub is split by the adaptive skew join. The number of rounds grows with the logarithm of the
size of a component. Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """One row (node, root) for each end of links(a, b), both bigint; root is the component's smallest node.

    Links to oneself and with null ends count as none; repeated links count once. No links give no rows.
    """
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b")
    edges, mark = cut(ordered.distinct()), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.persist()  # read twice; what an executor loses is made again from the last checkpoint
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(root.withColumnRenamed("m", "v")).distinct())
        large.unpersist()
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
