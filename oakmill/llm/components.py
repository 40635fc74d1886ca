"""Connected components by alternating large-star and small-star steps, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakmill.llm.common import discard, join_groups, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v`` longs): root is the component's least node.

    Each round replaces edges by edges to smaller nodes; the number of rounds grows with the logarithm of
    the longest path. Results of rounds are written to the shared folder; neither edges nor components
    come to the driver, only a count and a checksum do. Nodes with more than a thousandth of all edges are joined by
    broadcasting their row (``join_groups``), so a component's hub is no hot key.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, last = None, None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        if last:
            discard(*last)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_groups(both, least, ["u"], "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, least, ["u"], "n", mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = now, large
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
