"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges`` (a, b).

    Every round is joins and minima over edges, written before the next round;
    a star of any size is a join that Spark can split, never one group in
    memory. The number of edges never grows. Rounds grow with the logarithm of
    the component's size. Loops and repeated edges do no harm; nulls are left
    out.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last, told = scratch.write(pairs, f"{name}_0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if mark == last:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        last, told = mark, told + 1
        now = scratch.write(small, f"{name}_{told}")
        scratch.drop(f"{name}_{told - 1}")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
