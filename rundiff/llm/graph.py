"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundiff.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then every node hands its smaller neighbours to the smallest. Each step is an
    aggregation that combines before the shuffle and a join with one row per node on one side, so a
    node with very many edges is split by adaptive execution. The edges of a step are written to the
    shared folder; the driver sees two numbers a round. Nulls and self-loops are ignored; an empty
    edge list gives no rows.
    """
    def oriented(df):
        return df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = cut_lineage(oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()))
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = cut_lineage(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
