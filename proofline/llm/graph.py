"""Connected components of an undirected graph, by large-star and small-star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.session import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on rows (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that both sides of the join are plain tables and Spark can split a node with very many links
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    # large star: neighbours above a node are hung below the least node around it
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = cut(large)
    # small star: a node and its neighbours below it are hung below the least of these
    low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its least node.

    Loops and repeated edges do no harm, edges with a null end are left out, an empty table gives no rows.  The rounds grow with the
    logarithm of the longest path.  Each is written to the shared folder, which ends the lineage; the driver
    sees a few counts only.  A node with very many links is an aggregate with map-side combine and a join Spark can split.
    """
    ends = edges.select("u", "v").where("u is not null and v is not null and u != v")
    now = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        # unchanged edges are all stars; equal counts and sums of hashes stand for equal sets
        mark = tuple(now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)")),
        ).collect()[0])
        if mark == seen or not mark[0]:
            break
        seen, now = mark, cut(_stars(now))
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
