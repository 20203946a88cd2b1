"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link larger neighbours to the smallest of all. Small star: link the node and its smaller ones."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # written, both sides of the join are shuffled for it, so that the rows of a hot node can be split
    out = both.join(common.cut(least, "star"), "u")
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    odd = ends.groupBy("node").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("v")).filter("n > 1 OR n = 1 AND v = 1")
    return common.is_empty(odd)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v); the root is the component's smallest node.

    Each round writes the edges to the shared folder. It ends when the edges are stars: no node has two smaller
    neighbours, and none is both smaller and larger. Hot nodes are only aggregated and joined, so they can be split.
    """
    now = common.cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    while not _are_stars(now):
        now = common.cut(_star(_star(now, True).distinct(), False).distinct(), tag)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
