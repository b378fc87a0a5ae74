"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import forget, save


def _distinct(df: DataFrame) -> DataFrame:
    return df.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).select("a", "b")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b; both tables of the join are written, so a hub's join can be split."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = save(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
    met = around.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s")).select(
            F.col("s.b").alias("a"), F.col("s.m").alias("b")
        )
    out = save(_distinct(out), "star")
    forget(low)
    return out


def _settled(edges: DataFrame) -> bool:
    """True if every node has one smaller neighbour, which has none itself, or none: then edges lead to the least of each component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf + root > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any direction to (node, component): the smallest node that links reach.

    Nodes without an edge have no row; loops and repeated edges change nothing. Each round halves
    the depth at least, and every round is a written table, so a lost executor costs a stage only.
    """
    now = save(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    while not _settled(now):
        then = _star(now, True)
        forget(now)
        now = _star(then, False)
        forget(then)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
