"""Ordered scans along a key in two levels, so that a key may hold a third of all rows.

Rows of a key are cut into tiles of the position. What is before a tile comes from one row for each
tile; what is before a row in its tile comes from a window of that tile alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspan.sources.tables import kept

#: Positions of a tile.
TILE = 1_000_000


def _tiled(df: DataFrame, pos: str, tile: int) -> DataFrame:
    return df.withColumn("_tile", F.floor(F.col(pos) / tile))


def running_sum(df: DataFrame, keys: list[str], pos: str, value: str, out: str, tile: int = TILE) -> DataFrame:
    """Sum of ``value`` up to each row, by position; positions are distinct within a key."""
    df = _tiled(df, pos, tile)
    sums = df.groupBy(*keys, "_tile").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_tile", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys, "_tile").orderBy(pos)
    return df.join(sums, [*keys, "_tile"]).withColumn(out, F.col("_before") + F.sum(value).over(w)).drop("_tile", "_before")


def islands(df: DataFrame, keys: list[str], pos: str, gap: int, out: str, tile: int = TILE) -> DataFrame:
    """The first position of each row's island: runs of rows whose neighbours lie at most ``gap`` apart.

    Rows are exchanged once and written; tiles are written too, so that joining them moves no rows where they are few.
    """
    w = Window.partitionBy(*keys, "_tile").orderBy(pos)
    df = _tiled(df, pos, tile).withColumn("_prev", F.lag(pos).over(w))
    # null up to the first gap in the tile
    df = kept(df.withColumn("_first", F.max(F.when(F.col(pos) - F.col("_prev") > gap, F.col(pos))).over(w)).drop("_prev"))
    ends = df.groupBy(*keys, "_tile").agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.max("_first").alias("_f"))
    by = Window.partitionBy(*keys).orderBy("_tile")
    ends = ends.withColumn("_new", F.when(F.coalesce(F.col("_lo") - F.lag("_hi").over(by) > gap, F.lit(True)), F.col("_lo")))
    head = F.greatest(F.max("_new").over(by), F.max("_f").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ends = kept(ends.select(*keys, "_tile", head.alias("_head")))
    return df.join(ends, [*keys, "_tile"]).withColumn(out, F.coalesce("_first", "_head")).drop("_tile", "_first", "_head")


def merged(df: DataFrame, keys: list[str], lo: str, hi: str, out: str, tile: int = TILE) -> DataFrame:
    """The first ``lo`` of each row's run of stretches [lo, hi] that overlap or touch."""
    df = _tiled(df, lo, tile)
    by = Window.partitionBy(*keys).orderBy("_tile")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "_tile").agg(F.max(hi).alias("_last"))
    ends = ends.select(*keys, "_tile", F.max("_last").over(upto).alias("_before"))
    w = Window.partitionBy(*keys, "_tile").orderBy(lo)
    reached = F.greatest(F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    df = df.join(ends, [*keys, "_tile"]).withColumn("_reached", reached)
    df = df.withColumn("_first", F.when(F.col("_reached").isNull() | (F.col(lo) > F.col("_reached")), F.col(lo)))
    firsts = df.groupBy(*keys, "_tile").agg(F.max("_first").alias("_f"))
    df = df.join(firsts.select(*keys, "_tile", F.max("_f").over(upto).alias("_carry")), [*keys, "_tile"])
    return df.withColumn(out, F.coalesce(F.max("_first").over(w), "_carry")).drop("_tile", "_before", "_reached", "_first", "_carry")
