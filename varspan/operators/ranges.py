"""Joins of intervals by bins: an equi-join on (key, bin) and the overlap as its residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], size: int, how: str = "inner") -> DataFrame:
    """Rows of ``left`` (lo, hi) and ``right`` (lo2, hi2) whose closed intervals overlap, once each.

    Both sides go to every bin that they touch; a pair counts in the later of their first bins
    only. ``size`` should be near the usual length, so that few rows go to several bins.
    """
    first = lambda c: F.floor(F.col(c) / size)
    bins = lambda a, b: F.explode(F.sequence(first(a), first(b)))
    lb = left.withColumn("_bin", bins("lo", "hi"))
    rb = right.withColumn("_bin", bins("lo2", "hi2"))
    hit: Column = (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")) & (F.col("_bin") == F.greatest(first("lo"), first("lo2")))
    return lb.join(rb, [*keys, "_bin"], how).where(hit).drop("_bin")
