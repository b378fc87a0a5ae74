"""Depth as segments of constant value, by a sweep along the chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspan.operators.ranges import overlap_join
from varspan.operators.scan import TILE
from varspan.sources.tables import kept


def read_unions(spans: DataFrame) -> DataFrame:
    """Spans (sample, chrom, read_id, lo, hi) of a read merged where they overlap or touch, so a read counts once."""
    return _unions(spans, ["sample", "chrom", "read_id"])


def _unions(spans: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", (top.isNull() | (F.col("lo") > top + 1)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def segments(spans: DataFrame, tile: int = TILE) -> DataFrame:
    """sample, chrom, lo, hi, depth: maximal runs between changes; depth 0 has no row.

    Spans are cut at the ends of tiles and exchanged once, by tile: a read's spans meet there, the changes
    are summed there, and what is cut at a tile's end is joined again, of which a tile has two at most.
    """
    at = F.col("_tile") * tile
    of = lambda c: F.floor(F.col(c) / tile)
    x = spans.select("sample", "chrom", "read_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    x = x.withColumn("_tile", F.explode(F.sequence(of("lo"), of("hi")))).withColumns({"lo": F.greatest("lo", at), "hi": F.least("hi", at + (tile - 1))})
    # the exchange by tile serves every step up to the written table
    own = ["sample", "chrom", "_tile"]
    one = _unions(x.repartition(*own), [*own, "read_id"])
    edges = one.select(*own, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.groupBy(*own, F.col("e.at").alias("lo")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*own).orderBy("lo")
    found = edges.withColumns({"depth": F.sum("d").over(w).cast("long"), "hi": F.lead("lo").over(w) - 1}).where("depth > 0")
    found = kept(found.select("sample", "chrom", "lo", "hi", "depth", ((F.col("lo") == at) | (F.col("hi") == at + (tile - 1))).alias("_cut")))
    w = Window.partitionBy("sample", "chrom").orderBy("lo")
    new = F.coalesce((F.lag("hi").over(w) + 1 != F.col("lo")) | (F.lag("depth").over(w) != F.col("depth")), F.lit(True))
    cut = found.where("_cut").withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    cut = cut.groupBy("sample", "chrom", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("depth").alias("depth"))
    names = ["sample", "chrom", "lo", "hi", "depth"]
    return found.where("not _cut").select(*names).unionByName(cut.select(*names))


def depth_around(points: DataFrame, segs: DataFrame, before: int = 5, after: int = 4, size: int = 1000) -> DataFrame:
    """Points (id, sample, chrom, pos) with the largest depth from pos - before to pos + after; 0 where there is none."""
    p = points.withColumns({"lo": F.col("pos") - before, "hi": F.col("pos") + after})
    s = segs.select("sample", "chrom", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "depth")
    best = overlap_join(p, s, ["sample", "chrom"], size).groupBy("id").agg(F.max("depth").alias("depth"))
    return points.join(best, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
