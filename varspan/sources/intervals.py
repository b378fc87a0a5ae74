"""Intervals: BED files, regions, tiles, and scans of a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varspan.operators.depth import read_unions
from varspan.operators.ranges import overlap_join


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long")


def chrom_ends(bed: DataFrame) -> DataFrame:
    return bed.groupBy("chrom").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n_intervals"))


def tiles(lengths: DataFrame, size: int) -> DataFrame:
    """Tiles of ``size``, one more than whole ones fit: the last may run over the end."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / size)))
    return lengths.select("chrom", n.alias("tile")).select("chrom", (F.col("tile") * size).alias("start"), ((F.col("tile") + 1) * size).alias("end"))


def parse_region(region: Column, pad: int = 2000) -> Column:
    at = lambda g: F.regexp_extract(region, r"^(.+):(\d+)-(\d+)$", g)
    return F.struct(at(1).alias("chrom"), (at(2).cast("long") - pad).alias("start"), (at(3).cast("long") + pad).alias("end"))


def in_region(aln: DataFrame, chrom: str, lo: int, hi: int) -> DataFrame:
    """Alignments that overlap a region: comparisons of plain columns, which Parquet statistics prune."""
    return aln.where((F.col("chrom") == chrom) & (F.col("ref_start") <= hi) & (F.col("ref_end") >= lo))


def in_intervals(aln: DataFrame, bed: DataFrame, size: int = 100_000) -> DataFrame:
    """Alignments that overlap an interval of ``bed`` (chrom, start, end; from 0, open at the end), once each.

    Intervals that overlap or touch are one first. An alignment counts with the first one that it
    overlaps, which is the one before which the others end too early; so nothing is made distinct.
    """
    own = bed.where("start < end").select(F.lit("").alias("sample"), "chrom", F.lit("").alias("read_id"), (F.col("start") + 1).alias("lo"), F.col("end").alias("hi"))
    w = Window.partitionBy("chrom").orderBy("lo")
    whole = read_unions(own).select("chrom", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.lag("hi").over(w).alias("_before"))
    x = aln.withColumns({"lo": F.col("ref_start"), "hi": F.col("ref_end")})
    met = overlap_join(x, whole, ["chrom"], size).where(F.col("_before").isNull() | (F.col("_before") < F.col("lo")))
    return met.select(*aln.columns)
