"""Signatures: filters, collapse of equal ones, and runs that are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspan.functions import cigar
from varspan.operators.ranges import overlap_join
from varspan.params import Params


def usable_reads(sig: DataFrame, p: Params) -> DataFrame:
    """Only the target's rows need the least mapping quality."""
    return sig.where((F.col("sample") != "target") | (F.col("mapq") >= p.min_mapq))


def within_reads(aln: DataFrame, p: Params) -> DataFrame:
    """I and D events of alignments; those up to short_slack below min_size are kept as shorter ones."""
    e = aln.select("aln_id", "read_id", "chrom", F.explode(cigar.events(cigar.without_clips(cigar.tokens(F.col("cigar"))), F.col("ref_start"))).alias("e"))
    e = e.select("aln_id", "read_id", "chrom", "e.op", F.col("e.n").alias("length"), "e.ref_start", "e.ref_end", "e.read_start")
    return e.where(F.col("length") >= p.min_size - p.short_slack).withColumn("shorter", F.col("length") < p.min_size)


def collapse(sig: DataFrame) -> DataFrame:
    """Equal signatures as one, with their distinct reads; the exchange carries partial sets."""
    return sig.groupBy("sample", "chrom", "op", "ref_start", "length").agg(F.countDistinct("read_id").cast("long").alias("support"))


def merge_nearby(events: DataFrame, gap: int) -> DataFrame:
    """Runs of deletions or of insertions on one alignment, each at most ``gap`` from the end of the last, as one event.

    Deletions join the longest of them (the first, of equal ones), which grows by their lengths to
    the side on which each lies; insertions add their lengths to the first. Other ops stay alone.
    """
    w = Window.partitionBy("aln_id").orderBy("ref_start", "op", "length", "ref_end")
    far = F.abs(F.col("ref_start") - F.lag("ref_end").over(w)) > gap
    new = F.lag("op").over(w).isNull() | (F.lag("op").over(w) != F.col("op")) | far | ~F.col("op").isin("D", "I")
    runs = events.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(w))
    within = Window.partitionBy("aln_id", "_run")
    top = F.max(F.struct(F.col("length").alias("n"), (-F.col("_k")).alias("k"))).over(within)
    runs = runs.withColumn("_top", F.when(F.col("op") == "D", -top["k"]).otherwise(F.min("_k").over(within)))
    deletion, here = F.col("op") == "D", F.col("_k") == F.col("_top")
    side = lambda before: F.sum(F.when(deletion & before, F.col("length")).otherwise(0))
    return runs.groupBy("aln_id", "chrom", "op", "_run").agg(
        (F.max(F.when(here, F.col("ref_start"))) - side(F.col("_k") < F.col("_top"))).alias("ref_start"),
        (F.max(F.when(here, F.col("ref_end"))) + side(F.col("_k") > F.col("_top"))).alias("ref_end"),
        F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_merged"),
    ).drop("_run")


def usable_alignments(aln: DataFrame, access: DataFrame, p: Params, mismatch_filter: bool = False) -> DataFrame:
    """Alignments (sample, flag, chrom, ref_start, ref_end, mapq, cigar) that signatures are read from.

    Mapped ones with a CIGAR on a chromosome of ``access``; of the target neither secondary ones nor
    those below the least mapping quality; with ``mismatch_filter`` none whose operations that are
    X, I or D reach the preset's share.
    """
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    target = F.col("sample") == "target"
    kept = aln.where(F.col("cigar").isNotNull() & (F.col("cigar") != "*") & ~bit(4)).where(~target | (~bit(256) & (F.col("mapq") >= p.min_mapq)))
    if mismatch_filter:
        # the start of a file's record is one before its first base
        kept = kept.where(cigar.mismatch_ratio(F.col("cigar"), F.col("ref_start") - 1, F.col("ref_end")) < p.mismatch)
    return kept.join(access.select("chrom").distinct(), "chrom", "left_semi")


def fitting_signatures(sig: DataFrame, access: DataFrame, p: Params) -> DataFrame:
    """Signatures on a chromosome of ``access``, of max_size at most."""
    return sig.where(F.col("length") <= p.max_size).join(access.select("chrom").distinct(), "chrom", "left_semi")


def without_deep(sig: DataFrame, segments: DataFrame, most: int, size: int = 1000) -> DataFrame:
    """Signatures (sample, chrom, ref_start, ref_end) neither end of which lies where depth is above ``most``."""
    deep = segments.where(F.col("depth") > most).select("sample", "chrom", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    ends = sig.select("sample", "chrom", F.explode(F.array("ref_start", "ref_end")).alias("lo")).distinct().withColumn("hi", F.col("lo"))
    over = overlap_join(ends, deep, ["sample", "chrom"], size).select("sample", "chrom", F.col("lo").alias("_at")).distinct()
    for end in ("ref_start", "ref_end"):
        sig = sig.join(over.withColumnRenamed("_at", end), ["sample", "chrom", end], "left_anti")
    return sig
