"""Types, frequencies, genotypes and texts of calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_places(x: Column) -> Column:
    """Round to two places by the exact binary value, half to even, as printing does."""
    return F.format_number(x, 2).cast("double")


def vaf(support: Column, depth: Column) -> Column:
    return F.when(depth > 0, two_places(F.least(F.lit(1.0), support / depth))).otherwise(1.0)


def genotype(freq: Column) -> Column:
    return F.when(freq >= 0.8, "1/1").when(freq >= 0.2, "0/1").otherwise("0/0")


def reference_reads(depth: Column, support: Column) -> Column:
    return F.greatest(depth - support, F.lit(0))


def variant_type(op: Column, chrom: Column, start: Column, src_chrom: Column, src_start: Column, src_end: Column, src_strand: Column, min_size: int) -> Column:
    """Type of an event: an insertion with a source is a duplication, a tandem one if the source touches it."""
    back = src_strand == "-"
    near = (src_chrom == chrom) & ((F.abs(src_start - start) <= min_size) | (F.abs(src_end - start) <= min_size))
    dup = F.when(near, F.when(back, "itDUP").otherwise("tDUP")).otherwise(F.when(back, "idDUP").otherwise("dDUP"))
    return F.when(op == "B", "BND").when(op == "D", "DEL").when(op == "V", "INV").when(src_chrom.isNull(), "INS").otherwise(dup)


def is_complex(kind: Column) -> Column:
    return F.when(kind.contains("+") | kind.isin("itDUP", "idDUP"), "CSV").otherwise("SV")


def breakend(chrom: Column, pos: Column, strand: Column) -> Column:
    at = F.concat_ws(":", chrom, pos.cast("string"))
    return F.when(strand == "-", F.concat(F.lit("]"), at, F.lit("]N"))).otherwise(F.concat(F.lit("["), at, F.lit("[N")))


def parsed_breakend(alt: Column) -> Column:
    """chrom2, pos2, strand2 of a breakend's text; strand2 is "-" where it holds a ]."""
    at = F.regexp_extract(alt, r"[\[\]]([^\[\]]+):\d+[\[\]]", 1)
    pos = F.regexp_extract(alt, r":(\d+)[\[\]]", 1).try_cast("long")
    return F.struct(at.alias("chrom2"), pos.alias("pos2"), F.when(alt.contains("]"), "-").otherwise("+").alias("strand2"))


def inheritance(target: Column, base: Column, least: float, somatic: bool) -> Column:
    """NewCOMP: the base has none; NewALLELE: their frequencies differ by ``least`` or more; else Germline."""
    new = (base == 0) & (target >= least) if somatic else base == 0
    return F.when(new, "NewCOMP").when(F.abs(target - base) >= least, "NewALLELE").otherwise("Germline")


def allele_inheritance(base_vaf: Column, base_class: Column, target_vaf: Column, target_class: Column, least: float, somatic: bool) -> Column:
    """As inheritance, for alleles with a class: one that the base has in another class is new, too."""
    enough = target_vaf >= least if somatic else F.lit(True)
    new = ((base_vaf == 0) | (base_class != target_class)) & enough
    changed = (base_class == target_class) & (F.abs(base_vaf - target_vaf) >= least)
    return F.when(new, "NewCOMP").when(changed, "NewALLELE").otherwise("Germline")


def overlap_class(s1: Column, e1: Column, s2: Column, e2: Column, slack: int = 50) -> Column:
    """How spans a and b of one chromosome overlap; containment allows ``slack`` at each end and is tested first."""
    same = (s1 == s2) & (e1 == e2)
    return (
        F.when(same, "non_overlap")
        .when((s2 - slack <= s1) & (s1 < e1) & (e1 <= e2 + slack), "a_in_b")
        .when((s1 - slack <= s2) & (s2 < e2) & (e2 <= e1 + slack), "b_in_a")
        .when((s1 < s2) & (s2 < e1) & (e1 < e2), "a_before_b")
        .when((s2 < s1) & (s1 < e2) & (e2 < e1), "b_before_a")
        .otherwise("non_overlap")
    )


def genotype_by_likelihood(ref: Column, alt: Column) -> Column:
    """The genotype whose share of alternative reads (0.05, 0.5, 0.95) explains the counts best; ties to the lesser."""
    like = lambda p: alt * F.log(F.lit(p)) + ref * F.log(F.lit(1 - p))
    a, b, c = like(0.05), like(0.5), like(0.95)
    return F.when((a >= b) & (a >= c), "0/0").when(b >= c, "0/1").otherwise("1/1")


def span_distance(s1: Column, e1: Column, s2: Column, e2: Column, norm: Column) -> Column:
    """The least of the distances of starts, ends and centres by ``norm``, plus the relative difference of the spans."""
    centre = lambda s, e: F.floor((s + e) / 2)
    near = F.least(F.abs(s1 - s2), F.abs(e1 - e2), F.abs(centre(s1, e1) - centre(s2, e2)))
    return near / norm + F.abs((e1 - s1) - (e2 - s2)) / F.greatest(e1 - s1, e2 - s2)


def reverse_complement(bases: Column) -> Column:
    clean = F.regexp_replace(bases, "[^ACGT]", "N")
    return F.reverse(F.translate(clean, "ACGT", "TGCA"))
