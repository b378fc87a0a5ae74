"""CIGAR strings as arrays of (n, op)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(cigar: Column) -> Column:
    """[n, op] of each operation."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[A-Z=])"), F.lit(1))
    return F.transform(found, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("long").alias("n"), F.right(t, F.lit(1)).alias("op")))


def without_clips(toks: Column) -> Column:
    """One S or H at each end goes; a lone operation stays."""
    clip = lambda t: t["op"].isin("S", "H")
    n = F.size(toks)
    left = F.when((n > 1) & clip(toks[0]), 1).otherwise(0)
    right = F.when((n > 1) & clip(F.element_at(toks, -1)), 1).otherwise(0)
    return F.slice(toks, left + 1, F.greatest(n - left - right, F.lit(0)))


def total(toks: Column, ops: str) -> Column:
    """Sum of the lengths of some operations."""
    return F.aggregate(F.filter(toks, lambda t: t["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, t: a + t["n"])


def ref_span(toks: Column) -> Column:
    return total(toks, "MD=XE")


def read_span(toks: Column) -> Column:
    return total(toks, "MIN=XE")


def mismatch_ratio(cigar: Column, start: Column, end: Column) -> Column:
    """Operations (not bases) that are X, I or D, for each base of the reference span."""
    return F.length(F.regexp_replace(cigar, "[^XID]", "")) / (end - start)


def events(toks: Column, ref_start: Column) -> Column:
    """[op, n, ref_start, ref_end, read_start] of each I and D.

    An insertion lies at the base before it and has no width; a deletion spans its bases; N and S
    move along the read only.
    """
    e = "array<struct<op:string,n:bigint,ref_start:bigint,ref_end:bigint,read_start:bigint>>"
    zero = F.struct(ref_start.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.array().cast(e).alias("out"))

    def step(a, t):
        moves_ref, moves_read = t["op"].isin("M", "D", "=", "X", "E"), t["op"].isin("M", "I", "N", "S", "=", "X", "E")
        at = F.when(t["op"] == "I", a["ref"] - 1).otherwise(a["ref"])
        end = F.when(t["op"] == "I", a["ref"] - 1).otherwise(a["ref"] + t["n"] - 1)
        one = F.struct(t["op"].alias("op"), t["n"].alias("n"), at.alias("ref_start"), end.alias("ref_end"), a["read"].alias("read_start"))
        return F.struct(
            (a["ref"] + F.when(moves_ref, t["n"]).otherwise(0)).alias("ref"),
            (a["read"] + F.when(moves_read, t["n"]).otherwise(0)).alias("read"),
            F.when(t["op"].isin("I", "D"), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(toks, zero, step, lambda a: a["out"])
