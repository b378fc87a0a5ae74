"""Clusters of signatures: islands, then the support-ordered greedy inside each; consensus by votes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspan.operators.scan import islands
from varspan.params import Params

#: Positions whose islands are clustered in one call.
TILE = 1_000_000


class _Cluster:
    """Members' starts and lengths in order, ops by insertion, and the first member's mate. It stands at their upper medians."""

    def __init__(self, op: str, mate):
        self.starts, self.lengths, self.ops, self.mate = [], [], [], (op, mate)

    def add(self, start: int, length: int, op: str) -> None:
        insort(self.starts, start)
        insort(self.lengths, length)
        self.ops.append(op)
        half = len(self.ops) // 2
        self.start, self.length, self.op = self.starts[half], self.lengths[half], self.ops[half]

    def likeness(self, start: int, length: int, op: str, mate, ratio: float, near: int) -> float:
        """Similarity of sizes; -1 where the cluster refuses: insertions against deletions, unlike sizes, far starts, and breakends with another mate."""
        if {self.op, op} == {"I", "D"} or abs(self.start - start) > near:
            return -1.0
        like = min(self.length, length) / max(self.length, length, 1)
        if like < ratio and self.length != length:
            return -1.0
        if op != "B":
            return like
        first, other = self.mate
        # the mate's distance is signed: one that lies before is never too far
        return 1.0 if first == "B" and mate is not None and other is not None and mate[0] == other[0] and mate[1] - other[1] <= near else -1.0


def greedy(starts, lengths, ops, support, ratio: float, near: int, mates=None) -> list[int]:
    """Cluster number of each signature, in order of support: the most size-similar cluster that takes it, or a new one.

    Ops don't split clusters, but for insertions against deletions. Clusters are looked up by the
    stretch of ``near`` positions in which they stand, so a long island costs what its neighbours are.
    """
    return _grouped(starts, lengths, ops, support, ratio, near, mates)[0]


def _grouped(starts, lengths, ops, support, ratio: float, near: int, mates=None) -> tuple[list[int], list[_Cluster], set[int]]:
    """Cluster of each signature, the clusters, and the signature that began each."""
    mates = mates or [None] * len(starts)
    order = sorted(range(len(starts)), key=lambda k: (-support[k], starts[k], ops[k], lengths[k], mates[k] or ("", 0)))
    clusters: list[_Cluster] = []
    at: dict[int, list[int]] = defaultdict(list)
    out, leads = [0] * len(starts), set()
    for k in order:
        best, chosen = -1.0, -1
        stretch = starts[k] // (near + 1)
        for g in sorted(g for t in (stretch - 1, stretch, stretch + 1) for g in at.get(t, ())):
            like = clusters[g].likeness(starts[k], lengths[k], ops[k], mates[k], ratio, near)
            if like > best:
                best, chosen = like, g
        if chosen < 0:
            chosen = len(clusters)
            clusters.append(_Cluster(ops[k], mates[k]))
            leads.add(k)
            before = None
        else:
            before = clusters[chosen].start // (near + 1)
        clusters[chosen].add(starts[k], lengths[k], ops[k])
        now = clusters[chosen].start // (near + 1)
        if now != before:
            if before is not None:
                at[before].remove(chosen)
            insort(at[now], chosen)
        out[k] = chosen
    return out, clusters, leads


def coarse_clusters(collapsed: DataFrame, p: Params) -> DataFrame:
    """Collapsed signatures (sample, chrom, op, ref_start, length, support, and for breakends chrom2, pos2) with ``island`` and ``cluster``.

    at_start, at_length and at_op say where the cluster stands in the end, lead which signature began it.

    A cluster stands at a member's start and takes what is at most ``near`` away, so it can't span
    a gap of more: islands of starts are clustered apart. Islands that begin in one tile of a
    chromosome share a call, so calls are few and a hot chromosome is many of them. An island is in
    one call however long it is: signatures without a gap along a whole chromosome are one.
    """
    spread = islands(collapsed, ["sample", "chrom"], "ref_start", p.near, "island").withColumn("_tile", F.floor(F.col("island") / TILE))
    mated = {"chrom2", "pos2"} <= set(collapsed.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("island", kind="stable").reset_index(drop=True)
        columns = [pdf[c].tolist() for c in ("ref_start", "length", "op", "support")]
        mates = [(c, int(x)) if c is not None and x == x else None for c, x in zip(pdf["chrom2"], pdf["pos2"], strict=True)] if mated else [None] * len(pdf)
        island, out, lo = pdf["island"].tolist(), [], 0
        while lo < len(island):
            hi = bisect_left(island, island[lo] + 1, lo)
            of, made, leads = _grouped(*[c[lo:hi] for c in columns], p.size_ratio, p.near, mates[lo:hi])
            out += [(g, made[g].start, made[g].length, made[g].op, k in leads) for k, g in enumerate(of)]
            lo = hi
        return pdf.assign(**dict(zip(("cluster", "at_start", "at_length", "at_op", "lead"), zip(*out, strict=True), strict=True)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    return spread.groupBy("sample", "chrom", "_tile").applyInPandas(run, kinds + ", cluster int, at_start long, at_length long, at_op string, lead boolean").drop("_tile")


def upper_median(column: str):
    """The element at n div 2 of the sorted values."""
    s = F.sort_array(F.collect_list(column))
    return F.element_at(s, (F.size(s) / 2).cast("int") + 1)


def centroids(sig: DataFrame, keys: list[str]) -> DataFrame:
    """Upper medians of start and length, and distinct reads. Values are counted before they meet, as in ``voted``."""
    support = sig.groupBy(*keys).agg(F.countDistinct("read_id").cast("long").alias("support"))
    return _median(sig, keys, "ref_start", "start").join(_median(sig, keys, "length", "length"), keys).join(support, keys)


def _median(sig: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    n = sig.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    g = n.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.array_sort(F.collect_list(F.struct(F.col(column).alias("v"), F.col("_n").alias("n")))).alias("_values"))
    return g.select(*keys, _middle(F.col("_values"), F.col("_all")).cast("long").alias(out))


def _middle(values, total):
    """The value at place total div 2 of sorted values with counts."""
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
    half = F.floor(total / 2)
    walk = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["n"] > half), x["v"]).otherwise(a["v"]).alias("v"))
    return F.aggregate(values, zero, walk, lambda a: a["v"])


def voted(sig: DataFrame, keys: list[str], column: str, out: str, p: Params) -> DataFrame:
    """The commonest value if it has ``vote`` votes or more (ties to the least), else the upper median.

    Values are counted before they meet, so what a key gathers is its distinct values with counts.
    """
    n = sig.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    all_ = F.array_sort(F.collect_list(F.struct(F.col(column).alias("v"), F.col("_n").alias("n"))))
    top = F.max_by(column, F.struct(F.col("_n"), -F.col(column)))
    g = n.groupBy(*keys).agg(top.alias("_top"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"), all_.alias("_values"))
    median = _middle(F.col("_values"), F.col("_all"))
    return g.select(*keys, F.when(F.col("_most") >= p.vote, F.col("_top")).otherwise(median).cast("long").alias(out))


def consensus(sig: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """start, length, end and support of each cluster: every supporting read votes."""
    support = sig.groupBy(*keys).agg(F.countDistinct("read_id").cast("long").alias("support"))
    out = voted(sig, keys, "ref_start", "start", p).join(voted(sig, keys, "length", "length", p), keys).join(support, keys)
    wide = F.col("op").isin("D", "V") if "op" in keys else F.lit(True)
    return out.withColumn("end", F.when(wide, F.col("start") + F.col("length")).otherwise(F.col("start")))


def passing(calls: DataFrame, p: Params) -> DataFrame:
    """Target calls need the size window and the least support; base calls may be shorter and have one read."""
    target = F.col("length").between(p.min_size, p.max_size) & (F.col("support") >= p.min_support)
    return calls.where(F.when(F.col("sample") == "target", target).otherwise(F.col("length") >= p.min_size - p.short_slack))


def mark_poly(calls: DataFrame, p: Params) -> DataFrame:
    w = Window.partitionBy("sample", "chrom", F.floor(F.col("start") / p.poly_bin))
    return calls.withColumn("filter", F.when(F.count(F.lit(1)).over(w) > 1, "POLY").otherwise("PASS"))


def extended(calls: DataFrame) -> DataFrame:
    """left and right of a window around each call: 0.7 of the length at both sides, further where a second source (src_start, src_end) lies beyond.

    Where one flank is over five times the other, the shorter one grows by a fifth of that ratio, rounded, times its length.
    """
    start, end = F.col("start"), F.col("end")
    e = F.floor((F.col("length") + 1) * 7 / 10)
    second = {"src_start", "src_end"} <= set(calls.columns)
    left = F.least(start - e, F.coalesce(F.col("src_start"), start)) if second else start - e
    right = F.greatest(end + e, F.coalesce(F.col("src_end"), end)) if second else end + e
    x = calls.withColumns({"left": left, "right": right})
    if not second:
        return x
    grown = lambda other, own: F.when((own > 0) & (other / own > 5), (F.rint(other / own / 5) * own).cast("long")).otherwise(0)
    x = x.withColumn("right", F.col("right") + grown(start - F.col("left"), F.col("right") - end))
    # the right flank's first length decides for the left one, too
    return x.withColumn("left", F.col("left") - grown(right - end, start - F.col("left")))
