"""Clustering by the op rule and over long chains, real read names, filters of alignments, tags of split reads, comparison, records."""

import random

from pyspark.sql import functions as F

from varspan.functions import calls as C
from varspan.jobs.detect import call_reads, split_read_events
from varspan.operators import cluster, compare, depth, reads, signatures
from varspan.params import PRESETS
from varspan.sources import alignments, vcf

P = PRESETS["hifi"]
ALIGN = "aln_id string, read_id string, chrom string, ref_start long, ref_end long, read_start long, read_end long, strand string, is_primary boolean, read_length long"


def plain_greedy(rows, ratio=0.8, near=1000):
    """The clustering by its definition: every cluster is looked at, medians are taken anew."""
    groups, out = [], {}
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][3], rows[k][0], rows[k][2], rows[k][1], rows[k][4] or ("", 0)))
    for k in order:
        start, length, op, _, mate = rows[k]
        best = (-1.0, None)
        for g, members in enumerate(groups):
            half = len(members) // 2
            s, n, o = sorted(rows[m][0] for m in members)[half], sorted(rows[m][1] for m in members)[half], rows[members[half]][2]
            first = rows[members[0]]
            if {o, op} == {"I", "D"} or abs(s - start) > near or (n != length and min(n, length) / max(n, length) < ratio):
                continue
            like = min(n, length) / max(n, length)
            if op == "B":
                if first[2] != "B" or not (mate[0] == first[4][0] and mate[1] - first[4][1] <= near):
                    continue
                like = 1.0
            if like > best[0]:
                best = (like, g)
        if best[1] is None:
            groups.append([k])
        else:
            groups[best[1]].append(k)
    for g, members in enumerate(groups):
        for m in members:
            out[m] = g
    return [out[k] for k in range(len(rows))]


def test_greedy_equals_its_definition():
    rng = random.Random(1)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(1, 60)):
            op = rng.choice(["I", "D", "V", "I+V", "B"])
            rows.append((rng.randint(0, 9000), rng.randint(50, 120), op, rng.randint(1, 4), (rng.choice("xy"), rng.randint(0, 5000)) if op == "B" else None))
        got = cluster.greedy([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], 0.8, 1000, [r[4] for r in rows])
        assert got == plain_greedy(rows)


def test_ops_and_mates_of_a_cluster():
    g = lambda *x: cluster.greedy([r[0] for r in x], [r[1] for r in x], [r[2] for r in x], [9 - k for k in range(len(x))], 0.8, 1000, [r[3] if len(r) > 3 else None for r in x])
    assert g((0, 100, "D"), (5, 100, "V")) == [0, 0] and g((0, 100, "I"), (5, 100, "I+V")) == [0, 0] and g((0, 100, "I"), (5, 100, "D")) == [0, 1]
    assert g((0, 50, "B", ("y", 9000)), (5, 50, "B", ("y", 10_000))) == [0, 0] and g((0, 50, "B", ("y", 9000)), (5, 50, "B", ("y", 10_001))) == [0, 1]
    assert g((0, 50, "B", ("y", 9000)), (5, 50, "B", ("y", 1))) == [0, 0] and g((0, 50, "B", ("y", 9000)), (5, 50, "B", ("z", 9000))) == [0, 1]
    assert g((0, 50, "D"), (5, 50, "B", ("y", 1))) == [0, 1] and g((0, 50, "B", ("y", 1)), (5, 50, "D")) == [0, 0]


def test_a_long_chain_is_one_island(spark):
    n = 30_000
    starts = [7 * k for k in range(n)]
    got = cluster.greedy(starts, [100] * n, ["D"] * n, [1] * n, 0.8, 1000)
    assert len(set(got)) < n // 50
    df = spark.createDataFrame([("s", "c", "D", s, 100, 1) for s in starts[:3000]], "sample string, chrom string, op string, ref_start long, length long, support long")
    out = cluster.coarse_clusters(df, P).collect()
    assert {r.island for r in out} == {0} and len({r.cluster for r in out}) == len(set(cluster.greedy(starts[:3000], [100] * 3000, ["D"] * 3000, [1] * 3000, 0.8, 1000)))
    assert cluster.coarse_clusters(df.limit(0), P).count() == 0


def test_read_names_are_kept(spark):
    rows = [("a", "m64/1/ccs", "x", 1000, 2000, 0, 1000, "+", True, 3200), ("b", "m64/1/ccs", "x", 2001, 2100, 1001, 1100, "-", False, 3200), ("c", "m64/1/ccs", "x", 2101, 4200, 1101, 3200, "+", False, 3200)]
    df = spark.createDataFrame(rows, ALIGN)
    assert {r.read_id for r in reads.resolve_on_reference(df).collect()} == {"m64/1/ccs"}
    assert [(r.read_id, r.op, r.ref_start) for r in split_read_events(df, P).collect()] == [("m64/1/ccs", "V", 2001)]


def test_merge_nearby(spark):
    e = [("a", "D", 100, 160, 60), ("a", "D", 200, 300, 100), ("a", "D", 400, 450, 50), ("a", "D", 1451, 1500, 49), ("b", "I", 10, 10, 70), ("b", "I", 900, 900, 90), ("b", "V", 950, 990, 40), ("b", "V", 995, 999, 4), ("c", "D", 1, 51, 50), ("c", "I", 60, 60, 50)]
    df = spark.createDataFrame([(i, "x", op, s, t, n) for i, op, s, t, n in e], "aln_id string, chrom string, op string, ref_start long, ref_end long, length long")
    got = sorted((r.aln_id, r.op, r.ref_start, r.ref_end, r.length, r.n_merged) for r in signatures.merge_nearby(df, 1000).collect())
    assert got == [("a", "D", 140, 350, 210, 3), ("a", "D", 1451, 1500, 49, 1), ("b", "I", 10, 10, 160, 2), ("b", "V", 950, 990, 40, 1), ("b", "V", 995, 999, 4, 1), ("c", "D", 1, 51, 50, 1), ("c", "I", 60, 60, 50, 1)]


def test_filters_of_alignments_and_depth(spark):
    rows = [("target", 0, "x", 20, "100M"), ("target", 0, "x", 19, "100M"), ("base", 0, "x", 0, "100M"), ("target", 256, "x", 60, "100M"), ("base", 256, "x", 60, "100M"), ("base", 4, "x", 60, "100M"), ("target", 2064, "x", 60, None), ("target", 0, "y", 60, "100M"), ("target", 0, "x", 60, "1X1I1D1X99M")]
    df = spark.createDataFrame([(*r, 1, 100) for r in rows], "sample string, flag int, chrom string, mapq int, cigar string, ref_start long, ref_end long")
    access = spark.createDataFrame([("x", 0, 10), ("x", 10, 20)], "chrom string, start long, end long")
    kept = lambda m: sorted((r.sample, r.flag, r.cigar) for r in signatures.usable_alignments(df, access, P, m).collect())
    good = [("base", 0, "100M"), ("base", 256, "100M"), ("target", 0, "100M")]
    assert kept(True) == good and kept(False) == sorted([*good, ("target", 0, "1X1I1D1X99M")])
    segs = depth.segments(spark.createDataFrame([("t", "x", r, 100, 200) for r in range(5)], "sample string, chrom string, read_id long, lo long, hi long"))
    s = spark.createDataFrame([("t", "x", 50, 99), ("t", "x", 50, 100), ("t", "x", 200, 400), ("t", "x", 201, 400), ("t", "x", 50, 300)], "sample string, chrom string, ref_start long, ref_end long")
    assert sorted((r.ref_start, r.ref_end) for r in signatures.without_deep(s, segs, 4).collect()) == [(50, 99), (50, 300), (201, 400)]


def test_split_alignments(spark):
    sa = "x,500,-,30S20M10D50M,60,0;y,900,+,10M90S,19,0;x,1,+,5M;z,7,+,50S50M,60,0;"
    rows = [("target", "r/1", 16, "x", 100, "20S70M10S", sa), ("base", "r/2", 0, "x", 100, "100M", sa), ("target", "r/1", 2064, "x", 500, "30H70M", None)]
    df = spark.createDataFrame(rows, "sample string, read_id string, flag int, chrom string, ref_start long, cigar string, sa string")
    access = spark.createDataFrame([("x",), ("y",)], "chrom string")
    got = sorted((r.read_id, r.chrom, r.ref_start, r.ref_end, r.read_start, r.read_end, r.strand, r.is_primary, r.read_length) for r in alignments.split_alignments(df, access, P).collect())
    assert got == [
        ("r/1", "x", 100, 169, 21, 90, "+", True, 100), ("r/1", "x", 500, 579, 31, 100, "+", False, 100),
        ("r/2", "x", 100, 199, 1, 100, "+", True, 100), ("r/2", "x", 500, 579, 1, 70, "-", False, 100), ("r/2", "y", 900, 909, 1, 10, "+", False, 100),
    ]


def test_compare_calls(spark):
    t = spark.createDataFrame([(1, 0.5, "0/1"), (2, 0.1, "0/0"), (3, 0.9, "1/1")], "id long, vaf double, gt string")
    b = spark.createDataFrame([(1, "f", 0.45, 5, 4), (3, "f", 0.3, 7, 3), (3, "m", 0.0, 9, 0)], "id long, base string, vaf double, dr long, dv long")
    run = lambda somatic: {(r.id, r.base): (r.label, r.gt, r.dr, r.dv) for r in compare.compare_calls(t, b, ["f", "m"], P, somatic).collect()}
    same = {(1, "f"): ("Germline", "0/1", "5", "4"), (1, "m"): ("NewCOMP", "0/0", "NA", "NA"), (3, "f"): ("NewALLELE", "0/1", "7", "3"), (3, "m"): ("NewCOMP", "0/0", "9", "0")}
    assert run(False) == same | {(2, b): ("NewCOMP", "0/0", "NA", "NA") for b in "fm"}
    assert run(True) == same | {(2, b): ("Germline", "0/0", "NA", "NA") for b in "fm"}
    assert compare.compare_calls(t, b, [], P, False).count() == 0


def test_vcf_round_trip(spark, tmp_path):
    rows = [("x", 200, 260, 60, "DEL", 7, 0.5, "DEL", "PASS", "0/1", 7, "b"), ("x", 100, 150, 50, "INV", 5, 1.0, "INV", "POLY", "1/1", 0, "a"), ("y", 5, 5, 80, "INS", 9, 0.2, "INS", "PASS", "0/1", 30, "c")]
    calls = spark.createDataFrame(rows, "chrom string, start long, end long, length long, type string, support long, vaf double, bkps string, filter string, gt string, dr long, id string")
    vcf.write_vcf(calls, str(tmp_path / "v"), ["s1"], [("x", 1000), ("y", 500)])
    lines = [line for f in sorted((tmp_path / "v").glob("part-*")) for line in f.read_text().splitlines()]
    top = vcf.header(["s1"], [("x", 1000), ("y", 500)])
    assert lines[: len(top)] == top and [line.split("\t")[2] for line in lines[len(top) :]] == ["a", "b", "c"]
    got = {r.id: (r.chrom, r.start, r.end, r.length, r.type, r.support, r.vaf, r.bkps, r.filter, r.samples[0].gt, r.samples[0].dr, r.samples[0].dv) for r in vcf.read_vcf(spark, str(tmp_path / "v")).collect()}
    assert got == {r[-1]: (*r[:9], r[9], str(r[10]), str(r[5])) for r in rows}
    ends = spark.createDataFrame([("]x:12]N",), ("[chrUn_1:7[N",), ("N",), (None,)], "a string").select(C.parsed_breakend(F.col("a")).alias("e")).select("e.*").collect()
    assert [tuple(e) for e in ends] == [("x", 12, "-"), ("chrUn_1", 7, "+"), ("", None, "+"), (None, None, "+")]


def test_extended(spark):
    rows = [(1000, 1100, 99, None, None), (1000, 1100, 99, 500, 1050), (1000, 1100, 99, 900, 3000)]
    df = spark.createDataFrame(rows, "start long, end long, length long, src_start long, src_end long")
    got = [(r.left, r.right) for r in cluster.extended(df).collect()]
    assert got == [(930, 1170), (500, 1170 + 70), (900 - 400, 3000)] and [(r.left, r.right) for r in cluster.extended(df.drop("src_start", "src_end")).collect()] == [(930, 1170)] * 3


def test_call_reads(spark):
    """An inverted middle and a deletion, in a child and one parent: types, places, support, depth and genotypes; an absent call in the other parent."""
    access = spark.createDataFrame([("x",)], "chrom string")
    inv = "x,5001,-,500S300M500S,60,0;x,5301,+,800S500M,60,0;"
    rows = [(s, f"{s}{k}", 0, "x", 4501, 5000, 60, "500M800S", inv) for s, n in (("target", 6), ("father", 6)) for k in range(n)]
    rows += [("target", f"d{k}", 0, "x", 20_001, 20_000 + 1100, 60, "500M100D500M", None) for k in range(7)]
    rows += [("target", f"r{k}", 0, "x", 20_001, 21_100, 60, "1100M", None) for k in range(7)] + [("mother", "m", 0, "x", 4501, 5800, 60, "1300M", None)]
    df = spark.createDataFrame(rows, "sample string, read_id string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, sa string")
    got = sorted((r.sample, r.op, r.start, r.end, r.length, r.support, r.depth, r.gt, r.filter) for r in call_reads(df, access, P).collect())
    assert got == [
        ("father", "V", 5001, 5301, 300, 6, 6, "1/1", "PASS"), ("target", "D", 20_501, 20_601, 100, 7, 14, "0/1", "PASS"), ("target", "V", 5001, 5301, 300, 6, 6, "1/1", "PASS"),
    ]
