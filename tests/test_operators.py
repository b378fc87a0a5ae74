"""Boundary rows of the domain operators, and two-level scans against plain ones."""

import random

from pyspark.sql import functions as F

from varspan.functions import calls as C
from varspan.functions import cigar
from varspan.operators import cluster, depth
from varspan.operators.ranges import overlap_join
from varspan.operators.scan import islands, running_sum
from varspan.params import PRESETS


def test_import_without_llm():
    import __spark_entry__ as e

    assert {k for k in e.oracle_sql()} <= set(e.queries())


def test_cigar(spark):
    df = spark.createDataFrame([("5S10M2I3D4=6H", 100), ("7S", 1), ("10M3N5M", 1)], "c string, s long")
    t = cigar.without_clips(cigar.tokens(F.col("c")))
    got = df.select(F.size(t), cigar.ref_span(t), cigar.read_span(t), cigar.events(t, F.col("s"))).collect()
    assert [tuple(r[:3]) for r in got] == [(4, 17, 16), (1, 0, 0), (3, 15, 18)]
    assert [tuple(e) for e in got[0][3]] == [("I", 2, 109, 109, 10), ("D", 3, 110, 112, 12)]


def test_vaf_genotype_inheritance(spark):
    rows = [(19, 100), (20, 100), (79, 100), (80, 100), (5, 0), (7, 5), (1, 40)]
    df = spark.createDataFrame(rows, "s long, d long").withColumn("v", C.vaf(F.col("s"), F.col("d")))
    got = df.select("v", C.genotype(F.col("v"))).collect()
    assert [r[0] for r in got] == [min(1.0, round(s / d, 2)) if d else 1.0 for s, d in rows]
    assert [r[1] for r in got] == ["0/0", "0/1", "0/1", "1/1", "1/1", "1/1", "0/0"]
    df = spark.createDataFrame([(0.3, 0.0), (0.8, 0.5), (0.5, 0.4), (0.01, 0.0)], "t double, b double")
    pick = lambda s: [r[0] for r in df.select(C.inheritance(F.col("t"), F.col("b"), 0.04, s)).collect()]
    assert pick(False) == ["NewCOMP", "NewALLELE", "NewALLELE", "NewCOMP"]
    assert pick(True)[3] == "Germline"


def test_overlap_class(spark):
    rows = [(100, 200, 100, 200), (50, 250, 100, 200), (49, 250, 100, 200), (1, 150, 100, 260), (1, 50, 100, 200)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = [r[0] for r in df.select(C.overlap_class(*map(F.col, "abcd"))).collect()]
    assert got == ["non_overlap", "a_in_b", "b_in_a", "a_before_b", "non_overlap"]


def test_two_level_scans(spark):
    rng = random.Random(1)
    rows = [("k" if rng.random() < 0.8 else "m", p, rng.randint(-3, 3)) for p in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.k, r.p): r.s for r in running_sum(df, ["k"], "p", "v", "s", tile=70).collect()}
    first = {(r.k, r.p): r.i for r in islands(df, ["k"], "p", 12, "i", tile=70).collect()}
    total, last, island = {}, {}, {}
    for k, p, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        assert got[k, p] == total[k]
        if k not in last or p - last[k] > 12:
            island[k] = p
        last[k] = p
        assert first[k, p] == island[k]


def test_overlap_join_and_depth(spark):
    rng = random.Random(2)
    span = lambda n: [(rng.choice("xy"), i, a := rng.randint(0, 900), a + rng.randint(0, 120)) for i in range(n)]
    a, b = span(80), span(80)
    left, right = spark.createDataFrame(a, "k string, i long, lo long, hi long"), spark.createDataFrame(b, "k string, j long, lo2 long, hi2 long")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ["k"], 37).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    spans = spark.createDataFrame([("s", k, i % 30, lo, hi) for k, i, lo, hi in a], "sample string, chrom string, read_id long, lo long, hi long")
    want = {}
    for k, i, lo, hi in a:
        for p in range(lo, hi + 1):
            want.setdefault((k, p), set()).add(i % 30)
    found = {(r.chrom, p): r.depth for r in depth.segments(spans).collect() for p in range(r.lo, r.hi + 1)}
    assert found == {k: len(v) for k, v in want.items()}


def test_greedy_boundaries_and_islands(spark):
    g = lambda *x: cluster.greedy([s for s, _, _, _ in x], [n for _, n, _, _ in x], [o for _, _, o, _ in x], [k for *_, k in x], 0.8, 1000)
    assert g((0, 100, "D", 9), (1000, 100, "D", 1)) == [0, 0] and g((0, 100, "D", 9), (1001, 100, "D", 1)) == [0, 1]
    assert g((0, 100, "D", 9), (0, 80, "D", 1)) == [0, 0] and g((0, 100, "D", 9), (0, 79, "D", 1)) == [0, 1]
    assert g((0, 100, "D", 9), (0, 100, "I", 1)) == [0, 1]
    rng = random.Random(3)
    rows = [("s", "c", rng.choice("ID"), p, rng.randint(50, 90), rng.randint(1, 9)) for p in rng.sample(range(0, 200_000, 7), 120)]
    df = spark.createDataFrame(rows, "sample string, chrom string, op string, ref_start long, length long, support long")
    got = {}
    for r in cluster.coarse_clusters(df, PRESETS["hifi"]).collect():
        got.setdefault((r.island, r.cluster), set()).add(r.ref_start)
    whole = {}
    for r, c in zip(rows, cluster.greedy([r[3] for r in rows], [r[4] for r in rows], [r[2] for r in rows], [r[5] for r in rows], 0.8, 1000), strict=True):
        whole.setdefault(c, set()).add(r[3])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, whole.values()))
