"""Average linkage and maps of windows against their definitions, and islands of stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varspan.operators import linkage, positions
from varspan.operators.linkage import average_linkage, linkage_clusters
from varspan.operators.scan import merged
from varspan.sources import reference


def distance(a, b):
    place = min(abs(a[0] - b[0]), abs(a[0] + a[1] - b[0] - b[1]), abs((2 * a[0] + a[1]) // 2 - (2 * b[0] + b[1]) // 2)) / 1000
    return place + abs(a[1] - b[1]) / max(a[1], b[1], 1)


def plain(spans, cut):
    """The nearest two clusters join, over all pairs of their members, while they are within ``cut``; every read is a member."""
    groups = [[k] for k in range(len(spans))]
    mean = lambda a, b: sum(spans[i][2] * spans[j][2] * distance(spans[i], spans[j]) for i in a for j in b) / sum(spans[i][2] * spans[j][2] for i in a for j in b)
    while len(groups) > 1:
        d, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def spans_of(rng, n, width, most=2000):
    return [(int(s), int(x), int(w)) for s, x, w in zip(rng.integers(0, width, n), rng.integers(50, most, n), rng.integers(1, 5, n), strict=True)]


@pytest.mark.parametrize("held", [0, 1024])
@pytest.mark.parametrize("seed", range(30))
def test_chains_join_what_the_definition_joins(seed, held, monkeypatch):
    monkeypatch.setattr(linkage, "HELD", held)
    monkeypatch.setattr(linkage, "AT_ONCE", 60)
    rng = np.random.default_rng(seed)
    spans = spans_of(rng, 28, [300, 1500, 6000][seed % 3])
    of = average_linkage(*np.array(spans).T)
    assert {frozenset(np.flatnonzero(of == g)) for g in set(of)} == plain(spans, 0.4)
    assert all(np.flatnonzero(of == g)[0] == g for g in set(of))


def test_weights_are_repeated_spans_and_ties_end():
    rng = np.random.default_rng(5)
    spans = spans_of(rng, 20, 1500)
    flat = np.array([s for s in spans for _ in range(s[2])])
    of, each = average_linkage(*np.array(spans).T), average_linkage(flat[:, 0], flat[:, 1], np.ones(len(flat)))
    at = np.repeat(np.arange(20), [s[2] for s in spans])
    assert {frozenset(at[each == g]) for g in set(each)} == {frozenset(np.flatnonzero(of == g)) for g in set(of)}
    grid = average_linkage(np.arange(300) * 100, np.full(300, 200), np.ones(300))
    assert len(set(grid)) > 30 and (np.bincount(grid) <= 10).all()
    assert (average_linkage(np.zeros(3), np.zeros(3), np.ones(3)) == 0).all() and average_linkage(np.zeros(0), np.zeros(0), np.ones(0)).size == 0


def test_clusters_of_islands(spark):
    rng = np.random.default_rng(9)
    spans = [(s + 900_000, x, w) for s, x, w in dict.fromkeys(spans_of(rng, 60, 200_000, 30_000))]
    rows = [("c", s, x, w, "x") for s, x, w in spans] + [("d", 5, 100, 1, None), ("c", None, 100, 1, "x"), ("c", 5, None, 1, "x"), (None, 5, 100, 2, "x")]
    df = spark.createDataFrame(rows, "chrom string, ref_start long, length long, support long, _n string")
    got: dict = {}
    for r in linkage_clusters(df, ["chrom"]).collect():
        got.setdefault((r.chrom, r.island, r.cluster), set()).add((r.ref_start, r.length, r.support))
    want = {frozenset(spans[k] for k in g) for g in plain(spans, 0.4)}
    assert {frozenset(v) for (c, *_), v in got.items() if c == "c"} == want and len({k[1] for k in got if k[0] == "c"}) > 1
    # a null key, start or length leaves a row out
    assert sum(len(v) for v in got.values()) == len(spans) + 1 and {k[0] for k in got} == {"c", "d"}
    assert linkage_clusters(df.limit(0), ["chrom"]).count() == 0


def test_merged_stretches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(a), int(a + b)) for k, a, b in zip(rng.integers(0, 3, 400), rng.integers(-3000, 40_000, 400), rng.choice([10, 60, 5000], 400, p=[0.6, 0.39, 0.01]), strict=True)]
    want, ends = {}, {}
    for k, a, b in sorted(rows):
        first, end = ends.get(k, (None, None))
        ends[k] = (a, b) if first is None or a > end else (first, max(end, b))
        want[k, a] = ends[k][0]
    df = spark.createDataFrame(rows, "k int, lo long, hi long")
    got = {(r.k, r.lo): r.island for r in merged(df, ["k"], "lo", "hi", "island", tile=1000).collect()}
    assert got == want and merged(df.where(F.lit(False)), ["k"], "lo", "hi", "island").count() == 0


def plain_map(window, parts):
    """{(position, op): (reads, coverage, pct)} by walking every position."""
    lo, hi, base = window
    cover, reads = {}, {}
    for read, op, a, b, coverage, _, s, t in sorted(parts, key=lambda x: x[5]):
        whole = lo <= a and b <= hi
        if base and not whole:
            continue
        cover |= dict.fromkeys(range(max(a, lo), min(b, hi) + 1), coverage)
        if not whole:
            continue
        stretches = [(a, b)]
        if base and s is not None:
            if lo <= s and t <= hi:
                cover |= dict.fromkeys(range(s, t + 1), coverage)
            stretches.append((max(s, lo), min(t, hi)))
        for x, y in stretches:
            for at in range(x, y + 1):
                reads.setdefault((at, op), set()).add(read)
    every: dict = {}
    for (at, _), r in reads.items():
        every[at] = every.get(at, 0) + len(r)
    total = {at: cover.get(at, 1) or every[at] for at in every}
    return {k: (len(r), cover.get(k[0], 1), min(100, round(100 * len(r) / total[k[0]]))) for k, r in reads.items()}


def test_maps_of_windows(spark):
    rng = np.random.default_rng(4)
    windows = {f"w{k}": (100, 100 + 60 * k, k % 2 == 0) for k in range(1, 9)}
    rows = []
    for k in windows:
        for nth in range(0 if k == "w8" else 25):
            a, s = int(rng.integers(90, 300)), int(rng.integers(80, 400))
            op = str(rng.choice(["I", "D", "V"]))
            source = (s, s + int(rng.integers(0, 60))) if op == "I" and nth % 3 else (None, None)
            rows.append((k, f"r{nth % 9}", op, a, a + int(rng.integers(0, 40)), nth % 4, nth, *source))
    kind = "id string, read_id string, op string, lo long, hi long, coverage int, nth int, src_lo long, src_hi long"
    parts = spark.createDataFrame([*rows, rows[0], ("w1", "r", "D", None, 5, 1, 99, None, None), (None, "r", "D", 100, 101, 1, 99, None, None)], kind)
    w = spark.createDataFrame([(k, "x", *v) for k, v in windows.items()], "id string, chrom string, lo long, hi long, base boolean")
    got: dict = {}
    for r in positions.window_maps(w, parts).collect():
        for at in range(r.lo, r.hi + 1):
            assert (r.id, at, r.op) not in got
            got[r.id, at, r.op] = (r.n_reads, r.coverage, r.pct)
    want = {(k, *at): v for k, window in windows.items() for at, v in plain_map(window, [r[1:] for r in rows if r[0] == k]).items()}
    assert got == want and len({k[0] for k in want}) > 5
    assert positions.window_maps(w, parts.limit(0)).count() == 0 and positions.window_maps(w.limit(0), parts).count() == 0
    # a base window without parts has the reference's own bases
    ref = reference.chunks_of(spark.createDataFrame([("x", "AC" * 400)], "chrom string, bases string"), 64)
    maps = positions.base_maps(w.where("base").drop("base"), parts, ref, 64).collect()
    assert {r.id for r in maps if r.op in "AC"} == {"w8"} and sum(r.hi - r.lo + 1 for r in maps if r.id == "w8") == windows["w8"][1] - 99
    assert {(r.id, r.lo, r.op): r.pct for r in maps if r.id != "w8"} == {(r.id, r.lo, r.op): r.pct for r in positions.window_maps(w.where("base"), parts).collect()}
