"""Depth is swept in tiles: spans are exchanged once, and what tiles cut is whole again."""

import random
from collections import Counter

from varspan.operators import depth
from varspan.operators.scan import islands

SPANS = "sample string, chrom string, read_id long, lo long, hi long"


def swept(rows):
    """Maximal runs of equal depth above 0, position by position."""
    seen = {(s, c, r, p) for s, c, r, lo, hi in rows for p in range(lo, hi + 1)}
    at, out = Counter((s, c, p) for s, c, _, p in seen), []
    for s, c, p in sorted(at):
        if out and out[-1][:2] == (s, c) and out[-1][3] == p - 1 and out[-1][4] == at[s, c, p]:
            out[-1] = (*out[-1][:3], p, at[s, c, p])
        else:
            out.append((s, c, p, p, at[s, c, p]))
    return out


def test_segments_over_tiles(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        lo = rng.randrange(-300, 3000)
        rows.append((rng.choice("ab"), rng.choice("xyz"), rng.randrange(60), lo, lo + rng.choice((-1, 0, 3, 49, 50, 400))))
    # one that fills tiles alone, two that touch at a tile's end, and a change at a tile's end
    rows += [("c", "x", 1, 10, 760), ("c", "y", 1, 20, 99), ("c", "y", 1, 100, 130), ("c", "z", 1, 0, 99), ("c", "z", 2, 50, 99), ("c", "z", 3, 100, 200)]
    df = spark.createDataFrame(rows, SPANS)
    for tile in (50, 1_000_000):
        got = depth.segments(df, tile=tile)
        assert sorted(tuple(r) for r in got.collect()) == swept(rows)


def test_segments_exchange_spans_once(spark):
    df = spark.createDataFrame([("a", "x", r, r * 10, r * 10 + 500) for r in range(50)], SPANS)
    plan = depth.segments(df)._jdf.queryExecution().executedPlan().toString()
    # what is left to do reads the written runs: those at ends of tiles meet once
    assert plan.count("Exchange hashpartitioning") == 1


def test_islands_over_tiles(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(-500, 4000)) for k in "ab" for _ in range(160)] + [("c", p) for p in range(0, 900, 12)] + [("d", 5)]
    want = {}
    for k, p in sorted(set(rows)):
        before = max((q for j, q in rows if j == k and q < p), default=None)
        want[k, p] = want[k, before] if before is not None and p - before <= 12 else p
    df = spark.createDataFrame(rows, "k string, p long")
    for tile in (7, 70, 1_000_000):
        got = islands(df, ["k"], "p", 12, "i", tile=tile).collect()
        assert len(got) == len(rows) and {(r.k, r.p): r.i for r in got} == want
    plan = islands(df, ["k"], "p", 12, "i")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
