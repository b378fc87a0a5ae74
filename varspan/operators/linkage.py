"""Clusters of spans by average linkage, cut at a distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.operators.scan import TILE, merged

#: Fixed values of the method: the mean distance that joins two clusters at most, and the positions that count as 1.
CUT, SCALE = 0.4, 1000
#: Spans whose sums are kept, and distances that are computed at once.
HELD, AT_ONCE = 1024, 1 << 22


def average_linkage(start: np.ndarray, length: np.ndarray, weight: np.ndarray, cut: float = CUT, scale: int = SCALE) -> np.ndarray:
    """Cluster of each span, named by its first member: what average linkage joins at a mean distance of ``cut`` or less.

    Two spans are as far apart as the nearest of their starts, ends and middles, in units of
    ``scale``, and their lengths' difference over the longer one; a span counts ``weight`` times.
    A chain runs from cluster to nearest cluster until two are each other's nearest, and these join.
    What has nothing within ``cut`` can't get it by other joins, as means don't fall below the
    nearer part, so it is done. Ties go to the cluster before in the chain, then to the first.
    Up to HELD spans, sums between clusters are kept and added up as clusters join; of more spans
    nothing is held but themselves, and sums are made anew, AT_ONCE distances at a time.
    """
    n = len(start)
    start, length, weight = start.astype(np.int64), length.astype(np.int64), weight.astype(float)
    end, middle = start + length, (2 * start + length) // 2
    of, mass, live = np.arange(n), weight.copy(), np.ones(n, dtype=bool)
    members = [np.array([k]) for k in range(n)]

    def apart(m) -> np.ndarray:
        """Weighted distances of the members ``m``, in a column, to all spans."""
        place = np.minimum(np.minimum(np.abs(start[m] - start), np.abs(end[m] - end)), np.abs(middle[m] - middle)) / scale
        return weight[m] * weight * (place + np.abs(length[m] - length) / np.maximum(np.maximum(length[m], length), 1))

    sums = apart(np.arange(n)[:, None]) if n <= HELD else None

    def means(top: int) -> np.ndarray:
        if sums is None:
            total, step = np.zeros(n), max(1, AT_ONCE // n)
            for lo in range(0, len(members[top]), step):
                total += apart(members[top][lo : lo + step, None]).sum(axis=0)
            total = np.bincount(of, weights=total, minlength=n)
        else:
            total = sums[top]
        out = np.where(live, total / (mass[top] * mass), np.inf)
        out[top] = np.inf
        return out

    chain, first = [], 0
    while True:
        if not chain:
            while first < n and not live[first]:
                first += 1
            if first == n:
                return of
            chain.append(first)
        top = chain[-1]
        far = means(top)
        near = int(far.argmin())
        if far[near] > cut:
            live[chain.pop()] = False
        elif len(chain) > 1 and far[chain[-2]] <= far[near] + 1e-12:
            a, b = sorted((chain.pop(), chain.pop()))
            members[a] = np.concatenate([members[a], members[b]])
            mass[a] += mass[b]
            of[members[b]], live[b] = a, False
            if sums is not None:
                sums[a] += sums[b]
                sums[:, a] += sums[:, b]
        else:
            chain.append(near)


def linkage_clusters(collapsed: DataFrame, keys: list[str], cut: float = CUT, scale: int = SCALE) -> DataFrame:
    """Rows (``keys``, ref_start, length, support, more) with ``island`` and ``cluster``, by ``average_linkage`` of each key's spans.

    Rows within ``cut`` differ in length by a factor of 1 / (1 - cut) at most, and so by their starts in what
    ``cut`` allows of places and lengths. Stretches of that reach that overlap are an island; rows of two
    islands never join. Islands that begin in one tile of a key share a call; a row is a distinct span, however
    many reads have it, and an island's time grows with the square of its spans and the size of its clusters. Rows with a
    null key, start, length or support are left out; an empty table gives no rows.
    """
    rows = collapsed.dropna(subset=[*keys, "ref_start", "length", "support"])
    # half of it at each side: two rows that link are nearer than either's reach
    reach = F.ceil((cut * scale + F.col("length") * (cut / (1 - cut)) + 1) / 2).cast("long")
    spread = merged(rows.withColumns({"_lo": F.col("ref_start") - reach, "_hi": F.col("ref_start") + reach}), keys, "_lo", "_hi", "island").drop("_lo", "_hi")
    spread = spread.withColumn("_tile", F.floor(F.col("island") / TILE))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["island", "ref_start", "length"], kind="stable").reset_index(drop=True)
        of = np.zeros(len(pdf), dtype=np.int64)
        for rows in pdf.groupby("island").indices.values():
            of[rows] = average_linkage(*(pdf[c].to_numpy()[rows] for c in ("ref_start", "length", "support")), cut, scale)
        return pdf.assign(cluster=of)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    return spread.groupBy(*keys, "_tile").applyInPandas(run, kinds + ", cluster long").drop("_tile")
