"""Valid vectors, spherical k-means cells and helpers of both vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, about, on which cells are fitted; the cells only deal vectors out, every vector is assigned.
FIT_ROWS = 8192


def usable(v: Column) -> Column:
    """True for a vector that is not null or empty, has only finite components, and is not zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def finite(v: Column) -> Column:
    """True for a vector that is not null or empty and has only finite components."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def commonest_length(rows: DataFrame) -> int | None:
    """The length that most vectors ``v`` have, of equally common ones the shortest; None without rows."""
    top = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    return None if top is None else top["dim"]


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as doubles."""
    return np.array(column.tolist(), dtype=np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is divided out first, so nothing overflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample_rows(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """About ``rows`` of n rows, dealt by a hash of the key: the same ones in every run."""
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows: fitted on a bounded sample; an empty cell takes the worst-served row."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = x @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        lost = np.flatnonzero(size < 1e-9)
        sums[lost] = x[np.argsort(near.max(axis=1))[: len(lost)]]
        centres = unit(sums)
    return centres
