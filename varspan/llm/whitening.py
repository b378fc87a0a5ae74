"""Embedding whitening: exact squares of every dimension and pair sum, covariances by polarisation, axes of unit variance."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import save
from varspan.llm.vectors import commonest_length, finite

#: A component c becomes the integer floor(SCALE * c) + SHIFT; those beyond LIMIT count as LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 60
#: Rows that are squared at once.
ROWS = 1024
#: Axes with less than this share of the largest variance hold rounding alone; nothing is projected on them.
LEAST = 1e-10

_EXACT = pa.schema([("k", pa.int32()), ("hi", pa.decimal128(38, 0)), ("lo", pa.decimal128(38, 0))])


@dataclass(frozen=True)
class Whitening:
    """What a fit found: n rows with sums S, x's covariance, and its axes (columns) by falling variance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    variances: np.ndarray
    axes: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.variances / np.trace(self.covariance)


def _valid(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(finite(F.col("v")))


def _codes(batch: pa.RecordBatch, dim: int):
    """floor(SCALE * c) of a batch's vectors, some rows at a time."""
    v = batch.column(batch.schema.get_field_index("v"))
    for lo in range(0, len(v), ROWS):
        x = v.slice(lo, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        yield lo, np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _added(x: np.ndarray, bound: int) -> np.ndarray:
    """Column sums as Python integers; ``bound`` is the largest size of an entry."""
    return (x.sum(axis=0) if bound * max(1, len(x)) < 1 << 62 else x.astype(object).sum(axis=0)).astype(object)


def _squared(z: np.ndarray) -> np.ndarray:
    """Sums of z_i ** 2 and (z_i + z_j) ** 2, in the order of _pairs."""
    most = 2 * int(np.abs(z).max(initial=0))
    small, out = most * most * max(1, len(z)) < 1 << 62, []
    for i in range(z.shape[1]):
        u = z[:, i:] + z[:, i : i + 1]
        u[:, 0] = z[:, i]
        out.append(np.einsum("ij,ij->j", u, u) if small else (u.astype(object) ** 2).sum(axis=0))
    return np.concatenate(out).astype(object)


def _pairs(dim: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dim) for j in range(i, dim)]


def _exact_sums(rows: DataFrame, dim: int, measure) -> dict[int, int]:
    """Exact sums over all rows of what ``measure`` gives for some of them, and the number of rows at -1.

    A task sends one row for each sum. Its two halves, of 64 bits and above, are added as decimals,
    so no sum overflows.
    """

    def run(batches):
        n, total = 0, 0
        for batch in batches:
            for _, x in _codes(batch, dim):
                n, total = n + len(x), total + measure(x)
        if n:
            found = [n, *total]
            cell = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(found) - 1), pa.int32()), cell(v >> 64 for v in found), cell(v & (1 << 64) - 1 for v in found)], schema=_EXACT)

    part = rows.select("v").mapInArrow(run, "k int, hi decimal(38,0), lo decimal(38,0)")
    # a row for each sum: as many as pairs of dimensions
    return {r["k"]: (int(r["hi"]) << 64) + int(r["lo"]) for r in part.groupBy("k").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}


def fit(embeddings: DataFrame) -> Whitening | None:
    """Mean and covariance of all valid rows' integers, exactly; None if no row is valid.

    Values are centred on the whole part of their mean, T / n less than all of it. Squares of each
    dimension and of each sum of two are added as integers, from which T ** 2 / n comes off; a
    covariance is half of what the sum's variance has over its two dimensions' variances.
    """
    rows = _valid(embeddings)
    dim = commonest_length(rows)
    if dim is None:
        return None
    rows = rows.where(F.size("v") == dim)
    first = _exact_sums(rows, dim, lambda x: _added(x, int(np.abs(x).max(initial=0))))
    n = first[-1]
    centre = [first[i] // n for i in range(dim)]
    rest = [first[i] - n * c for i, c in enumerate(centre)]
    near = np.array(centre, dtype=np.int64)
    found = _exact_sums(rows, dim, lambda x: _squared(x - near))
    # n * n times the variance of a dimension, or of the sum of two
    spread = {p: n * found[k] - (rest[p[0]] if p[0] == p[1] else rest[p[0]] + rest[p[1]]) ** 2 for k, p in enumerate(_pairs(dim))}
    cov = np.empty((dim, dim))
    for i, j in spread:
        cov[i, j] = cov[j, i] = spread[i, i] / n**2 if i == j else (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n**2)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    some = (e > 0) & (e > LEAST * e[0])
    return Whitening(n, [first[i] + n * SHIFT for i in range(dim)], cov, e[some], axes[:, some])


def whiten(embeddings: DataFrame, model: Whitening, components: int) -> DataFrame:
    """vec_id, deviation, whitened: each valid row's exact squared distance from the mean, times n * n, and its place on the first axes.

    A deviation of over 38 digits is null. Rows of another length than the model's have no row.
    """
    dim, n = model.dim, model.n
    centre = [s // n - SHIFT for s in model.sums]
    rest = [s - n * (s // n) for s in model.sums]
    near, off = np.array(centre, dtype=np.int64), np.array(rest, dtype=object)
    part = np.array([r / n for r in rest])
    turn = model.axes[:, :components] / np.sqrt(model.variances[:components])
    width = turn.shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for lo, x in _codes(batch, dim):
                z = x - near
                bound = n * (int(np.abs(z).max(initial=0)) + 1)
                y = n * (z if bound * bound * dim < 1 << 62 else z.astype(object)) - (off.astype(np.int64) if bound * bound * dim < 1 << 62 else off)
                far = [Decimal(int(d)) if d < 10**38 else None for d in (y * y).sum(axis=1)]
                w = ((z - part) @ turn).ravel()
                ends = pa.array(np.arange(len(x) + 1) * width, pa.int32())
                ids = batch.column(batch.schema.get_field_index("vec_id")).slice(lo, len(x))
                yield pa.RecordBatch.from_arrays([ids, pa.array(far, pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(w))], schema=schema)

    rows = _valid(embeddings).where(F.size("v") == dim)
    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, width: int, measure) -> np.ndarray:
    def run(batches):
        total = None
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                got = measure(_matrix(batch.slice(lo, ROWS), width))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "s"])

    found = {r["k"]: r["s"] for r in rows.select("whitened").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return np.array([found[k] for k in range(len(found))])


def identity_error(whitened: DataFrame, width: int, n: int) -> float:
    """The largest entry, in size, of the covariance of ``whitened`` minus the identity; values are centred before they are multiplied."""
    mean = _sums(whitened, width, lambda w: w.sum(axis=0)) / n
    cov = _sums(whitened, width, lambda w: ((w - mean).T @ (w - mean)).ravel()) / n
    return float(np.abs(cov.reshape(width, width) - np.eye(width)).max())


def whitened_components(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each valid vector and component.

    Valid are vectors that are not null or empty, have only finite components, and are of the
    commonest length (of equally common ones, the shorter); a zero vector is as valid as any, and
    rows that repeat a vec_id, or have a null one, have rows of their own. Axes that hold no variance
    (fewer rows than dimensions, or constant ones) have no row, so equal vectors alone, or one row,
    give none, as an empty table does. Other columns are not looked at.
    """
    model = fit(embeddings)
    width = 0 if model is None else min(components, len(model.variances))
    if not width:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = save(whiten(embeddings, model, width), "whitened")
    error = identity_error(rows, width, model.n)
    share = F.array(*[F.lit(float(x)) for x in model.explained[:width]])
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
