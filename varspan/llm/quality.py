"""Quality: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import bound_batches, held_out, save, unused

#: Random features, their seed, the ridge, bins of raw scores for the calibration, and the folds of 5 that only calibrate.
FEATURES, SEED, RIDGE, BINS, CALIBRATE = 256, 17, 1e-2, 512, (4,)
#: Groups that the tasks' parts of the normal equations are summed in first.
PARTS = 64


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all of them JVM expressions. A null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    words = count(r"\S+")
    share = lambda c: c / F.greatest(n, F.lit(1))
    per_word = lambda c: c / F.greatest(words, F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    split = F.filter(F.split(F.lower(t), " "), lambda x: x != "")
    return {
        "log_chars": F.log1p(n),
        "word_chars": n / F.greatest(words, F.lit(1)),
        "upper": share(count(r"\p{Lu}")),
        "digits": share(count("[0-9]")),
        "symbols": share(count(r"[^\p{L}\p{N}\s.,]")),
        "symbol_ends": per_word(count(r"[^\p{L}\p{N}\s.,](?=\s|$)")),
        "sentence_ends": per_word(count(r"[.!?](?=\s|$)")),
        "line_breaks": per_word(count("\n")),
        "new_words": F.size(F.array_distinct(split)) / F.greatest(F.size(split), F.lit(1)),
        "new_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


@dataclass(frozen=True)
class Fourier:
    """Standardised statistics x to ridge score beta.sqrt(2/m)cos(Wx+b), then to a calibrated probability."""

    names: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: pd.DataFrame) -> np.ndarray:
        x = np.clip((stats[list(self.names)].to_numpy(float) - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: pd.DataFrame) -> np.ndarray:
        return self.features(stats) @ self.beta

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.values)


def _isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order; knots are the mean places of the pooled bins."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([s / c for s, _, c in blocks]), np.array([h / c for _, h, c in blocks])


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and its statistics, written once: fitting and scoring both read this narrow table."""
    stats = statistics(F.col("text").cast("string"))
    return save(documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("double").alias(k) for k, c in stats.items()]), "stats")


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = 1.0) -> Fourier | None:
    """Fit on every labelled row that is not held out; None without both labels.

    The rows of the folds CALIBRATE (crc32 of the id, mod 5) set the calibration and the others the
    ridge, so it is calibrated on rows that it hasn't seen (on all, if those have one label only).
    Each task adds up its rows' part of the normal equations, and the parts are summed by row of
    the matrix on the executors, in two levels: the driver gets one matrix of features + 1, however
    many rows. Labels that repeat a doc_id count once, the largest; null labels and ids don't count.
    """
    names = tuple(c for c in stats.columns if c != "doc_id")
    y = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("y"))
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).isin(*CALIBRATE)
    every = save(stats.join(y, "doc_id").select("y", *names, fold.alias("late")), "labelled")
    either = every.groupBy("late").agg(F.count_distinct("y").alias("n")).where("n > 1").count()
    rows, late = (every.where("not late"), every.where("late")) if either == 2 else (every, every)
    of = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), *[F.mean(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    if not of["n"] or of["p"] in (0, of["n"]):
        return None
    rng = np.random.default_rng(SEED)
    scale = np.array([of[f"s_{c}"] for c in names])
    model = Fourier(
        names, np.array([of[f"m_{c}"] for c in names]), np.where(scale > 1e-9, scale, 1.0),
        rng.standard_normal((len(names), features)) * width / np.sqrt(len(names)), rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.zeros(1), np.zeros(1),
    )

    def parts(batches):
        total = np.zeros((features + 1, features + 2))
        for pdf in batches:
            if len(pdf):
                z = model.features(pdf)
                total += z.T @ np.hstack([z, pdf["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": np.arange(len(total)), "part": TaskContext.get().partitionId() % PARTS, "v": list(total)})

    def add(pdf):
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(pdf["v"].tolist(), axis=0)]})

    summed = rows.mapInPandas(parts, "i int, part int, v array<double>").groupBy("i", "part").applyInPandas(add, "i int, v array<double>")
    summed = summed.groupBy("i").applyInPandas(add, "i int, v array<double>").collect()
    a = np.array([r["v"] for r in sorted(summed, key=lambda r: r["i"])])
    penalty = RIDGE * of["n"] / features * np.eye(features + 1)
    penalty[-1, -1] = 0
    beta = np.linalg.solve(a[:, :-1] + penalty, a[:, -1])
    model = Fourier(*[getattr(model, k) for k in ("names", "mean", "scale", "w", "b")], beta, model.knots, model.values)

    def binned(batches):
        hits = np.zeros((BINS, 3))
        for pdf in batches:
            if len(pdf):
                raw = np.clip(model.raw(pdf), -0.5, 1.5)
                at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
                np.add.at(hits, at, np.column_stack([raw, pdf["y"].to_numpy(), np.ones(len(raw))]))
        some = np.flatnonzero(hits[:, 2])
        yield pd.DataFrame({"bin": some, "x": hits[some, 0], "y": hits[some, 1], "n": hits[some, 2]})

    bins = late.mapInPandas(binned, "bin int, x double, y double, n double").groupBy("bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas().sort_values("bin")
    knots, values = _isotonic((bins["x"] / bins["n"]).to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy())
    return Fourier(*[getattr(model, k) for k in ("names", "mean", "scale", "w", "b", "beta")], knots, values)


def score(stats: DataFrame, model: Fourier | None) -> DataFrame:
    """doc_id, score: the calibrated probability of quality 1. Without a model every score is 1, so nothing is rejected."""
    if model is None:
        return stats.select("doc_id", F.lit(1.0).alias("score"))
    bound_batches(stats.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": model.probability(model.raw(pdf)) if len(pdf) else np.zeros(0)})

    return stats.mapInPandas(run, "doc_id long, score double")


def accepted(documents: DataFrame, model: Fourier | None, least: float) -> DataFrame:
    """The documents that score ``least`` or more, with their columns: statistics and score join the text in one pass, no shuffle.

    A null text is scored as an empty one; rows that repeat are judged each; an empty table stays
    empty. Other columns may have any names.
    """
    if model is None:
        return documents
    bound_batches(documents.sparkSession)
    stats = statistics(F.col("text").cast("string"))
    columns, kinds, names = documents.columns, list(stats), unused(documents, *stats)
    wide = documents.select("*", *[c.cast("double").alias(n) for n, c in zip(names, stats.values(), strict=True)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = pd.DataFrame({k: batch.column(len(columns) + i).to_numpy(zero_copy_only=False) for i, k in enumerate(kinds)})
            keep = model.probability(model.raw(table)) >= least if len(table) else np.zeros(0, bool)
            yield batch.select(list(range(len(columns)))).filter(pa.array(keep, pa.bool_()))

    return wide.mapInArrow(run, documents.schema)
