"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector kept of each group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import bound_batches, save
from varspan.llm.components import connected_components
from varspan.llm.vectors import FIT_ROWS, matrix, sample_rows, spherical_kmeans, unit, usable

#: Rows of a block of a cell, about, and those of them that are compared with the other block at once. A task holds two blocks.
BLOCK, SLICE = 2048, 512
#: Vectors of the largest label for each cell, at least: fewer cells, and most vectors lie near fewer borders.
CELL = 4 * BLOCK


def _dealt(centres: np.ndarray, cosine: float):
    """Home cells, and the smaller cells whose vectors can lie within the angle of ``cosine``.

    For unit x at home in c and y at home in d, y lies beyond the plane that halves c and d, so
    x.(c-d)/|c-d| is at most the sine of their angle. Each pair meets in the smaller of its two
    home cells, hence once.
    """
    reach = math.sqrt(max(0.0, 1 - cosine * cosine)) + 1e-9 if cosine > 0 else 2.0
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) * reach + 1e-9

    def deal(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(matrix(pdf["v"]))
            near = x @ centres.T
            home = near.argmax(axis=1)
            goes = near[np.arange(len(x)), home][:, None] - near <= gap[home]
            goes &= np.arange(len(centres))[None, :] < home[:, None]
            row, cell = np.nonzero(goes)
            row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
            out = pdf.iloc[row][["label", "dim", "rep", "copies", "v"]].reset_index(drop=True)
            out["cell"] = cell
            out["home"] = np.arange(len(row)) < len(x)
            yield out

    return deal


def _blocks(cosine: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks: a row's links by number of vectors, and the root of its group here."""
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x = unit(matrix(pdf["v"]))
        home, block = pdf["home"].to_numpy(), pdf["block"].to_numpy()
        copies, rep = pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        some = []
        for lo in range(0, len(left), SLICE):
            rows = left[lo : lo + SLICE]
            linked = x[rows] @ x[right].T >= cosine
            linked &= home[rows][:, None] | home[right][None, :]
            if i == j:
                linked &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(right))[None, :]
            a, b = np.nonzero(linked)
            some.append((rows[a].astype(np.int32), right[b].astype(np.int32)))
        a, b = (np.concatenate(c) for c in zip(*some, strict=True)) if some else (np.zeros(0, np.int32),) * 2
        links = np.zeros(len(x), dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = rep.copy()
        while len(a):  # smallest id over links, until none changes
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            if (root == before).all():
                break
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    return compare


def embedding_dedup(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``
    (in double precision). Equal vectors are compared once, with their number, so a vector that
    holds a third of all rows costs one row. A vector that is null, zero, empty or not finite, or
    whose label is null, links with nothing and is kept. Vectors of different lengths never link.
    Rows that repeat a vec_id count as vectors of their own; a null vec_id stays null and is kept.
    Other columns are not looked at, and an empty table gives no rows.
    """
    bound_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<float>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    key = F.md5(F.col("v").cast("string"))
    valid = rows.where("ok").select("vec_id", "label", "v", F.size("v").alias("dim"), key.alias("key"))
    each = save(valid.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vectors")
    # a row for each length of vectors
    labels = each.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("k"))
    dims = [(r["dim"], r["n"], r["most"]) for r in labels.groupBy("dim").agg(F.sum("k").alias("n"), F.max("k").alias("most")).collect()]
    found = None
    for dim, n, most in dims:
        own = each.where(F.col("dim") == dim)
        fit = unit(matrix(sample_rows(own, "rep", n, FIT_ROWS).select("v").toPandas()["v"]))
        centres = spherical_kmeans(fit, max(1, min(int(math.sqrt(most) / 3), most // CELL))) if len(fit) else np.eye(1, dim)
        cells = own.mapInPandas(_dealt(centres, cosine), f"label {each.schema['label'].dataType.simpleString()}, dim int, rep long, copies long, v array<float>, cell int, home boolean")
        cells = save(cells, "cells")
        sizes = save(cells.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")),
        )
        dealt = cells.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("p", F.explode(pairs)).select("label", "cell", "rep", "copies", "v", "home", "block", "p.i", "p.j")
        part = dealt.groupBy("label", "cell", "i", "j").applyInPandas(_blocks(cosine), "rep long, links long, root long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = save(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = each.select("label", "dim", "key", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    known = save(known.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    out = valid.select("vec_id", "label", "dim", "key").join(known, ["label", "dim", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
