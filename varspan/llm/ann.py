"""Nearest neighbours: lists of spherical k-means, scanned by dimension blocks with early abandoning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspan.llm.common import bound_batches, save
from varspan.llm.vectors import FIT_ROWS, matrix, sample_rows, spherical_kmeans, unit, usable

#: Candidates of a task, about; larger lists are dealt over several tasks.
CHUNK = 4096
#: Queries of a task, at most about, and those whose first block is scanned at once.
ASKED, AT_ONCE = 4096, 256
#: Columns of a block of the rotated vectors.
STEP = 16
#: Standard deviations that a candidate's estimated distance may lie above the bound's before it is given up.
SIGMAS = 3.0
#: Share of the true neighbours, on the sample, that the probed lists must hold.
AIM = 0.96


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products on the vectors as given; equal vectors get equal scores wherever they stand."""
    return (x * q).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:top]


def _probe(centres, sizes, probes, sample_ids, sample, top):
    """For each query its lists, a bound that its last neighbour can't lie below, and what the sample gives."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = matrix(pdf["v"])
            order = np.argsort(-(unit(q) @ centres.T), axis=1, kind="stable")
            filled = np.cumsum(sizes[order], axis=1)
            rough = q @ sample.T
            out = []
            for k, qid in enumerate(pdf["vec_id"].to_numpy()):
                n = max(probes, int(np.searchsorted(filled[k], 2 * top + 1)) + 1)
                at = np.argpartition(-rough[k], min(2 * top, len(sample) - 1))[: 2 * top + 1] if len(sample) else np.array([], int)
                at = at[sample_ids[at] != qid]
                own = _scores(sample[at], q[k])
                best = _best(sample_ids[at], own, top)
                bound = own[best[-1]] if len(best) == top else -np.inf
                out.append((qid, pdf["v"].iloc[k], order[k, :n].astype(np.int32), bound, sample_ids[at][best], own[best]))
            yield pd.DataFrame(out, columns=["query_id", "q", "lists", "bound", "ids", "scores"])

    return run


def _scan(dim: int, top: int):
    turn = _rotation(dim)

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return none
        ids, x = rows["vec_id"].to_numpy(), matrix(rows["v"])
        qids, qs, bounds = queries["query_id"].to_numpy(), matrix(queries["q"]), queries["bound"].to_numpy()
        edges = list(range(0, dim, STEP)) + [dim]
        xr, qr = x @ turn, qs @ turn
        seen = lambda m: [(m[:, :e] ** 2).sum(axis=1) for e in edges[1:]]
        x_seen, q_seen = seen(xr), seen(qr)
        xx, qq = x_seen[-1], q_seen[-1]
        out = []
        for k, qid in enumerate(qids):
            if k % AT_ONCE == 0:
                first = qr[k : k + AT_ONCE, : edges[1]] @ xr[:, : edges[1]].T
            alive, part, bound = np.arange(len(x)), first[k % AT_ONCE], bounds[k]
            for s in range(1, len(edges)):
                if s > 1:
                    part = part + xr[alive, edges[s - 1] : edges[s]] @ qr[k, edges[s - 1] : edges[s]]
                if s < len(edges) - 1:
                    # a product of the bound or more is a squared distance of the limit or less, and of a
                    # difference that is turned at random, d columns hold the share d / dim, give or take
                    d = edges[s]
                    limit = xx[alive] + qq[k] - 2 * bound
                    near = limit * (1 + SIGMAS * math.sqrt(2 * (dim - d) / (d * (dim + 2)))) + 1e-9 * (xx[alive] + qq[k])
                    keep = (x_seen[s - 1][alive] + q_seen[s - 1][k] - 2 * part) * (dim / d) <= near
                else:
                    keep = part >= bound - 1e-9 * max(1.0, abs(bound)) if np.isfinite(bound) else np.ones(len(part), bool)
                alive, part = alive[keep], part[keep]
                if not len(alive):
                    break
            alive = alive[ids[alive] != qid]
            if len(alive):
                own = _scores(x[alive], qs[k])
                best = _best(ids[alive], own, top)
                out.append((np.full(len(best), qid), ids[alive][best], own[best]))
        if not out:
            return none
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)), strict=True)))

    return run


def _assign(centres):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=(unit(matrix(pdf["v"])) @ centres.T).argmax(axis=1).astype(np.int32))

    return run


def nearest(embeddings: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows of largest inner product for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the
    query's own. The lists are fitted on about FIT_ROWS rows, and their number to probe is the
    least that holds AIM of the true neighbours there; all rows are indexed. Ties go to the
    smaller vec_id; rows that repeat a vec_id count once. Vectors that are null, empty, zero or
    not finite take no part, nor do vectors of a length other than the commonest, or rows whose vec_id
    is null. Other columns are not looked at, and an empty table gives no rows.
    """
    bound_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim, n = dims["dim"], dims["n"]
    rows = rows.where(F.size("v") == dim)
    some = sample_rows(rows, "vec_id", n, FIT_ROWS).toPandas().drop_duplicates("vec_id").sort_values("vec_id")
    sample_ids, sample = some["vec_id"].to_numpy(), matrix(some["v"]).reshape(len(some), dim)
    k = int(math.sqrt(n) / 4) if n > CHUNK and len(sample) > 4 * top else 1
    centres = spherical_kmeans(unit(sample), k) if k > 1 else np.eye(1, dim)
    probes = _probes(centres, sample, top)

    lists = save(rows.mapInPandas(_assign(centres), "vec_id long, v array<double>, list int"), "lists")
    sizes = np.zeros(len(centres), dtype=np.int64)
    for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a list
        sizes[r["list"]] = r["n"]
    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).dropDuplicates(["vec_id"])
    asked = asked.mapInPandas(
        _probe(centres, sizes, probes, sample_ids, sample, top),
        "query_id long, q array<double>, lists array<int>, bound double, ids array<long>, scores array<double>",
    )
    asked = save(asked, "asked")
    # a row a list: FIT_ROWS at most. A list's rows are dealt to chunks, its queries to parts, and each chunk is copied once for each part
    ask = asked.select("query_id", "q", "bound", F.explode("lists").alias("list"))
    plan = ask.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ASKED)).cast("int").alias("parts"))
    of_list = embeddings.sparkSession.createDataFrame([(i, int(max(1, -(-n // CHUNK)))) for i, n in enumerate(sizes.tolist())], "list int, chunks int")
    plan = F.broadcast(save(plan.join(of_list, "list"), "plan"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = ask.join(plan, "list").withColumn("part", deal("query_id", "parts")).withColumn("chunk", each("chunks")).drop("parts", "chunks")
    held = lists.join(plan, "list").withColumn("chunk", deal("vec_id", "chunks")).withColumn("part", each("parts")).drop("parts", "chunks")
    found = ask.groupBy("list", "chunk", "part").cogroup(held.groupBy("list", "chunk", "part")).applyInPandas(_scan(dim, top), "query_id long, vec_id long, score double")
    seen = asked.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).select("query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score"))
    both = found.unionByName(seen).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _probes(centres: np.ndarray, sample: np.ndarray, top: int, queries: int = 128) -> int:
    """Lists to probe so that AIM of the sample's true neighbours lie in them."""
    if len(centres) == 1 or len(sample) <= top + 1:
        return len(centres)
    cell = (unit(sample) @ centres.T).argmax(axis=1)
    ask = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    near = sample[ask] @ sample.T
    near[np.arange(len(ask)), ask] = -np.inf
    true = np.argpartition(-near, top, axis=1)[:, :top]
    place = np.argsort(np.argsort(-(unit(sample[ask]) @ centres.T), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(place, cell[true], axis=1).ravel())
    return int(depth[min(len(depth) - 1, math.ceil(AIM * len(depth)) - 1)]) + 1
