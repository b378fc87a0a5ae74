"""Hard negatives: exact integer products of anchors with all rows, several rows in each wide integer."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspan.llm.common import save
from varspan.llm.vectors import commonest_length, finite, matrix

#: A component c becomes the integer floor(SCALE * c).
SCALE = 256
#: Rows and anchors of a task, about; anchors that are multiplied at once.
CHUNK, ASKED, AT_ONCE = 8192, 2048, 64
WORD = 64


class Packed:
    """Rows of integers as columns of fields in 64-bit words, for products with anchors whose size is at most ``reach`` each.

    Components are biased by the least of them, so no field is negative. A product's field holds the
    score, its bias and a constant; the arithmetic is modulo the word, and the last step has every
    field between 0 and 2 * reach, so what a field lent another on the way is back.
    """

    def __init__(self, rows: np.ndarray, reach: int):
        self.n, dim = rows.shape
        self.reach, self.bits = reach, (2 * reach + 1).bit_length()
        self.fields = max(1, WORD // self.bits)
        self.width = -(-self.n // self.fields)
        self.bias = -min(0, int(rows.min(initial=0)))
        biased = np.full((self.fields * self.width, dim), self.bias, dtype=np.uint64)
        biased[: self.n] += rows.astype(np.uint64)
        self.ones = sum(1 << self.bits * f for f in range(self.fields)) % (1 << WORD)
        self.words = np.zeros((dim, self.width), dtype=np.uint64)
        for f in range(self.fields):
            self.words += biased[f * self.width : (f + 1) * self.width].T << np.uint64(self.bits * f)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors (rows) with all rows (columns): one multiplication of words for each component of an anchor."""
        signed = anchors.astype(np.int64)
        total = np.zeros((len(anchors), self.width), dtype=np.uint64)
        for k in range(anchors.shape[1]):
            total += signed[:, k, None].view(np.uint64) * self.words[k]
        shift = [((self.reach - self.bias * int(s)) * self.ones) % (1 << WORD) for s in signed.sum(axis=1)]
        total += np.array(shift, dtype=np.uint64)[:, None]
        mask = np.uint64((1 << self.bits) - 1 if self.bits < WORD else (1 << WORD) - 1)
        parts = [((total >> np.uint64(self.bits * f)) & mask).astype(np.int64) - self.reach for f in range(self.fields)]
        return np.concatenate(parts, axis=1)[:, : self.n]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """No product of a row of each is larger in size."""
    most = lambda x: int((x * x).sum(axis=1).max(initial=0))
    return math.isqrt(most(a) * most(b)) + 1


def _met(anchors: pd.DataFrame, rows: pd.DataFrame):
    """Each anchor's place with its scores of all rows."""
    a, x = matrix(anchors["q"]).astype(np.int64), matrix(rows["v"]).astype(np.int64)
    packed = Packed(x, _reach(a, x))
    for lo in range(0, len(a), AT_ONCE):
        for k, scores in enumerate(packed.scores(a[lo : lo + AT_ONCE])):
            yield lo + k, scores


def _first(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """The first of the places ``at``: highest score, then smallest id. What can't be among them isn't sorted."""
    if len(at) > 4 * top:
        at = at[scores[at] >= np.partition(scores[at], len(at) - top)[len(at) - top]]
    return at[np.lexsort((ids[at], -scores[at]))][:top]


def _frame(rows: list[tuple], kinds: dict[str, str]) -> pd.DataFrame:
    cells = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pd.DataFrame({c: np.concatenate(x) if rows else pd.Series(dtype=k) for (c, k), x in zip(kinds.items(), cells, strict=True)})


def _positives(top: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            own, ids = anchors["anchor_id"].to_numpy(), rows["vec_id"].to_numpy()
            for k, scores in _met(anchors, rows):
                best = _first(np.flatnonzero(ids != own[k]), scores, ids, top)
                out.append((np.full(len(best), own[k]), ids[best], scores[best]))
        return _frame(out, {"anchor_id": "int64", "positive_id": "int64", "positive_score": "int64"})

    return run


def _negatives(top: int, least: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            own, labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
            found = [[(int(k), int(s)) for k, s in zip(*x, strict=True)] for x in zip(anchors["places"], anchors["found"], strict=True)]
            ids, theirs = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for k, scores in _met(anchors, rows):
                # -(-a // 100) is a / 100, rounded up
                lowest, highest = min(-(-least * s // 100) for _, s in found[k]), max(s for _, s in found[k])
                fits = np.flatnonzero((scores >= lowest) & (scores <= highest) & (theirs != labels[k]) & (ids != own[k]))
                for place, s in found[k]:
                    best = _first(fits[(scores[fits] <= s) & (scores[fits] >= -(-least * s // 100))], scores, ids, top)
                    out.append((np.full(len(best), own[k]), np.full(len(best), place, dtype=np.int32), ids[best], scores[best]))
        return _frame(out, {"anchor_id": "int64", "k": "int32", "negative_id": "int64", "negative_score": "int64"})

    return run


def labelled_integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: valid rows with integer components, the label of every seventh vec_id moved on by one.

    Components are held within what keeps every product of two rows in a long: for 64 of them
    floor(256 * c) within 2 ** 28, which no embedding nears.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    dim = commonest_length(rows)
    most = min(math.isqrt((1 << 61) // max(1, dim or 1)), (1 << 31) - 1)
    code = lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x * SCALE))).cast("int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.size("v") == (dim or 0)).select("vec_id", label.alias("label"), F.transform("v", code).alias("v"))


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are the other
    rows of its label with the highest integer inner products, ``positives`` of them at most. For each,
    the rows of other labels with the highest scores from ``least`` hundredths of the positive's up
    to the positive's are its negatives, ranked from 1. Ties go to the smaller vec_id.

    Anchors, 1 in ``every`` rows, meet all rows in blocks, first those of their label, then all; each
    block gives an anchor's first few, and those meet by anchor. Rows with a null vec_id, label or
    vector, an empty one, a null or non-finite component, or a length other than the commonest take
    no part. A row that repeats a vec_id is a row of its own, but never its own anchor's positive or
    negative; of anchors of one vec_id the one with the least label and components asks. Positives
    with a score below 0 have no negatives, those of a score of 0 have such of a score of 0. Other
    columns are not looked at; an empty table gives no rows.
    """
    rows = save(labelled_integers(embeddings), "integers")
    ask = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", F.col("v").alias("q"))).alias("a"))
    ask = save(ask.select("anchor_id", "a.label", "a.q"), "anchors")
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    sizes = rows.groupBy("label").agg(blocks(F.count(F.lit(1)), CHUNK).alias("chunks"))
    plan = save(ask.groupBy("label").agg(blocks(F.count(F.lit(1)), ASKED).alias("parts")).join(sizes, "label"), "plan")
    own = ask.join(plan, "label").select("anchor_id", "label", "q", deal("anchor_id", F.col("parts")).alias("part"), each(F.col("chunks")).alias("chunk"))
    held = rows.join(plan, "label").select("vec_id", "label", "v", deal("vec_id", F.col("chunks")).alias("chunk"), each(F.col("parts")).alias("part"))
    keys = ("label", "part", "chunk")
    near = own.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= positives)
    near = save(near, "positives")

    n, anchors = rows.count(), ask.count()
    chunks, parts = F.lit(max(1, -(-n // CHUNK))), F.lit(max(1, -(-anchors // ASKED)))
    found = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("k", "positive_score")).alias("f"))
    asked = ask.join(found, "anchor_id").select("anchor_id", "label", "q", F.col("f.k").alias("places"), F.col("f.positive_score").alias("found"), deal("anchor_id", parts).alias("part"), each(chunks).alias("chunk"))
    every_row = rows.select("vec_id", "label", "v", deal("vec_id", chunks).alias("chunk"), each(parts).alias("part"))
    keys = ("part", "chunk")
    far = asked.groupBy(*keys).cogroup(every_row.groupBy(*keys)).applyInPandas(_negatives(negatives, least), "anchor_id long, k int, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_id", "k").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return far.join(near, ["anchor_id", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Products of integers below 2 ** 53 are exact in doubles.
NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.k ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM r WHERE rank <= 5
"""
