"""Mixing sources to target weights by hash thresholds that nested histograms find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspan.llm.common import save

#: A word, for sizes: a run of characters other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that a level of histograms resolves; LEVELS of them resolve it all.
BITS, LEVELS = 12, 4


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column) -> Column:
    """48 bits of md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target. ``sizes`` has source and total, a row for each source; they meet in one task, so sources must be few against rows.

    Sources by code point, null last, get the weights in turn. Targets share the sum of all sizes
    by weight; one above ``most`` times its source's size stops there and the rest is shared again
    by weight, until none is above: sorted by size for weight, the sources that stop come first,
    so two running sums give the level: the first that its own source doesn't exceed, which is the largest.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.select("source", F.col("total").alias("source_size"), w.alias("w"), (F.col("total") * F.lit(float(most))).alias("stop"))
    rise = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), "source")
    before, after = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumns(
        {
            "_all": F.sum("source_size").over(Window.partitionBy()),
            "_stopped": F.coalesce(F.sum("stop").over(before), F.lit(0.0)),
            "_left": F.sum("w").over(after),
        }
    )
    t = t.withColumn("_level", (F.col("_all") - F.col("_stopped")) / F.col("_left"))
    level = F.max(F.when(F.col("_level") * F.col("w") <= F.col("stop"), F.col("_level"))).over(Window.partitionBy())
    return t.withColumn("_l", level).select("source", "source_size", F.coalesce(F.least("stop", F.col("_l") * F.col("w")), F.col("stop")).alias("target"))


def _key(source: str = "source") -> Column:
    """Sources as keys of joins: null is a source of its own."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each source: whole takes of everything, and ``below``: hashes below it are taken once more.

    A level sums sizes by source and the next BITS of the hash, keeps only the boundary bucket,
    in which the budget ends, and refines that one. No row is sorted, and what one level shuffles
    is a histogram of at most 2**BITS rows a source from each task.
    """
    now = targets.select(
        _key().alias("k"),
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long").alias("whole"),
        "source_size",
        "target",
    )
    now = now.select("k", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    now = save(now, "budget")
    done = None
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = sized.join(now.select("k", "prefix"), "k").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = rows.groupBy("k", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("size"))
        w = Window.partitionBy("k").orderBy("b")
        hist = hist.withColumn("upto", F.sum("size").over(w)).join(now.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"))
        hist = hist.where(F.col("upto") > F.col("budget"))
        if level < LEVELS:
            edge = F.min_by(F.struct("b", (F.col("upto") - F.col("size")).alias("used")), F.col("b"))
            cut = hist.groupBy("k").agg(edge.alias("e")).select("k", "e.*")
        else:  # the boundary hash itself goes in if that comes nearer to the budget
            last = F.min_by(F.struct("b", "size", "upto"), F.col("b"))
            cut = hist.groupBy("k").agg(last.alias("e")).select("k", "e.*")
        state = now.join(cut, "k", "left")
        # no boundary: the budget holds all that is left below the prefix
        if level < LEVELS:
            state = state.select("k", "whole", F.coalesce(F.col("budget") - F.col("used"), "budget").alias("budget"), F.col("b").alias("next"), "prefix")
            open_ = save(state, f"level{level}")
            ended = open_.where("next is null").select("k", "whole", F.shiftleft(F.col("prefix") + 1, shift + BITS).alias("below"))
            done = ended if done is None else done.unionByName(ended)
            now = open_.where("next is not null").select("k", "whole", "budget", F.col("next").alias("prefix"))
        else:
            nearer = F.col("upto") - F.col("budget") < F.col("budget") - (F.col("upto") - F.col("size"))
            below = F.when(F.col("b").isNull(), F.shiftleft(F.col("prefix") + 1, BITS)).otherwise(F.col("b") + nearer.cast("long"))
            done = done.unionByName(state.select("k", "whole", below.alias("below")))
    return save(done, "thresholds")


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    A source's target is met by whole takes of all its documents and, for the rest, one more take
    of those whose hash lies below the source's threshold; ``copies`` is at most ``most``. The
    hash is of doc_id alone, so reruns agree, and rows with the same doc_id go together. Null and
    empty texts have size 0; a null source is a source of its own; a null id counts as one id.
    """
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), text_size(F.col("text")).alias("size"))
    sized = save(docs.select("doc_id", "source", "size", _hash(F.col("doc_id")).alias("h"), _key().alias("k")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("total"))
    targets = save(source_targets(totals, weights, most), "targets")
    cut = _thresholds(sized, targets)
    plan = targets.select(_key().alias("k"), "source_size", "target").join(cut, "k", "left")
    plan = save(plan, "plan")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce((F.col("h") < F.col("below")).cast("long"), F.lit(0))
    out = sized.join(plan, "k", "left").withColumn("copies", F.least(copies, F.lit(int(most)).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with their columns.

    The threshold is a function of the hash of doc_id and of the source, so texts are filtered in
    place: only the plan, a row for each source, is joined to them. Empty and null texts have size 0
    and go with their hash; rows that repeat a doc_id go together; a null source is a source of its
    own; an empty table gives no rows. Other columns may have any names.
    """
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), text_size(F.col("text")).alias("size"))
    sized = save(docs.select("source", "size", _hash(F.col("doc_id")).alias("h"), _key().alias("k")), "sized")
    targets = save(source_targets(sized.groupBy("source").agg(F.sum("size").alias("total")), weights, most), "targets")
    cut = _thresholds(sized, targets)
    name = F.col("source").cast("string")
    key = F.struct(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"))
    rows = documents.select(F.struct("*").alias("whole"), _hash(F.col("doc_id")).alias("h"), key.alias("k")).join(cut.select("k", F.col("whole").alias("takes"), "below"), "k")
    copies = F.least(F.col("takes") + (F.col("h") < F.col("below")).cast("long"), F.lit(int(most)).cast("long"))
    kept = rows.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return kept.select("whole.*")


#: The same mix in SQL, by one sorted running sum over (source, hash).
MIX_SQL = """
WITH s AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS stop FROM t),
l AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS stopped,
             sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
v AS (SELECT *, max(CASE WHEN (total - stopped) / rest * w <= stop THEN (total - stopped) / rest END) OVER () AS lv FROM l),
g AS (SELECT source, source_size, CAST(coalesce(least(stop, lv * w), stop) AS DOUBLE) AS target FROM v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
h AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS size FROM s GROUP BY source, h),
c AS (SELECT source, h, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM h),
k AS (SELECT c.source, c.h, upto - size AS before, upto, target - whole * source_size AS budget
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, h, (upto <= budget) OR (before <= budget AND upto - budget < budget - before) AS taken_once FROM k)
SELECT s.doc_id, s.size, b.source_size, b.target, s.size * (b.whole + CAST(e.taken_once AS BIGINT)) AS taken
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source
       JOIN e ON s.source IS NOT DISTINCT FROM e.source AND s.h = e.h
"""
