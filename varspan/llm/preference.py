"""Preference formatting: the longest common turn prefix as prompt, and paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a large group of conversations with one opening is dealt over.
SALTS = 256


def conversations_as_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: [turn, role, text] in order of turn, then role, then text. Null roles and texts count as empty."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))


def pair_by_opening(convs: DataFrame, salts: int = SALTS) -> DataFrame:
    """chosen_id, rejected_id: conversations with the same first turn in pairs, by conv_id; an odd one out has a null rejected_id.

    Pairs form within salts of conv_id first, so an opening that a third of all conversations
    share is dealt over many tasks; what is left there, one a salt at most, is paired then.
    """
    first = F.element_at("turns", 1)
    ids = convs.select("conv_id", F.md5(F.concat_ws("\x01", first["role"], first["text"])).alias("k"), F.pmod("conv_id", F.lit(salts)).alias("s"))

    def paired(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("conv_id")
        return rows.withColumns({"_n": F.row_number().over(w), "_with": F.lead("conv_id").over(w)}).where("_n % 2 = 1")

    near = paired(ids, "k", "s")
    rest = paired(near.where("_with is null").select("conv_id", "k"), "k")
    return (
        near.where("_with is not null").select("conv_id", "_with").unionByName(rest.select("conv_id", "_with")).toDF("chosen_id", "rejected_id")
    )


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """[start, end) in code points of the rendered turns: what assistant turns say, with their end marks."""
    head = lambda t: F.length(t["role"]) + 5
    whole = lambda t: head(t) + F.length(t["text"]) + 8
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, t):
        end = acc["at"] + whole(t)
        own = F.array(F.struct((acc["at"] + head(t)).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def format_preferences(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The prompt is the longest run of first turns whose role and text agree in both conversations,
    rendered once; a completion is what follows, with the spans that a loss counts. Equal
    conversations have empty completions. Without a rejected side the prompt ends before the last
    assistant turn (all turns, if there is none), and ``rejected`` and its mask are null.
    """
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.join(left, "chosen_id").join(right, "rejected_id", "left")
    shared = F.least(F.size("a"), F.size("b"))
    same = lambda i: (F.col("a")[i]["role"] == F.col("b")[i]["role"]) & (F.col("a")[i]["text"] == F.col("b")[i]["text"])
    differ = F.array_min(F.filter(F.sequence(F.lit(0), shared - 1), lambda i: ~same(i)))
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.col("a")[i]["role"] == "assistant"))
    both = both.withColumn("prompt_turns", F.when(F.col("b").isNull(), F.coalesce(last, F.size("a"))).otherwise(F.coalesce(differ, shared)))
    after = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    none = F.col("b").isNull()
    return both.select(
        "chosen_id", "rejected_id", "prompt_turns",
        _render(F.slice("a", 1, F.col("prompt_turns"))).alias("prompt"),
        _render(after("a")).alias("chosen"),
        F.when(~none, _render(after("b"))).alias("rejected"),
        _mask(after("a")).alias("chosen_mask"),
        F.when(~none, _mask(after("b"))).alias("rejected_mask"),
    )


#: The same rows in SQL; masks as text.
PREFERENCE_SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, turns[1] AS k, ((conv_id % 256) + 256) % 256 AS s FROM c),
n AS (SELECT *, row_number() OVER w AS n, lead(conv_id) OVER w AS mate FROM k WINDOW w AS (PARTITION BY k, s ORDER BY conv_id)),
m AS (SELECT *, row_number() OVER w AS n2, lead(conv_id) OVER w AS mate2 FROM n WHERE n % 2 = 1 AND mate IS NULL WINDOW w AS (PARTITION BY k ORDER BY conv_id)),
p AS (SELECT conv_id AS chosen_id, mate AS rejected_id FROM n WHERE n % 2 = 1 AND mate IS NOT NULL
      UNION ALL SELECT conv_id, mate2 FROM m WHERE n2 % 2 = 1),
j AS (SELECT chosen_id, rejected_id, a.turns AS a, b.turns AS b FROM p JOIN c a ON a.conv_id = chosen_id LEFT JOIN c b ON b.conv_id = rejected_id),
l AS (SELECT *, CAST(CASE WHEN b IS NULL THEN coalesce(list_max(list_filter(range(len(a)), lambda i: a[i + 1].role = 'assistant')), len(a))
       ELSE coalesce(list_min(list_filter(range(least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])), least(len(a), len(b))) END AS INT) AS prompt_turns FROM j),
x AS (SELECT *, a[prompt_turns + 1:] AS ra, b[prompt_turns + 1:] AS rb FROM l)
SELECT chosen_id, rejected_id, prompt_turns,
  list_aggregate(list_concat([''], list_transform(a[1:prompt_turns], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10))), 'string_agg', '') AS prompt,
  list_aggregate(list_concat([''], list_transform(ra, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10))), 'string_agg', '') AS chosen,
  CASE WHEN b IS NOT NULL THEN list_aggregate(list_concat([''], list_transform(rb, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10))), 'string_agg', '') END AS rejected,
  array_to_string(list_transform(list_filter(range(len(ra)), lambda i: ra[i + 1].role = 'assistant'),
    lambda i: CAST(coalesce(list_sum(list_transform(ra[1:i], lambda t: len(t.role) + len(t.text) + 13)), 0) + len(ra[i + 1].role) + 5 AS INT) || '-' ||
         CAST(list_sum(list_transform(ra[1:i + 1], lambda t: len(t.role) + len(t.text) + 13)) AS INT)), ',') AS chosen_mask,
  CASE WHEN b IS NOT NULL THEN array_to_string(list_transform(list_filter(range(len(rb)), lambda i: rb[i + 1].role = 'assistant'),
    lambda i: CAST(coalesce(list_sum(list_transform(rb[1:i], lambda t: len(t.role) + len(t.text) + 13)), 0) + len(rb[i + 1].role) + 5 AS INT) || '-' ||
         CAST(list_sum(list_transform(rb[1:i + 1], lambda t: len(t.role) + len(t.text) + 13)) AS INT)), ',') END AS rejected_mask
FROM x
"""
