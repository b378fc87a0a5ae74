"""The registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varspan.llm import ann, embed_dedup, hard_negatives, mixing, near_dup, packing, preference, quality, secrets, toxicity, url_filter, warc, whitening
from varspan.llm.common import held_out, new_path, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(table(spark, sf_dir, "documents"))
    scored = quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preference.conversations_as_turns(table(spark, sf_dir, "conversations"))
    out = preference.format_preferences(convs, preference.pair_by_opening(convs))
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")).alias(c)
    return out.select("chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", text("chosen_mask"), text("rejected_mask"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return packing.pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened_components(table(spark, sf_dir, "embeddings"), 32)
    # the exact value where a long can't hold it is the operator's own column
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_embedding_near_dedup, op2_mix_sources, op3_nearest_neighbours, op4_toxicity, op5_quality_classifier,
        op6_secret_scan, op7_preference_format, op8_minhash_near_dedup, op9_warc, op10_packing, op11_whitening,
        op12_hard_negatives, op13_url_filter, pipeline,
    )
    return {f.__name__: f for f in own}


#: Vectors compare in double precision; a vector with a null, no or an infinite component, or of length 0, links with nothing.
EMBED_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e
      WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
o AS (SELECT * FROM g WHERE n > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT c.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN k ON c.vec_id = k.vec_id
"""

SECRET_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, text, k.kind, k.ord, k.re, 0 AS skipped, text AS rest, CAST(NULL AS VARCHAR) AS m, CAST(NULL AS BIGINT) AS pos FROM d,
    (VALUES ('assign', 1, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+'),
            ('access', 2, 'AKIA[A-Z0-9]+'), ('hex', 3, '[0-9a-f]{24,}'), ('key', 4, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('chat', 5, 'xox[abprs]-[A-Za-z0-9-]+')) k(kind, ord, re)
  UNION ALL
  SELECT doc_id, text, kind, ord, re, skipped + instr(rest, f) - 1 + length(f), substr(rest, instr(rest, f) + length(f)), f, skipped + instr(rest, f) - 1
  FROM (SELECT *, regexp_extract(rest, re) AS f FROM s) WHERE f <> ''),
h AS (SELECT doc_id, kind, ord, pos, length(m) AS n,
             CASE WHEN kind = 'assign' THEN length(regexp_extract(m, '^[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?(.*)$', 1)) >= 6 WHEN kind = 'access' THEN length(m) >= 20 WHEN kind = 'hex' THEN length(m) >= 24 ELSE true END AS ok
      FROM s WHERE m IS NOT NULL),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, ord) FILTER (ord <= 3) AS base,
             string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, ord) AS spans FROM h WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM s)
SELECT page_id, n AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": EMBED_SQL,
        "op2_mix_sources": mixing.MIX_SQL,
        "op6_secret_scan": SECRET_SQL,
        "op7_preference_format": preference.PREFERENCE_SQL,
        "op9_warc": WARC_SQL,
        "op12_hard_negatives": hard_negatives.NEGATIVES_SQL,
        "op13_url_filter": url_filter.URL_SQL,
    }
