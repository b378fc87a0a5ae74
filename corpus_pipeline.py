"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varspan.llm import mixing, near_dup, packing, quality, secrets
from varspan.llm.common import save, table

#: Documents whose probability of quality 1 is below this are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with their columns. It learns from the labels that are not held out.

    Statistics are computed once to learn from, as a narrow table, and again in the pass that scores
    and filters: to compute them for labelled documents only, or to join scores to texts, would move
    all texts between machines (462 MB for 0.51 GB of documents). Null and empty texts are scored as empty ones; repeated rows are judged
    each; without labels of both kinds nothing is rejected; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(quality.document_statistics(docs), labels)
    return quality.accepted(docs, model, LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id. Rows of one doc_id are judged by their own texts.

    Rows equal in doc_id and text become one; empty and null texts and null ids stay; columns may have any names.
    """
    return near_dup.dedup_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars set anew. Null texts stay null; an empty table stays empty."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, empty and null texts go with their hash."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences; null and empty texts have the end's token, null ids stay null."""
    import public_tokenizers as public

    return packing.pack(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and sketches have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs

