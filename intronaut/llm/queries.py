"""One query per operation over its whole table, as ``op<N>_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intronaut.llm import sql
from intronaut.llm.decontaminate import contaminated_words
from intronaut.llm.embedding_dedup import similar_vectors
from intronaut.llm.hard_negatives import hard_negatives
from intronaut.llm.importance import resample
from intronaut.llm.language_id import identify
from intronaut.llm.licenses import demonstration_paths, scan_licenses
from intronaut.llm.mixing import mix_sources
from intronaut.llm.near_dedup import near_duplicates
from intronaut.llm.secret_scan import CLASSES, PATTERNS, listed, scan_secrets
from intronaut.llm.substring_dedup import remove_repeats
from intronaut.llm.toxicity import toxic_documents
from intronaut.llm.url_filter import demonstration_entries, filter_urls
from intronaut.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` within a label at cosine 0.93."""
    return similar_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of ``documents`` laid out as a file tree, own or inherited from the nearest directory."""
    return scan_licenses(demonstration_paths(_table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows of ``documents``: what each document loses and the digest of what stays."""
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of ``documents``, learned from ``labels`` outside the held-out fold."""
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, threshold=0.5)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` on 4-word shingles at Jaccard 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources of ``documents`` takes from each document."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC records and read back through the index."""
    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learned outside the held-out fold."""
    return identify(_table(spark, sf_dir, "documents"), folds=3, held=1)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside 13-word windows of ``benchmark`` items."""
    found = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages``, a day of 2024 each, against a dated list over their hosts."""
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched_at"))
    return filter_urls(captures, demonstration_entries(pages))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents``, likelier the more they resemble ``benchmark`` in single words."""
    found = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), max_words=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in ``documents`` by pattern and by entropy."""
    found, kinds = scan_secrets(_table(spark, sf_dir, "documents")), [*(p.kind for p in PATTERNS), *(c.kind for c in CLASSES)]
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base, counts = F.filter("spans", lambda s: s["kind"] < len(PATTERNS)), [F.size(of(k)).cast("long").alias(f"n_{p.kind}") for k, p in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed(base, kinds), 256).alias("base_sha256"), listed(F.col("spans"), kinds).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth of ``embeddings``, a seventh of which change their label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_license_scan, op3_substring_dedup, op4_toxicity, op5_minhash_dedup, op6_mixing, op7_warc, op8_language_id, op9_decontamination, op10_url_filter, op11_importance, op12_secrets, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": sql.OP1, "op3_substring_dedup": sql.OP3, "op5_minhash_dedup": sql.OP5, "op6_mixing": sql.OP6, "op7_warc": sql.OP7, "op9_decontamination": sql.OP9, "op10_url_filter": sql.OP10, "op11_importance": sql.OP11, "op12_secrets": sql.OP12, "op13_hard_negatives": sql.OP13}
