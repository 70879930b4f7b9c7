"""The training-data operators as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm import (
    op1_pii, op2_bpe, op3_warc, op4_lines, op5_quality, op6_html, op7_minhash, op8_mixing, op9_toxicity,
    op10_fingerprint, op11_urls, op12_clusters, op13_trie,
)
from carepath.llm.common import table
from carepath.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    """The vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.report(table(spark, sf_dir, "documents"))


@query
def op2_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_bpe.digests(op2_bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path()))


@query
def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = op3_warc.archive(table(spark, sf_dir, "pages"))
    return op3_warc.read_archives(spark, manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_html.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing.select(op8_mixing.with_domain(table(spark, sf_dir, "documents")), op8_mixing.PRODUCTION)


@query
def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lines.line_report(table(spark, sf_dir, "documents"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_urls.judge(table(spark, sf_dir, "pages"), op11_urls.rule_table(spark))


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_clusters.clusters(table(spark, sf_dir, "embeddings")).drop("n_computed")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_trie.trie(table(spark, sf_dir, "conversations"))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
