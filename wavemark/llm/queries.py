"""Queries and oracle SQL of the corpus operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import embeddings, extraction, jaccard, language, licences, mixing, neighbours, packing, quality, search, token_output, whitening
from .common import table


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_tokens(token_output.write_tokens(table(spark, sf_dir, "documents"), vocabulary_file(), end_id=1))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file(), capacity=2048, end_id=0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), words=5, percent=80)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 50 = 0"), k=10)


#: Target shares of the tokens by domain.
MIX_TARGETS = {"clean": 0.93, "poor": 0.05, "toxic": 0.02}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and domain of the labelled documents: poor quality first, then toxic, else clean."""
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), MIX_TARGETS)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_topk_search": op6_topk_search,
    "op7_source_mixing": op7_source_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_nearest_neighbours": op12_nearest_neighbours,
}
ORACLE_SQL: dict[str, str] = {"op8_license_scan": licences.oracle_sql()}
