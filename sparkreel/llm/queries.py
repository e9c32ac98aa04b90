"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkreel.llm import centroids, decontam, divergence, html_text, jaccard, langid, lm, packing, pii, search, secrets, tokens, urls
from sparkreel.llm import pipeline as corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the personal data in them."""
    return pii.report(pii.personal_data(_table(spark, sf_dir, "documents")))


def op6_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sizes in bytes and tokens."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), corpus.TOKENIZER())


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that benchmark windows cover."""
    return decontam.report(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op1_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's five best inner products over the whole table."""
    return search.top_k(_table(spark, sf_dir, "embeddings"), 50, 5)


def op3_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with host, path, fitting rule and verdict of their URL."""
    return urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op4_count_vector_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the component that links of 4-word shingles at 0.85 put them in."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the language their words carry."""
    return langid.predict(_table(spark, sf_dir, "documents"))


def op2_text_density_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their main text."""
    return html_text.page_texts(_table(spark, sf_dir, "pages"))


def op8_variable_capacity_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' pieces with their bins, lengths in tokens and an end token."""
    return packing.pack_texts(_table(spark, sf_dir, "documents"), corpus.TOKENIZER())


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their log10 probabilities under unigrams and under the mixture."""
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op11_gemm_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their clusters after three exact rounds."""
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op12_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the secrets in them."""
    return secrets.report(secrets.secrets(_table(spark, sf_dir, "documents")))


def op13_support_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every language with their divergences from one another and the terms that set them apart."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline over the whole corpus."""
    return corpus.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_impact_ordered_search, op2_text_density_pages, op3_url_model_ratio, op4_count_vector_jaccard, op5_crf_personal_data, op6_two_tier_token_counts, op7_winnowing_decontamination, op8_variable_capacity_packing, op9_deleted_interpolation, op10_crf_language_id, op11_gemm_centroids, op12_multipart_secrets, op13_support_divergence, pipeline)}
ORACLE_SQL = {"op1_impact_ordered_search": search.ORACLE, "op4_count_vector_jaccard": jaccard.ORACLE, "op7_winnowing_decontamination": decontam.ORACLE, "op11_gemm_centroids": centroids.ORACLE, "op13_support_divergence": divergence.ORACLE}
