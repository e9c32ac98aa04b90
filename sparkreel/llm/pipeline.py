"""The corpus pipeline: language, near copies, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of `documents`. run() writes each stage's rows to the shared folder and
reads them again as the next one's documents. The stages set how many bytes of rows the session hands to
Python at once (BATCH): their rows are computed after they return, so that the setting stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.llm import decontam, jaccard, langid, packing, pii
from sparkreel.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose words carry their commonest language with less mean probability is rejected.
LEAST_SCORE = 0.4
#: Bytes of an Arrow batch. Spark's own 64 MB are held several times for each task, by the executor and by its worker, on the way there and back.
BATCH = "4m"


def TOKENIZER() -> str:  # noqa: N802
    """The path of the tokenizer that lengths are counted with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Python workers get batches of BATCH bytes, or of one row; what they return is the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text carries a language: `und` and scores below LEAST_SCORE go."""
    small_batches(spark)
    said = langid.predict(docs, keep=COLUMNS[1:])
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies (5-word shingles, Jaccard 0.8 or more) the row with the smallest doc_id.

    Every row counts for itself: rows without a doc_id come after all others, of rows that agree in doc_id
    and text the one first by lang, source and n_chars stays (nulls first), and rows that share a doc_id but
    not their text are no copies of each other.
    Texts without words are near nothing: all of them stay.
    """
    small_batches(spark)
    rows = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    found = jaccard.jaccard_components(rows, 5, 80, 100, doc_id="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = rows.select("_key", "doc_id").join(found, "_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_key")).select("_key")
    # few rows agree in their key: of those, and of no others, one is picked
    rest = F.struct("lang", "source", "n_chars")
    least = rows.groupBy("_key").agg(F.min(rest).alias("_least"))
    kept = rows.join(first, "_key", "left_semi").join(least, "_key").where(rest.eqNullSafe(F.col("_least")))
    return kept.dropDuplicates(["_key"]).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows of whose words a twentieth or more lie in benchmark windows, whatever their doc_id; repeated rows are judged each."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = decontam.report(found, "text_hash").where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of every span of personal data; n_chars follows. Every row stays, whatever its doc_id; null texts stay null."""
    small_batches(spark)
    hidden = pii.personal_data(docs, keep=("lang", "source"))
    return hidden.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts that are left, by their tokens and an end token each, into sequences of the permitted lengths. Null and repeated ids are packed each."""
    small_batches(spark)
    return packing.pack_texts(docs, TOKENIZER())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The stages hold trained models: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
