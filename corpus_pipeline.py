"""The corpus pipeline: five operators in a row, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize
from weftline.llm.decontaminate import decontaminate
from weftline.llm.language_id import UNDETERMINED, fit, identify, is_held_out
from weftline.llm.line_dedup import line_dedup
from weftline.llm.ngram_join import keep_one
from weftline.llm.packing import pack_documents

#: Cosine with the best language prototype below which nothing is known of a document's language.
MIN_SCORE = 0.02
#: Pieces of text remembered by a process while it packs: executors still hold what earlier stages took.
REMEMBERED = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: some letter, and a cosine of at least MIN_SCORE with a prototype.

    Prototypes come from the labelled documents that are not held out. A null language is filled with the prediction.
    """
    told = identify(docs, fit(docs.where(~is_held_out())))
    kept = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more from every text; documents stay, with n_chars counted anew."""
    out = line_dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.75 or more."""
    return keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return pack_documents(docs, remembered=REMEMBERED)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark_free), ("packing", packed)]

#: SQL can express neither the language model nor the packing; a brute-force version is tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
