"""Corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage gets (spark, docs, sf_dir); all but the last return the columns of docs, as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import best_fit_packing, language_id, minhash_dedup, quality_rules
from docquery.llm.common import small_side


#: Rejected ids up to which they are broadcast instead of shuffling all texts.
BROADCAST_IDS = 1_000_000


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id the verdicts (doc_id, kept) keep; rows of one doc_id stay if one of them is kept."""
    gone = verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("not stays").select("doc_id")
    gone = small_side(gone, BROADCAST_IDS)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.doc_id), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return _keep(docs, quality_rules.quality_rules(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are far from every language or have no letter. Predicts in place, without a join."""
    model = language_id.fit(docs.where(~F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))))
    return docs.where(~language_id.verdict(spark, model)(F.col("text"))["rejected"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return _keep(docs, minhash_dedup.near_duplicates(docs, shingle=5, threshold=0.8))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into bins."""
    return best_fit_packing.pack(docs)


STAGES = [("quality_rules", quality), ("language_id", language), ("minhash_near_dedup", near_dedup), ("best_fit_packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
