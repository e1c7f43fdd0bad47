"""Training corpus from documents: filter, deduplicate, decontaminate, mix, tokenise.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import decontam, jaccard, mixing, quality, tokens
from panelwright.llm.common import bound_batches, n_words, small_batches, table
from panelwright.session import scope, scratch_path

#: Texts of one group have so similar sets of five-word shingles (Jaccard) from link to link.
WORDS, SIMILARITY = 5, Fraction(4, 5)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour votes call good stay.

    As the first stage it bounds the session's Arrow batches by bytes, for the rows
    that this stage and the next ones return as well.
    """
    bound_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs, model)
    kept = scored.where(F.col("score") >= quality.GOOD).drop("score")
    return kept.withColumnRenamed("_score", "score") if "score" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return jaccard.keep_one(docs, WORDS, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    mixed = mixing.mix(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source"), n_words(F.col("text")), F.array("source"), key=("doc_id", "text"))
    times = F.explode(F.sequence(F.lit(1), F.col("mix_repeats").cast("int")))
    return mixed.where(F.col("mix_repeats") > 0).select("row", times.alias("time")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order; one row per sequence says where it lies."""
    return tokens.materialise(docs)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("tokens", write_tokens),
]

#: Hashes, votes and vocabularies have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}-{uuid.uuid4().hex[:8]}")
        with scope(spark), small_batches(spark):  # what a stage settles on its way goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
