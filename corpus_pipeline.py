"""The training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage works on all rows that the one before it kept; but for the last they return the columns of
``documents``. Null texts are empty, rows with null ids are never taken for another row's copy, extra columns
are carried along whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from strata.llm.shared import documents, uncarried, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return uncarried(quality.quality_scores(docs, model, carry=True).where("predicted = 1"), docs.columns, "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, one of the smallest id; documents are linked from a similarity of 0.8
    on. Rows are judged, not ids: of equal rows of one id one stays, rows of one id with unlike texts all do. Rows without
    words or with a null id stay."""
    return near_dedup.without_near_duplicates(docs, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document with a smaller id are cut out; a document that is left without words goes."""
    cut = substring_dedup.substring_dedup(docs, carry=True).where("n_removed = 0 OR n_removed < n_words")
    return uncarried(cut, docs.columns, "text", n_chars=F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else F.lit(None))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, none of which crosses documents. Executors hold what the stages before have left in
    the JVM, so the workers keep few chunks."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, kept=100_000, rows_at_once=256)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("decontaminate", decontaminate_stage), ("packing", packing_stage)]

#: Compression, edit distances and byte-pair encoding are beyond SQL; tests/llm/ checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
