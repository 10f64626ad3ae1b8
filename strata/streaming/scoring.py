"""Stream scoring.

The reference's interactive enter -> validate -> derive -> predict -> store
loop, re-aimed as a Structured Streaming job over submitted rows:

    readStream (files) -> validate_rows (P13) -> derived features (C18)
      -> score (any row-local scorer: a fitted model's transform or rules, E2)
      -> foreachBatch: append to the feedback log (S3) keyed by the epoch id

Every step is row-local, so the stream needs no state and no watermark.
``foreachBatch`` writes each epoch as its own ``batch_id`` partition with a
dynamic partition overwrite, so a replayed epoch (after a failure) replaces
its own output instead of duplicating it: the sink is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import validate_rows


def scored_batch(df: DataFrame, rules: Sequence[tuple], derive: Callable[[DataFrame], DataFrame],
                 scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The per-row logic shared by batch and stream: valid rows are derived
    and scored (reasons = ''); quarantined rows keep their raw values and
    their reasons, with no prediction."""
    valid, bad = validate_rows(df, rules)
    good = scorer(derive(valid)).withColumn("reasons", F.lit(""))
    quarantined = bad.withColumn("reasons", F.array_join("reasons", "; "))
    return good.unionByName(quarantined, allowMissingColumns=True)


def score_stream(stream: DataFrame, rules: Sequence[tuple], derive, scorer, sink: str, checkpoint: str,
                 available_now: bool = True):
    """Start the scoring stream; returns the StreamingQuery. Each epoch is
    written to ``sink`` partitioned by batch_id (= epoch id)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        out = scored_batch(batch, rules, derive, scorer).withColumn("batch_id", F.lit(int(epoch_id)))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None, max_files: int = 1) -> DataFrame:
    """A parquet file-source stream over ``directory`` (optionally one file
    pattern), ``max_files`` new files per micro-batch."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(directory)
