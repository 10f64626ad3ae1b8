"""Registered queries: stream scoring and the feedback log (SURVEY 2.16 Q6,
2.1 S3/S4). The stream's written result must equal the batch SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import io as IO
from ..streaming.scoring import file_stream, score_stream
from .common import r6, table
from .registry import register

# Validation rules for the submitted event rows (column, min, max, type).
EVENT_RULES = [("value", 1, 400, "float"), ("user_id", 0, 140, "int")]


def _derive(df):
    return df.withColumn("value_per_user", F.try_divide(F.col("value"), F.when(F.col("user_id") != 0, F.col("user_id"))))


def _score(df):
    return df.withColumn("label", F.when(F.col("value") > 200, F.lit("high")).when(F.col("value") > 50, F.lit("mid"))
                         .otherwise(F.lit("low")))


def _scratch(spark, what):
    return os.path.join(checkpoint_dir(spark), what, uuid.uuid4().hex)


@register("score_stream", """
WITH t AS (SELECT event_id, user_id, value FROM events)
SELECT event_id,
  CASE WHEN value < 1 OR value > 400 OR user_id < 0 OR user_id > 140 THEN NULL
       WHEN value > 200 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS label,
  CASE WHEN value < 1 OR value > 400 OR user_id < 0 OR user_id > 140 THEN NULL
       ELSE round(value / NULLIF(user_id, 0), 6) END AS value_per_user,
  concat_ws('; ', CASE WHEN value < 1 OR value > 400 THEN 'value: outside [1, 400]' END,
                  CASE WHEN user_id < 0 OR user_id > 140 THEN 'user_id: outside [0, 140]' END) AS reasons
FROM t
""")
def q_score_stream(spark, sf):
    """Q6: events streamed from their parquet file (availableNow), validated,
    derived, scored and appended per epoch; the sink is read back."""
    stream = file_stream(spark, sf, table(spark, sf, "events").schema, glob="events.parquet").select(
        "event_id", "user_id", "value")
    sink, ck = _scratch(spark, "stream_sink"), _scratch(spark, "stream_ckpt")
    qry = score_stream(stream, EVENT_RULES, _derive, _score, sink, ck)
    qry.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("event_id", F.when(F.col("reasons") == "", F.col("label")).alias("label"),
                      F.when(F.col("reasons") == "", r6("value_per_user")).alias("value_per_user"), "reasons")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("feedback_log", """
SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type <> 'view'
""")
def q_feedback_log(spark, sf):
    """Each event type is appended as its own batch (1..5); undoing
    batch 3 is refused (newer batches exist); undoing batch 5 succeeds; the
    live log is what remains."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    path = _scratch(spark, "feedback")
    for i, t in enumerate(_TYPES, start=1):
        IO.append_feedback(ev.filter(F.col("event_type") == t), path, ["event_id", "event_type", "value"], i)
    refused = IO.undo_last_append(spark, path, batch_id=3, undo_batch_id=6)
    done = IO.undo_last_append(spark, path, batch_id=5, undo_batch_id=7)
    if refused or not done:
        raise RuntimeError("undo rule violated")
    live = IO.live_rows(spark, path)
    return live.select("event_id", "event_type", r6("value").alias("value"))
