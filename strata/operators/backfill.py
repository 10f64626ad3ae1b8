"""Longitudinal back-fill.

For each baseline row: the same subject's visits dated on/after the
baseline date (all visits when the baseline date is NULL), newest first;
the leading run of visits whose label is equivalent to the baseline label;
every NULL fill column <- the newest non-NULL value in that run.

Spark form, with no per-subject window (a subject may hold a third of all
visits): the run ends at the newest *mismatching* visit, which is one
``max`` aggregate per subject; the fill values are ``max_by`` aggregates.
Both aggregates combine map-side, so a hot subject ships one partial row
per input partition, and the joins on the subject key are AQE skew-split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import q

# The reference's diagnosis equivalence (baseline label -> visit label).
DIAGNOSIS_EQUIVALENCE = {"CN": "CN", "EMCI": "MCI", "LMCI": "MCI", "AD": "Dementia"}


def label_equivalent(base_label, visit_label, mapping: Mapping[str, str] = DIAGNOSIS_EQUIVALENCE) -> Column:
    """Many-to-one label map as an expression. A mapped base label must
    map to the visit label; an unmapped one must equal it; NULL never matches."""
    a = F.col(q(base_label)) if isinstance(base_label, str) else base_label
    b = F.col(q(visit_label)) if isinstance(visit_label, str) else visit_label
    if mapping:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        target = F.when(F.array_contains(F.map_keys(m), a), F.try_element_at(m, a)).otherwise(a)
    else:
        target = a
    return F.coalesce(a.isNotNull() & b.isNotNull() & (target == b), F.lit(False))


def _order_key(date: Column, vid: Column) -> Column:
    """Sort key of 'newest first, then lowest id': larger struct = earlier in
    that order; NULL dates sort after every dated visit."""
    return F.struct(date.isNotNull().alias("has_date"),
                    F.coalesce(date.cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("d"),
                    (-vid.cast("long")).alias("neg_id"))


def longitudinal_backfill(base: DataFrame, visits: DataFrame, subject: str, date: str, label: str,
                          visit_label: str, visit_id: str, fill_cols: Sequence[str],
                          mapping: Mapping[str, str] = DIAGNOSIS_EQUIVALENCE) -> tuple[DataFrame, DataFrame]:
    """J1. ``base``: one row per subject with ``date``, ``label`` and the fill
    columns. ``visits``: subject, date, visit_label, visit_id and the fill
    columns. Returns (filled base, one-row report of filled cells / rows)."""
    fill_cols = [c for c in fill_cols if c in base.columns and c in visits.columns
                 and c not in (subject, date, label, visit_label)]
    b = base.select(F.col(q(subject)).alias("_s"), F.col(q(date)).alias("_bd"), F.col(q(label)).alias("_bl"))
    v = visits.select(F.col(q(subject)).alias("_s"), F.col(q(date)).alias("_vd"),
                      F.col(q(visit_label)).alias("_vl"), F.col(q(visit_id)).alias("_vid"),
                      *[F.col(q(c)).alias(f"_f{i}") for i, c in enumerate(fill_cols)])
    # Only subjects with follow-ups survive the inner join.
    j = (b.join(v, "_s", "inner")
         .filter(F.col("_bd").isNull() | (F.col("_vd") >= F.col("_bd")))
         .withColumn("_k", _order_key(F.col("_vd"), F.col("_vid")))
         .withColumn("_match", label_equivalent(F.col("_bl"), F.col("_vl"), mapping)))
    cut = j.filter(~F.col("_match")).groupBy("_s").agg(F.max("_k").alias("_cut"))
    block = (j.join(cut, "_s", "left")
             .filter(F.col("_cut").isNull() | (F.col("_k") > F.col("_cut"))))
    fills = block.groupBy("_s").agg(*[
        F.max_by(F.col(f"_f{i}"), F.when(F.col(f"_f{i}").isNotNull(), F.col("_k"))).alias(f"_f{i}")
        for i in range(len(fill_cols))])
    joined = base.join(fills, base[q(subject)] == fills["_s"], "left")
    rep = {c: F.coalesce(base[q(c)], F.col(f"_f{i}")) for i, c in enumerate(fill_cols)}
    out = joined.select(*[rep[c].alias(c) if c in rep else base[q(c)] for c in base.columns])
    filled_flags = [(base[q(c)].isNull() & F.col(f"_f{i}").isNotNull()) for i, c in enumerate(fill_cols)]
    report = joined.agg(
        F.sum(sum((f.cast("long") for f in filled_flags), F.lit(0))).alias("filled_cells"),
        F.sum(F.greatest(*[f.cast("long") for f in filled_flags], F.lit(0))).alias("filled_rows"))
    return out, report
