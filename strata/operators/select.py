"""Projection, filtering and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recode import is_numeric_type, to_numeric
from .joins import join_small


def q(name: str) -> str:
    """Back-tick a column name (names may hold '/', '.', spaces)."""
    return "`" + name.replace("`", "``") + "`"


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def first_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """First row per key by ``order`` (unique ordering column(s)).

    Expressed as an aggregate (``min_by`` of the whole row) so the map side
    pre-aggregates: a hot key costs one row per input partition in the
    shuffle, never the whole group in one task. Project the frame to the
    columns you need first: the packed row is not pruned afterwards.
    """
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(q(c)) for c in rest])
    order = [order] if isinstance(order, str) else list(order)
    order_key = F.col(q(order[0])) if len(order) == 1 else F.struct(*[F.col(q(o)) for o in order])
    return (df.groupBy(*[F.col(q(k)) for k in key])
              .agg(F.min_by(packed, order_key).alias("_first"))
              .select(*[F.col(q(k)) for k in key], *[F.col("_first." + q(c)).alias(c) for c in rest])
              .select(*[q(c) for c in df.columns]))


def select_baseline(df: DataFrame, subject: str = "PTID", order: str = "row_id", visit: str = "VISCODE",
                    baseline_value: str = "bl", label: str = "DX_bl") -> DataFrame:
    """Baseline rows with a label, first per subject in ``order``."""
    require_columns(df, [subject, order, visit, label])
    kept = df.filter((F.col(q(visit)) == F.lit(baseline_value)) & F.col(q(label)).isNotNull())
    return first_per_key(kept, subject, order)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop by name; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P3."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """One aggregate pass: non-null count per column (action, one row back)."""
    if not cols:
        return {}
    row = df.agg(*[F.count(F.col(q(c))).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def reindex_columns(df: DataFrame, columns: Sequence[str], drop_all_null: bool = True,
                    dtype: str = "double") -> DataFrame:
    """Force a column order; absent columns come in as NULL; then drop
    columns that are entirely NULL (one aggregate)."""
    out = df.select(*[F.col(q(c)) if c in df.columns else F.lit(None).cast(dtype).alias(c) for c in columns])
    if drop_all_null:
        counts = non_null_counts(out, list(columns))
        out = out.drop(*[c for c, n in counts.items() if n == 0])
    return out


def intersect_columns(df: DataFrame, other: DataFrame | Sequence[str]) -> DataFrame:
    """P5: keep the columns also present in ``other`` (in ``other``'s order)."""
    names = other.columns if isinstance(other, DataFrame) else list(other)
    return df.select(*[q(c) for c in names if c in df.columns])


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(q(c))).alias(c) for c in cols]).first()
    n = row["__n"]
    return {c: (100.0 * (n - row[c]) / n if n else 0.0) for c in cols}


def drop_sparse_columns(df: DataFrame, threshold: float = 50.0, cols: Sequence[str] | None = None
                        ) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null share is strictly above ``threshold`` %.
    Returns the frame and the dropped names (decided by one aggregate)."""
    shares = null_shares(df, cols)
    dropped = [c for c, s in shares.items() if s > threshold]
    return df.drop(*dropped), dropped


def single_value_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns whose distinct count, NULL included, is 1: all NULL, or no
    NULL and min = max. One aggregate, no distinct counting."""
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        aggs += [F.count(F.col(q(c))).alias(f"n|{c}"), F.min(F.col(q(c))).alias(f"lo|{c}"),
                 F.max(F.col(q(c))).alias(f"hi|{c}")]
    row = df.agg(F.count(F.lit(1)).alias("__n"), *aggs).first()
    n = row["__n"]
    out = []
    for c in cols:
        k = row[f"n|{c}"]
        if n > 0 and (k == 0 or (k == n and row[f"lo|{c}"] == row[f"hi|{c}"])):
            out.append(c)
    return out


def drop_single_value_columns(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """P7."""
    dropped = single_value_columns(df, cols)
    return df.drop(*dropped), dropped


def clamp_below(c, floor_value) -> Column:
    """Values under the floor become the floor; NULL stays NULL."""
    c = F.col(q(c)) if isinstance(c, str) else c
    return F.when(c < F.lit(floor_value), F.lit(floor_value)).otherwise(c)


def null_out_cells(df: DataFrame, corrections: DataFrame, key: str, column_col: str = "column") -> DataFrame:
    """Set cells to NULL for (key, column) pairs listed in ``corrections``.

    The corrections are folded to one row per key (bounded by the number of
    columns) and joined; the join is broadcast only when the table is
    proven small.
    """
    per_key = (corrections.groupBy(F.col(q(key)).alias("__k"))
               .agg(F.collect_set(F.col(q(column_col))).alias("__null_cols")))
    joined = join_small(df, per_key, df[q(key)] == per_key["__k"], "left")
    sel = [F.when(F.coalesce(F.array_contains("__null_cols", F.lit(c)), F.lit(False)), F.lit(None))
           .otherwise(F.col(q(c))).alias(c) for c in df.columns]
    return joined.select(*sel)


def drop_rows_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Delete rows whose key is listed (anti join)."""
    k = keys.select(F.col(q(key)).alias("__k")).distinct()
    return join_small(df, k, df[q(key)] == k["__k"], "left_anti")


def filter_not_equal(df: DataFrame, col: str, value) -> DataFrame:
    """Keep rows whose value differs from ``value``; NULL rows are kept
    (pandas mask semantics)."""
    return df.filter(~F.col(q(col)).eqNullSafe(F.lit(value)))


def filter_unlabelled(df: DataFrame, visit: str = "VISCODE", baseline_value: str = "bl",
                      label: str = "DX_bl") -> DataFrame:
    """Baseline rows without a label (the rows to score)."""
    return df.filter((F.col(q(visit)) == F.lit(baseline_value)) & F.col(q(label)).isNull())


def infer_columns(df: DataFrame, columns: Sequence[str] | None = None, kind: str = "numeric") -> list[str]:
    """Numeric or categorical column list from the schema; unknown names error."""
    if columns:
        require_columns(df, columns)
        return list(columns)
    if kind == "numeric":
        return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def lookup_rows(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """P16."""
    return df.filter(F.col(q(col)).isin(*values))


def slice_features(df: DataFrame, remove: Sequence[str]) -> DataFrame:
    """Drop the features a model preset does not use."""
    return drop_columns(df, remove)


# ---------------------------------------------------------------- P13 validation

def validate_rows(df: DataFrame, rules: Sequence[tuple], parse_only: Sequence[str] = (),
                  key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-column range/type checks driven by a rule table.

    ``rules`` = [(column, min, max, "int"|"float")]. Values are parsed from
    strings; ints are truncated toward zero; blank, non-numeric and
    out-of-range values produce a reason. Columns in ``parse_only`` are only
    parsed. Returns (valid rows with parsed values, quarantined rows with an
    array of reasons). Pure projection + filter, so it works on streams.
    """
    reasons = []
    parsed = {}
    for col, lo, hi, kind in rules:
        raw = F.trim(F.col(q(col)).cast("string"))
        num = to_numeric(raw)
        val = num.cast("bigint").cast("double") if kind == "int" else num
        parsed[col] = val
        reasons.append(F.when(raw.isNull() | (raw == ""), F.lit(f"{col}: missing"))
                       .when(num.isNull(), F.lit(f"{col}: not a number"))
                       .when((val < F.lit(lo)) | (val > F.lit(hi)), F.lit(f"{col}: outside [{lo}, {hi}]")))
    for col in parse_only:
        parsed[col] = to_numeric(F.col(q(col)))
    checked = df.select(*[parsed[c].alias(c) if c in parsed else F.col(q(c)) for c in df.columns],
                        F.array_compact(F.array(*reasons)).alias("reasons") if reasons
                        else F.array().cast("array<string>").alias("reasons"))
    valid = checked.filter(F.size("reasons") == 0).drop("reasons")
    bad = checked.filter(F.size("reasons") > 0)
    return valid, bad
