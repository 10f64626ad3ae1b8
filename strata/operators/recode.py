"""Frame-level recode operators built on ``functions.recode``.

Each rewrites all affected columns in one ``select`` so a wide table does
not grow one projection per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recode import clean_limit_value, safe_ratio, same_type, select_replacing
from .select import q


def bl_pairs(df: DataFrame, suffix: str = "_bl") -> list[tuple[str, str]]:
    """(base, base_bl) pairs; suffix match is case-insensitive."""
    cols = df.columns
    out = []
    for c in cols:
        if c.lower().endswith(suffix.lower()) and len(c) > len(suffix):
            base = c[: -len(suffix)]
            if base in cols:
                out.append((base, c))
    return out


def fill_bl_from_base(df: DataFrame, suffix: str = "_bl") -> tuple[DataFrame, DataFrame]:
    """NULL ``X_bl`` <- ``X``. Returns (frame, report of filled cells per
    column); the report is a lazy one-row aggregate unpivoted to rows."""
    pairs = bl_pairs(df, suffix)
    out = select_replacing(df, {bl: F.coalesce(F.col(q(bl)), F.col(q(base))) for base, bl in pairs})
    if pairs:
        counts = df.agg(*[F.sum((F.col(q(bl)).isNull() & F.col(q(base)).isNotNull()).cast("long")).alias(bl)
                          for base, bl in pairs])
        report = counts.unpivot([], [bl for _, bl in pairs], "column", "filled")
    else:
        report = df.sparkSession.createDataFrame([], "column string, filled long")
    return out, report


def consolidate_bl(df: DataFrame, suffix: str = "_bl") -> DataFrame:
    """C4: drop ``X`` where ``X_bl`` exists and rename ``X_bl`` -> ``X``
    (the label's ``_bl`` version replaces the label too)."""
    pairs = dict((bl, base) for base, bl in bl_pairs(df, suffix))
    replaced = set(pairs.values())
    sel = []
    for c in df.columns:
        if c in replaced:
            continue
        sel.append(F.col(q(c)).alias(pairs[c]) if c in pairs else F.col(q(c)))
    return df.select(*sel)


def clean_limit_values(df: DataFrame, cols: Sequence[str], factor_below: float = 0.99,
                       factor_above: float = 1.01) -> DataFrame:
    """C5 over several columns; absent columns are skipped."""
    return select_replacing(df, {c: clean_limit_value(F.col(q(c)), factor_below, factor_above)
                                 for c in cols if c in df.columns})


def replace_value(df: DataFrame, col: str, old, new) -> DataFrame:
    """Exact replacement in one column; absent column -> unchanged."""
    if col not in df.columns:
        return df
    return select_replacing(df, {col: F.when(F.col(q(col)) == F.lit(old), F.lit(new)).otherwise(F.col(q(col)))})


def fill_null_constant(df: DataFrame, col: str, value) -> DataFrame:
    """Fill NULLs with a constant, skipped when the value's type does not
    fit the column type."""
    if col not in df.columns:
        return df
    dt = df.schema[col].dataType
    if not same_type(value, dt):
        return df
    return select_replacing(df, {col: F.coalesce(F.col(q(col)), F.lit(value).cast(dt))})


def float_to_int_columns(df: DataFrame, modes: Mapping[str, str], fill_value: int | None = 0) -> DataFrame:
    """C8 over several columns: {column: 'floor'|'ceil'|'round'}."""
    from ..functions.recode import float_to_int
    return select_replacing(df, {c: float_to_int(F.col(q(c)), m, fill_value) for c, m in modes.items()
                                 if c in df.columns})


def detect_integer_like(df: DataFrame, cols: Sequence[str] | None = None, forced: Sequence[str] = (),
                        tol: float = 1e-8) -> list[str]:
    """Float columns whose non-null values are all integral (within tol;
    an all-null column is not integer-like) + integer columns + ``forced``,
    de-duplicated in order. One aggregate over all float columns."""
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    ints = [f.name for f in fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    floats = [f.name for f in fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    found = []
    if floats:
        aggs = []
        for c in floats:
            x = F.col(q(c)).cast("double")
            frac = F.abs(x - F.round(x))
            aggs += [F.max(frac).alias(f"f|{c}"), F.count(x).alias(f"n|{c}")]
        row = df.agg(*aggs).first()
        found = [c for c in floats if row[f"n|{c}"] > 0 and row[f"f|{c}"] <= tol]
    out = []
    for c in list(found) + ints + list(forced):
        if c not in out:
            out.append(c)
    return out


def derive_ratios(df: DataFrame, ratios: Sequence[tuple[str, str, str]], drop_inputs: Sequence[str] = ()
                  ) -> DataFrame:
    """Add ratio features (numerator, denominator, name) and drop raw
    inputs, in one projection. Ratios whose inputs are absent are skipped."""
    new = [safe_ratio(F.col(q(n)), F.col(q(d))).alias(name) for n, d, name in ratios
           if n in df.columns and d in df.columns]
    keep = [F.col(q(c)) for c in df.columns if c not in set(drop_inputs)]
    return df.select(*keep, *new)


# The volumes that are divided by the head's.
VOLUMES = ("Ventricles", "Hippocampus", "Entorhinal", "Fusiform", "MidTemp", "WholeBrain")


def derive_features(df: DataFrame, markers: Sequence[str] = ("TAU", "PTAU"), reference: str = "ABETA", volumes: Sequence[str] = VOLUMES, whole: str = "ICV") -> DataFrame:
    """The full rule set. Each marker that is there becomes ``marker/reference``, and what went into a ratio is dropped:
    both markers, or either, or (without the reference, or without any marker) none, in which case nothing is touched.
    If ``whole`` is there, each volume becomes ``volume/whole``, and volumes and ``whole`` are dropped. A ratio with a
    NULL part, or a zero below, is NULL. One projection."""
    have = set(df.columns)
    used = [m for m in markers if m in have] if reference in have else []
    sized = [v for v in volumes if v in have] if whole in have else []
    ratios = [(m, reference, f"{m}/{reference}") for m in used] + [(v, whole, f"{v}/{whole}") for v in sized]
    gone = [*used, *([reference] if used else []), *sized, *([whole] if whole in have else [])]
    return derive_ratios(df, ratios, drop_inputs=gone)


def ordered_category(df: DataFrame, col: str, order: Sequence, out: str = "position") -> DataFrame:
    """Attach the position of each value in a custom order (NULL when
    the value is not listed)."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(out, F.try_element_at(m, F.col(q(col))))
