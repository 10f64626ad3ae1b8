"""Scalar recode operators: pure Column expressions.

Every builder returns a Column (or rewrites a DataFrame with one ``select``),
so the work stays inside whole-stage codegen and streams as well as batches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import _as_col

# Number syntax accepted as numeric (what a plain decimal parser
# takes; 'nan', 'inf', '1.5d' and hex are rejected).
NUMERIC_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def to_numeric(c) -> Column:
    """Parse to double; anything that is not a plain number -> NULL."""
    s = F.trim(_as_col(c).cast("string"))
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


def nan_to_null(c) -> Column:
    """Ingest rule: floating NaN is a missing value."""
    c = _as_col(c)
    return F.when(~F.isnan(c), c)


def clean_limit_value(c, factor_below: float = 0.99, factor_above: float = 1.01) -> Column:
    """C5: '<80' -> 80*factor_below, '>1700' -> 1700*factor_above, else parse."""
    s = F.trim(_as_col(c).cast("string"))
    num = to_numeric(F.regexp_replace(s, "[<>]", ""))
    return (F.when(s.startswith("<"), num * F.lit(factor_below))
            .when(s.startswith(">"), num * F.lit(factor_above))
            .otherwise(num))


def float_to_int(c, method: str = "round", fill_value: int | None = 0) -> Column:
    """Floor / ceil / round-half-up to bigint; NULL -> fill_value."""
    x = _as_col(c).cast("double")
    if method == "floor":
        v = F.floor(x)
    elif method == "ceil":
        v = F.ceil(x)
    elif method == "round":
        v = F.floor(x + F.lit(0.5))
    else:
        raise ValueError(f"unknown method {method!r}")
    v = v.try_cast("bigint")
    return F.coalesce(v, F.lit(fill_value).cast("bigint")) if fill_value is not None else v


def safe_ratio(num, den) -> Column:
    """C17: num/den as double; NULL when either is NULL or den = 0."""
    n = to_numeric(num) if not isinstance(num, Column) else num.cast("double")
    d = to_numeric(den) if not isinstance(den, Column) else den.cast("double")
    return F.try_divide(n, F.when(d != 0, d))


def map_values(c, mapping: Mapping, default=None) -> Column:
    """Dictionary recode; unmapped -> default (NULL). For small maps only;
    a large map belongs in a broadcast join."""
    if len(mapping) > 10_000:
        raise ValueError("map too large for an inline expression; join a lookup table")
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = F.try_element_at(m, _as_col(c)) if mapping else F.lit(None)
    out = F.when(_as_col(c).isNotNull(), out)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def remap_smc(dx_bl="DX_bl", dx="DX", token: str = "SMC",
              rules: Sequence[tuple[str, str]] = (("CN", "CN"), ("MCI", "EMCI"), ("Dementia", "AD")),
              fallback: str = "CN") -> Column:
    """A baseline label equal to ``token`` is replaced by the label implied
    by the current diagnosis; no rule matches -> ``fallback``."""
    inner = None
    for cur, new in rules:
        cond = _as_col(dx) == F.lit(cur)
        inner = F.when(cond, F.lit(new)) if inner is None else inner.when(cond, F.lit(new))
    inner = inner.otherwise(F.lit(fallback))
    return F.when(_as_col(dx_bl) == F.lit(token), inner).otherwise(_as_col(dx_bl))


# Fixed values: (current diagnosis, baseline label) -> repaired baseline label.
DISCREPANCY_RULES = (("CN", "EMCI", "CN"), ("MCI", "AD", "LMCI"), ("Dementia", "LMCI", "AD"))


def fix_label_discrepancies(dx_bl="DX_bl", dx="DX", rules=DISCREPANCY_RULES) -> Column:
    """Sequential rules (dx, dx_bl) -> new dx_bl. Applied as a fold so
    the sequential semantics hold even for overlapping rules."""
    out = _as_col(dx_bl)
    for cur, old, new in rules:
        out = F.when((_as_col(dx) == F.lit(cur)) & (out == F.lit(old)), F.lit(new)).otherwise(out)
    return out


def derive_group(flag, race, hispanic_values=("White", "Unknown"), flag_value="Hisp/Latino",
                 label: str = "Hispanic") -> Column:
    """Two-column rule -> group label."""
    return (F.when((_as_col(flag) == F.lit(flag_value)) & _as_col(race).isin(*hispanic_values), F.lit(label))
            .otherwise(_as_col(race)))


# Canonical labels, integer codes, and synonym tokens.
CANONICAL_LABELS = ("CN", "EMCI", "LMCI", "AD")
LABEL_BY_CODE = {0: "CN", 1: "EMCI", 2: "LMCI", 3: "AD"}


def normalize_label(c) -> Column:
    """C11: canonicalise a label; NULL when unrecognised (see ``label_reason``).

    Order: integer code 0..3 -> name; exact canonical; canonical token as
    substring (scan order CN, EMCI, LMCI, AD); NORMAL/COGNITIVELY -> CN;
    EARLY+MCI -> EMCI; LATE+MCI -> LMCI; ALZ -> AD.
    """
    raw = _as_col(c).cast("string")
    key = F.upper(F.trim(raw))
    num = to_numeric(raw)
    code = F.when(num.isNotNull() & (num >= -2147483648) & (num <= 2147483647), num.try_cast("int"))
    out = F.when(code.isin(*LABEL_BY_CODE), F.try_element_at(
        F.create_map(*[x for k, v in LABEL_BY_CODE.items() for x in (F.lit(k), F.lit(v))]), code))
    out = out.when(key.isin(*CANONICAL_LABELS), key)
    for tok in CANONICAL_LABELS:
        out = out.when(key.contains(tok), F.lit(tok))
    out = (out.when(key.contains("NORMAL") | key.contains("COGNITIVELY"), F.lit("CN"))
           .when(key.contains("EARLY") & key.contains("MCI"), F.lit("EMCI"))
           .when(key.contains("LATE") & key.contains("MCI"), F.lit("LMCI"))
           .when(key.contains("ALZ"), F.lit("AD")))
    return out


def parse_date(c, fmt: str | None = None) -> Column:
    """C14: parse to date; bad input -> NULL."""
    s = _as_col(c).cast("string")
    ts = F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)
    return ts.cast("date")


def visit_sort_key(c) -> Column:
    """C15: 'bl' -> -1, 'm<digits>' -> the number, anything else -> +inf."""
    c = _as_col(c)
    digits = F.regexp_extract(c, r"m(\d+)", 1)
    return (F.when(c == F.lit("bl"), F.lit(-1.0))
            .when(digits != F.lit(""), digits.cast("double"))
            .otherwise(F.lit(float("inf"))))


def row_sum(cols: Sequence) -> Column:
    """Null-skipping row sum (all NULL -> 0, as pandas)."""
    return sum((F.coalesce(_as_col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))


def row_count_present(cols: Sequence) -> Column:
    return sum((_as_col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(cols: Sequence) -> Column:
    """Null-skipping row mean (all NULL -> NULL)."""
    n = row_count_present(cols)
    return F.when(n > 0, row_sum(cols) / n)


def bound_to(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda a plain
    reference would be computed again for every element."""
    return F.transform(F.array(value), use)[0]


def array_shares(arr: Column) -> Column:
    """Each element over the sum of all, which is computed once."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return bound_to(total, lambda t: F.transform(arr, lambda x: x / t))


def softmax_array(arr) -> Column:
    """C20: max-shifted softmax over an array<double> column."""
    a = _as_col(arr)
    return bound_to(F.struct(a.alias("a"), F.array_max(a).alias("m")), lambda t: bound_to(
        F.transform(t["a"], lambda x: F.exp(x - t["m"])), array_shares))


def format_percent(c, digits: int = 2) -> Column:
    """Value as 'xx.xx%'."""
    return F.format_string(f"%.{digits}f%%", _as_col(c).cast("double"))


def same_type(value, dt) -> bool:
    """C7 guard: does a python value fit the column type the way pandas sees it."""
    if isinstance(value, bool):
        return isinstance(dt, T.BooleanType)
    if isinstance(value, int):
        return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                               T.DecimalType))
    if isinstance(value, float):
        return isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType))
    if isinstance(value, str):
        return isinstance(dt, T.StringType)
    return False


def select_replacing(df: DataFrame, replacements: Mapping[str, Column]) -> DataFrame:
    """Rewrite several columns in one projection, keeping column order."""
    return df.select(*[replacements[c].alias(c) if c in replacements else F.col(f"`{c}`")
                       for c in df.columns])
