"""Scaling, encoding and binning.

Every operator is fit-then-apply: ``fit_*`` runs one aggregate and returns
small, bounded statistics (a few numbers per column, or a category list
behind a size check); ``apply_*`` is a single projection, so a fitted model
scores batches and streams alike. Label and ordinal codes of more categories
than that check allows are a table, which ``apply_*`` joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recode import is_numeric_type
from ..session import cut_lineage
from .joins import has_at_most, join_small
from .ranks import exact_quantiles
from .select import q, require_columns

MAX_CATEGORIES = 10_000


def _numeric_only(df: DataFrame, cols: Sequence[str]) -> None:
    require_columns(df, cols)
    bad = [c for c in cols if not is_numeric_type(df.schema[c].dataType)]
    if bad:
        raise TypeError(f"non-numeric columns: {bad}")


def _apply_affine(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """x -> (x - center) / scale for each fitted column, one projection."""
    return df.select(*[((F.col(q(c)).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c)
                       if c in stats else F.col(q(c)) for c in df.columns])


def fit_min_max(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """N1 fit: center = min, scale = max - min (0 -> 1)."""
    _numeric_only(df, cols)
    row = df.agg(*[x for c in cols for x in (F.min(q(c)).alias(f"lo{c}"), F.max(q(c)).alias(f"hi{c}"))]).first()
    out = {}
    for c in cols:
        lo, hi = row[f"lo{c}"], row[f"hi{c}"]
        lo = float(lo) if lo is not None else 0.0
        rng = (float(hi) - lo) if hi is not None else 0.0
        out[c] = (lo, rng if rng != 0 else 1.0)
    return out


def min_max_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N1."""
    return _apply_affine(df, fit_min_max(df, cols))


def fit_z_score(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """N2 fit: mean and *population* std (0 or undefined -> 1)."""
    _numeric_only(df, cols)
    row = df.agg(*[x for c in cols for x in (F.avg(q(c)).alias(f"m{c}"), F.stddev_pop(q(c)).alias(f"s{c}"))]).first()
    out = {}
    for c in cols:
        m, s = row[f"m{c}"], row[f"s{c}"]
        out[c] = (float(m) if m is not None else 0.0, float(s) if s else 1.0)
    return out


def z_score_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N2."""
    return _apply_affine(df, fit_z_score(df, cols))


def _exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Exact (interpolated) percentiles per column, all columns in
    one pass over the unpivoted table."""
    long = df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    got = {r["column"]: r["_p"] for r in exact_quantiles(long, "value", probs, "column").collect()}  # one row per column
    return {c: got.get(c) for c in cols}


def fit_robust(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """N3 fit: median and interquartile range (0 -> 1), exact."""
    _numeric_only(df, cols)
    pct = _exact_percentiles(df, cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        p = pct[c]
        if p is None or p[1] is None:
            out[c] = (0.0, 1.0)
            continue
        iqr = p[2] - p[0]
        out[c] = (p[1], iqr if iqr != 0 else 1.0)
    return out


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N3."""
    return _apply_affine(df, fit_robust(df, cols))


def _categories(df: DataFrame, col: str, as_string: bool = True, null_token: str | None = "nan") -> list:
    """Sorted distinct values (string form), behind a cardinality bound."""
    c = F.col(q(col))
    v = F.coalesce(c.cast("string"), F.lit(null_token)) if (as_string and null_token is not None) else c
    d = df.select(v.alias("v")).distinct()
    if not has_at_most(d, MAX_CATEGORIES):
        raise ValueError(f"{col}: more than {MAX_CATEGORIES} categories")
    return sorted(r["v"] for r in d.collect() if r["v"] is not None)


def _code_map(values: Sequence) -> Column:
    return F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])


def _code_table(values: DataFrame) -> DataFrame:
    """(v, code): the places of the distinct ``v`` in their order, from 0, for
    any number of them: the sorted table is cut to the checkpoint folder, and
    the sizes of its partitions (one number each) give the offsets."""
    d = cut_lineage(values.where("v IS NOT NULL").orderBy("v").withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    below, offsets = 0, []
    for r in d.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets += [F.lit(r["p"]).cast("bigint"), F.lit(below).cast("bigint")]
        below += r["count"]
    return d.select("v", (F.element_at(F.create_map(*offsets), part) + place).cast("int").alias("code"))


def _codes(df: DataFrame, value: Column) -> list | DataFrame:
    """The sorted categories, or the table of their codes where they are more than ``MAX_CATEGORIES``."""
    d = df.select(value.alias("v")).distinct()
    if has_at_most(d, MAX_CATEGORIES):
        return sorted(r["v"] for r in d.collect() if r["v"] is not None)
    return _code_table(d)


def _with_codes(df: DataFrame, tables: Mapping[str, tuple[Column, DataFrame]], rep: dict[str, Column]) -> DataFrame:
    """``df`` with the replacements ``rep``, and for each column of ``tables`` the code that its value has there."""
    rep, columns = dict(rep), df.columns
    for i, (c, (value, codes)) in enumerate(tables.items()):
        df = join_small(df, codes.select(F.col("v").alias(f"_v_{i}"), F.col("code").alias(f"_code_{i}")), value == F.col(f"_v_{i}"))
        rep[c] = F.col(f"_code_{i}")
    return df.select(*[rep[c].alias(c) if c in rep else F.col(q(c)) for c in columns])


def fit_label_encoder(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str] | DataFrame]:
    """N4 fit: alphabetical categories of the string form (above
    ``MAX_CATEGORIES`` a table of their codes); NULL is the category 'nan'.
    Numeric columns are refused."""
    require_columns(df, cols)
    bad = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    if bad:
        raise TypeError(f"label encoding needs categorical columns, got numeric {bad}")
    return {c: _codes(df, _label_value(c)) for c in cols}


def _label_value(col: str) -> Column:
    return F.coalesce(F.col(q(col)).cast("string"), F.lit("nan"))


def apply_label_encoder(df: DataFrame, fitted: Mapping[str, Sequence[str] | DataFrame]) -> DataFrame:
    tables = {c: (_label_value(c), vals) for c, vals in fitted.items() if isinstance(vals, DataFrame)}
    rep = {c: F.try_element_at(_code_map(vals), _label_value(c)) for c, vals in fitted.items() if c not in tables}
    return _with_codes(df, tables, rep)


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N4."""
    return apply_label_encoder(df, fit_label_encoder(df, cols))


def one_hot_encode(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
                   categories: Mapping[str, Sequence] | None = None) -> DataFrame:
    """0/1 columns ``<col>_<value>`` in sorted value order (NULL rows are
    0 everywhere), optional drop-first; originals dropped."""
    require_columns(df, cols)
    cats = dict(categories or {})
    for c in cols:
        if c not in cats:
            cats[c] = _categories(df, c, null_token=None)
    sel = []
    for c in df.columns:
        if c not in cols:
            sel.append(F.col(q(c)))
            continue
        vals = list(cats[c])[1:] if drop_first else list(cats[c])
        for v in vals:
            sel.append(F.when(F.col(q(c)).cast("string") == F.lit(str(v)), F.lit(1.0)).otherwise(F.lit(0.0))
                       .alias(f"{c}_{v}"))
    return df.select(*sel)


def ordinal_encode(df: DataFrame, cols: Sequence[str], categories: Sequence[Sequence] | None = None,
                   mapping: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Explicit mapping (unknown -> NULL), explicit category order, or
    alphabetical order. ``categories`` must have one list per column."""
    require_columns(df, cols)
    if categories is not None and len(categories) != len(cols):
        raise ValueError("categories must have one entry per column")
    rep, tables = {}, {}
    for i, c in enumerate(cols):
        if mapping and c in mapping:
            m = F.create_map(*[x for k, v in mapping[c].items() for x in (F.lit(k), F.lit(v))])
            rep[c] = F.try_element_at(m, F.col(q(c)))
        else:
            vals = list(categories[i]) if categories is not None else _codes(df, F.col(q(c)))
            if isinstance(vals, DataFrame):
                tables[c] = (F.col(q(c)), vals)
            else:
                rep[c] = F.try_element_at(_code_map([str(v) for v in vals]), F.col(q(c)).cast("string"))
    return _with_codes(df, tables, rep)


# ------------------------------------------------------------------ binning

def bin_ladder(x: Column, edges: Sequence[float], include_lowest: bool = True) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ...; with ``include_lowest`` the
    first bin also takes e0. Outside -> NULL. (Bucketizer / width_bucket
    are left-closed, so they do not fit.)"""
    n = len(edges) - 1
    if n < 1:
        return F.lit(None).cast("int")
    lo = (x >= F.lit(edges[0])) if include_lowest else (x > F.lit(edges[0]))
    out = None
    for i in range(n):
        cond = (x <= F.lit(edges[i + 1]))
        if i == 0:
            cond = cond & lo
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Edges of n equal-width bins; the lowest edge is moved down by 0.1 % of
    the range; a zero range is widened by 0.1 % of |value| (0.001 at 0)."""
    if lo == hi:
        lo2 = lo - (0.001 * abs(lo) if lo != 0 else 0.001)
        hi2 = hi + (0.001 * abs(hi) if hi != 0 else 0.001)
        step = (hi2 - lo2) / bins
        return [lo2 + i * step for i in range(bins)] + [hi2]
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(bins)] + [hi]
    edges[0] = lo - (hi - lo) * 0.001
    return edges


def _label_expr(idx: Column, labels: Sequence | None) -> Column:
    if labels is None:
        return idx
    return F.try_element_at(F.array(*[F.lit(str(v)) for v in labels]), idx + 1)


def _handle_na(df: DataFrame, col: str, handle_na: str, fill_value):
    if handle_na == "drop":
        return df.filter(F.col(q(col)).isNotNull())
    if handle_na == "fill":
        return df.withColumn(col, F.coalesce(F.col(q(col)), F.lit(fill_value)))
    return df


def _finish_bins(df: DataFrame, col: str, edges: Sequence[float], labels, handle_na: str, out: str | None,
                 include_lowest: bool) -> DataFrame:
    idx = bin_ladder(F.col(q(col)).cast("double"), edges, include_lowest)
    lab = _label_expr(idx, labels)
    if handle_na == "separate":
        lab = F.when(F.col(q(col)).isNull(), F.lit("Missing")).otherwise(lab.cast("string"))
    return df.withColumn(out or col, lab)


def equal_width_bins(df: DataFrame, col: str, bins: int, labels: Sequence | None = None, handle_na: str = "ignore",
                     fill_value=None, out: str | None = None) -> tuple[DataFrame, list[float]]:
    """Returns (frame with the bin index / label in ``out``, edges)."""
    df = _handle_na(df, col, handle_na, fill_value)
    row = df.agg(F.min(q(col)).alias("lo"), F.max(q(col)).alias("hi")).first()
    if row["lo"] is None:
        return df.withColumn(out or col, F.lit(None).cast("int")), []
    edges = equal_width_edges(float(row["lo"]), float(row["hi"]), bins)
    return _finish_bins(df, col, edges, labels, handle_na, out, include_lowest=False), edges


def equal_frequency_bins(df: DataFrame, col: str, q_bins: int, labels: Sequence | None = None,
                         handle_na: str = "ignore", fill_value=None, out: str | None = None
                         ) -> tuple[DataFrame, list[float]]:
    """Quantile edges (exact, interpolated), duplicate edges dropped,
    lowest value included."""
    df = _handle_na(df, col, handle_na, fill_value)
    p = _exact_percentiles(df, [col], [i / q_bins for i in range(q_bins + 1)])[col]
    if p is None or p[0] is None:
        return df.withColumn(out or col, F.lit(None).cast("int")), []
    edges = []
    for e in p:
        if not edges or e != edges[-1]:
            edges.append(float(e))
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("labels must match the number of bins after dropping duplicate edges")
    return _finish_bins(df, col, edges, labels, handle_na, out, include_lowest=True), edges


def custom_bins(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence | None = None,
                handle_na: str = "ignore", fill_value=None, out: str | None = None) -> DataFrame:
    """User edges, right-closed, lowest included, outside -> NULL."""
    if list(edges) != sorted(edges):
        raise ValueError("edges must increase")
    df = _handle_na(df, col, handle_na, fill_value)
    return _finish_bins(df, col, list(edges), labels, handle_na, out, include_lowest=True)


def bin_summary(df: DataFrame, value: str, bin_col: str, examples: int = 5) -> DataFrame:
    """Per bin count, share %, min, max and up to ``examples`` example
    values (the smallest distinct ones). ``row_number() <= k`` is planned
    with a partial WindowGroupLimit before the shuffle, so a hot bin ships
    at most k rows per map task."""
    v = F.col(q(value))
    stats = df.groupBy(q(bin_col)).agg(F.count(F.lit(1)).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
    ex = (df.select(q(bin_col), v.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
          .withColumn("_rn", F.row_number().over(Window.partitionBy(q(bin_col)).orderBy("_v")))
          .filter(F.col("_rn") <= examples)
          .groupBy(q(bin_col)).agg(F.array_sort(F.collect_list("_v")).alias("examples")))
    # one row per bin (bounded by the bin count), so a global window is cheap here
    out = stats.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))
    ex = ex.withColumnRenamed(bin_col, "_bin")
    return (out.join(ex, out[q(bin_col)].eqNullSafe(ex["_bin"]), "left")
            .select(q(bin_col), "count", "pct", "min", "max", "examples"))
