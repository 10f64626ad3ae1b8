"""Aggregation and profiling.

Wide profiles are computed by unpivoting to (column, value) and grouping by
the column name: the final aggregation of each column lands in its own task
instead of one task merging every column's state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import seeded_hash
from ..functions.recode import nan_to_null
from ..session import cut_lineage
from .joins import join_small
from .select import infer_columns, q


def _long(df: DataFrame, cols: Sequence[str], dtype: str = "double", key: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` to (key..., column, value) with a common type."""
    return df.select(*[q(k) for k in key], *[F.col(q(c)).cast(dtype).alias(c) for c in cols]).unpivot(
        list(key), list(cols), "column", "value")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, accuracy: int | None = None
                     ) -> DataFrame:
    """A1: count, mean, sample std, min, 25/50/75 %, max, one row per column.

    Percentiles are exact with linear interpolation (pandas semantics) unless
    ``accuracy`` is given, which switches to ``percentile_approx`` for very
    high-cardinality columns at scale.
    """
    cols = infer_columns(df, cols, "numeric")
    long = _long(df, cols)
    v = F.col("value")
    stats = long.groupBy("column").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                       F.min(v).alias("min"), F.max(v).alias("max"))
    if accuracy:
        pct = long.groupBy("column").agg(F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_p"))
    else:
        from .ranks import exact_quantiles
        pct = exact_quantiles(long, "value", [0.25, 0.5, 0.75], "column")
    return stats.join(pct, "column", "left").select("column", "count", "mean", "std", "min", F.col("_p")[0].alias("p25"),
                                                    F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p75"), "max")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: count, unique, top (ties -> smallest value), freq per column."""
    cols = infer_columns(df, cols, "categorical")
    counts = (_long(df, cols, "string").filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v")))
    return (counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                                         best.alias("_b"))
            .select("column", "count", "unique", F.col("_b.v").alias("top"), (-F.col("_b.neg")).alias("freq")))


def table_info(df: DataFrame) -> DataFrame:
    """A3: column, type, non-null count and row count."""
    long = df.select(*[F.col(q(c)).isNotNull().cast("long").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "present")
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i)
                                             for i, f in enumerate(df.schema.fields)],
                                            "column string, dtype string, position int")
    agg = long.groupBy("column").agg(F.sum("present").alias("non_null"), F.count(F.lit(1)).alias("n_rows"))
    return join_small(agg, types, "column", "inner").select("position", "column", "dtype", "non_null", "n_rows")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: null count and % per column, most-missing first."""
    cols = list(cols or df.columns)
    long = df.select(*[F.col(q(c)).isNull().cast("long").alias(c) for c in cols]).unpivot(
        [], cols, "column", "is_null")
    return (long.groupBy("column").agg(F.sum("is_null").alias("n_null"), F.count(F.lit(1)).alias("n_rows"))
            .select("column", "n_null", (F.col("n_null") * 100.0 / F.col("n_rows")).alias("pct_null"))
            .orderBy(F.desc("pct_null"), "column"))


def null_share_per_row(df: DataFrame, cols: Sequence[str], subject: str, order: str) -> DataFrame:
    """A5: fraction of NULL cells per row; first row per subject (lowest
    ``order``), most-missing first."""
    share = sum((F.col(q(c)).isNull().cast("double") for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    per_row = df.select(q(subject), q(order), share.alias("null_share"))
    first = (per_row.groupBy(q(subject)).agg(F.min_by(F.col("null_share"), F.col(q(order))).alias("null_share")))
    return first.orderBy(F.desc("null_share"), q(subject))


def null_share_per_group(df: DataFrame, group: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Per group, the mean over columns of each column's null share
    (the group key itself excluded)."""
    cols = [c for c in (cols or df.columns) if c != group]
    aggs = [F.avg(F.col(q(c)).isNull().cast("double")).alias(c) for c in cols]
    per_col = df.groupBy(q(group)).agg(*aggs)
    mean = sum((F.col(q(c)) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    return per_col.select(q(group), mean.alias("null_share"))


def value_counts(df: DataFrame, col: str, normalize: bool = False, dropna: bool = True,
                 sort: str = "count") -> DataFrame:
    """Counts (and share) per value; NULL included when ``dropna=False``.
    The share is divided by a one-row total joined on a constant, not a
    global window."""
    src = df if not dropna else df.filter(F.col(q(col)).isNotNull())
    counts = src.groupBy(q(col)).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = src.agg(F.count(F.lit(1)).alias("_total"))
        counts = (counts.withColumn("_one", F.lit(1))
                  .join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
                  .select(q(col), "count", (F.col("count") / F.col("_total")).alias("share")))
    order = [F.desc("count"), F.col(q(col)).asc_nulls_last()] if sort == "count" else [F.col(q(col)).asc_nulls_last()]
    return counts.orderBy(*order)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, normalize: bool = False) -> DataFrame:
    """Contingency counts with a fixed column order (missing -> 0);
    ``normalize`` divides each row by its total."""
    values = list(values)
    pt = df.groupBy(q(row)).pivot(col, values).count().na.fill(0, subset=[str(v) for v in values])
    names = [str(v) for v in values]
    if normalize:
        tot = sum((F.col(q(n)) for n in names), F.lit(0))
        pt = pt.select(q(row), *[F.when(tot > 0, F.col(q(n)) / tot).otherwise(F.lit(0.0)).alias(n) for n in names])
    return pt


def group_median(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Exact median per group over several columns (NULL without values)."""
    from .ranks import exact_quantiles, join_groups
    long = df.select(q(group), *[F.col(q(c)).cast("double").alias(c) for c in cols]).unpivot([group], list(cols), "_column", "_value")
    med = exact_quantiles(long, "_value", [0.5], [group, "_column"])
    wide = med.groupBy(q(group)).agg(*[F.max(F.when(F.col("_column") == c, F.col("_p")[0])).alias(c) for c in cols])
    return join_groups(df.select(q(group)).distinct(), wide, [group], "left")


def visits_per_subject(df: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """A10: (histogram: visits -> subjects, summary: count/mean/min/max)."""
    per = df.groupBy(q(subject)).agg(F.count(F.lit(1)).alias("visits"))
    hist = per.groupBy("visits").agg(F.count(F.lit(1)).alias("subjects"))
    summary = per.agg(F.count(F.lit(1)).alias("subjects"), F.avg("visits").alias("mean_visits"),
                      F.stddev_samp("visits").alias("std_visits"), F.min("visits").alias("min_visits"),
                      F.max("visits").alias("max_visits"))
    return hist, summary


def filtered_value_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of ``b`` within each ``a``."""
    return df.groupBy(q(a), q(b)).agg(F.count(F.lit(1)).alias("count"))


def column_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def complete_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, vx, vy, n): distinct value pairs of each pair of columns with their counts, over the rows that have both
    (NULL and NaN are missing). One scan, whatever the number of pairs."""
    value = {c: nan_to_null(F.col(q(c)).cast("double")) for c in cols}
    each = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value[a].alias("vx"), value[b].alias("vy")) for a, b in column_pairs(cols)])
    rows = df.select(F.explode(each).alias("p")).select("p.*").filter(F.col("vx").isNotNull() & F.col("vy").isNotNull())
    return rows.groupBy("x", "y", "vx", "vy").agg(F.count(F.lit(1)).alias("n"))


def weighted_correlation(a: Column, b: Column, n: Column) -> Column:
    """Pearson's correlation of rows that stand ``n`` times each; NULL if one side does not vary."""
    total, sa, sb = F.sum(n), F.sum(n * a), F.sum(n * b)
    va, vb = total * F.sum(n * a * a) - sa * sa, total * F.sum(n * b * b) - sb * sb
    return F.when((va > 0) & (vb > 0), (total * F.sum(n * a * b) - sa * sb) / (F.sqrt(va) * F.sqrt(vb)))


def spearman(pairs: DataFrame) -> DataFrame:
    """(x, y, corr) from ``complete_pairs``: Pearson's correlation of tie-averaged ranks. Ranks are centred at the middle
    rank, so that sums of squares keep their digits."""
    from .ranks import join_groups, value_ranks
    size = pairs.groupBy("x", "y").agg(((F.sum("n") + 1) / 2.0).alias("middle"))
    rx = value_ranks(pairs, "vx", ["x", "y"], "rx", weight="n").drop("n")
    ry = value_ranks(pairs, "vy", ["x", "y"], "ry", weight="n").drop("n")
    ranked = join_groups(join_groups(join_groups(pairs, rx, ["x", "y", "vx"]), ry, ["x", "y", "vy"]), size, ["x", "y"])
    a, b = F.col("rx") - F.col("middle"), F.col("ry") - F.col("middle")
    return ranked.groupBy("x", "y").agg(weighted_correlation(a, b, F.col("n").cast("double")).alias("corr"))


def discordant_pairs(pairs: DataFrame) -> DataFrame:
    """(x, y, discordant): pairs of rows that the two columns order oppositely, counted without pairing rows.

    Each vy becomes its dense rank; two ranks differ first at one of their binary digits, so an opposite pair shares a prefix
    of digits, and then the row with the smaller vx has a 1 where the other has a 0. At each digit, within equal prefixes,
    the rows with a 1 and a smaller vx are cumulated (``cumulative_below``: range buckets and their totals, so a prefix
    that all rows share is no single task's work). There are log2(distinct values) rows for each distinct value pair.
    """
    from .ranks import cumulative_below, join_groups
    ys = pairs.groupBy("x", "y", "vy").agg(F.lit(1).cast("long").alias("one"))
    ranked = cut_lineage(join_groups(pairs, cumulative_below(ys, "vy", ["x", "y"], ["one"]).select("x", "y", "vy", F.col("below_one").cast("long").alias("code")), ["x", "y", "vy"]))
    most = ranked.agg(F.max("code").alias("m")).first()["m"] or 0
    digits = ranked.select("x", "y", "vx", "n", "code", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(most).bit_length() - 1)))).alias("digit"))
    bit = F.expr("shiftright(code, digit) & 1")
    grouped = digits.groupBy("x", "y", "digit", F.expr("shiftright(code, digit + 1)").alias("prefix"), "vx").agg(
        F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("zeros"))
    # A prefix of rows with one digit only has no pair that differs here.
    mixed = grouped.groupBy("x", "y", "digit", "prefix").agg(F.sum("ones").alias("o"), F.sum("zeros").alias("z")).filter("o > 0 AND z > 0").select("x", "y", "digit", "prefix")
    both = cut_lineage(grouped.join(mixed, ["x", "y", "digit", "prefix"]))
    below = cumulative_below(both, "vx", ["x", "y", "digit", "prefix"], ["ones"])
    return below.groupBy("x", "y").agg(F.sum((F.col("zeros") * F.col("below_ones")).cast("decimal(38,0)")).alias("discordant"))


def kendall(pairs: DataFrame) -> DataFrame:
    """(x, y, corr) from ``complete_pairs``: Kendall's tau-b, (concordant - discordant) / sqrt((all - ties in x) * (all - ties
    in y)), exact with ties; NULL if one side does not vary."""
    couples = lambda n: (F.sum(n.cast("decimal(38,0)") * (n - 1)) / 2)
    ties = None
    for name, keys in (("tx", ["vx"]), ("ty", ["vy"]), ("txy", ["vx", "vy"]), ("all", [])):
        own = pairs.groupBy("x", "y", *keys).agg(F.sum("n").alias("n")).groupBy("x", "y").agg(couples(F.col("n")).cast("double").alias(name))
        ties = own if ties is None else ties.join(own, ["x", "y"])
    counted = ties.join(discordant_pairs(pairs), ["x", "y"], "left").withColumn("d", F.coalesce(F.col("discordant").cast("double"), F.lit(0.0)))
    concordant = F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    scale = F.sqrt(F.col("all") - F.col("tx")) * F.sqrt(F.col("all") - F.col("ty"))
    return counted.select("x", "y", F.when(scale > 0, (concordant - F.col("d")) / scale).alias("corr"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long-form (x, y, corr) for every column pair, pairwise complete.

    Pearson: all pairs in one aggregate (``corr`` skips rows where either side is NULL). Spearman and Kendall (tau-b) read
    the table once for all pairs and go on with distinct value pairs and their counts; a pair without complete rows
    has no row then.
    """
    cols = list(cols)
    if method == "pearson":
        pairs = column_pairs(cols)
        row_aggs = [F.corr(F.col(q(a)).cast("double"), F.col(q(b)).cast("double")).alias(f"{i}") for i, (a, b) in
                    enumerate(pairs)]
        one = df.agg(*row_aggs)
        stack = one.unpivot([], [f"{i}" for i in range(len(pairs))], "pair", "corr")
        names = df.sparkSession.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)],
                                                "pair string, x string, y string")
        return stack.join(F.broadcast(names), "pair").select("x", "y", "corr")
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unsupported method {method!r}")
    pairs = cut_lineage(complete_pairs(df, cols))
    return spearman(pairs) if method == "spearman" else kendall(pairs)


def impute_mean_by_class(df: DataFrame, cols: Sequence[str], class_col: str) -> DataFrame:
    """NULL <- class mean; class mean NULL -> global mean; rows with
    a NULL class stay untouched; non-numeric columns are skipped. Filled
    columns are doubles, as a mean of whole numbers need not be one.

    Class means are an aggregate (map-side combined, skew-safe) joined back;
    the global means are one bounded row, inlined as literals.
    """
    from ..functions.recode import is_numeric_type
    cols = [c for c in cols if c in df.columns and is_numeric_type(df.schema[c].dataType)]
    if not cols:
        return df
    means = df.groupBy(q(class_col)).agg(*[F.avg(q(c)).alias(f"_m_{i}") for i, c in enumerate(cols)])
    glob = df.agg(*[F.avg(q(c)).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    means = means.filter(F.col(q(class_col)).isNotNull()).withColumnRenamed(class_col, "_cls")
    joined = join_small(df, means, df[q(class_col)].eqNullSafe(means["_cls"]), "left")
    rep = {}
    for i, c in enumerate(cols):
        fill = F.coalesce(F.col(f"_m_{i}"), F.lit(glob[f"g{i}"]))
        rep[c] = F.when(F.col(q(class_col)).isNotNull(), F.coalesce(F.col(q(c)).cast("double"), fill)
                        ).otherwise(F.col(q(c)).cast("double"))
    return joined.select(*[rep[c].alias(c) if c in rep else F.col(q(c)) for c in df.columns])


def drop_duplicate_rows(df: DataFrame, exclude: Sequence[str] = ("row_id",)) -> DataFrame:
    """Remove exact duplicates over all columns but ``exclude``; the
    first kept row is the one with the lowest excluded id when present."""
    cols = [c for c in df.columns if c not in exclude]
    ids = [c for c in exclude if c in df.columns]
    if ids:
        return (df.groupBy(*[q(c) for c in cols]).agg(*[F.min(q(c)).alias(c) for c in ids])
                .select(*[q(c) for c in df.columns]))
    return df.dropDuplicates(cols)


def pivot_metric(df: DataFrame, index: str, columns: str, values: str, order: Sequence) -> DataFrame:
    """Index x columns matrix of one value; missing -> NULL."""
    return df.groupBy(q(index)).pivot(columns, list(order)).agg(F.first(F.col(q(values))))


def year_counts(df: DataFrame, date_col: str) -> DataFrame:
    """A17 (with C14)."""
    from ..functions.recode import parse_date
    return (df.select(F.year(parse_date(F.col(q(date_col)))).alias("year"))
            .groupBy("year").agg(F.count(F.lit(1)).alias("count")))


def class_distribution(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Count and % per class in a fixed order; absent classes -> 0."""
    counts = value_counts(df, col, normalize=True)
    spine = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{col} string, position int")
    return (spine.join(counts, col, "left")
            .select("position", q(col), F.coalesce("count", F.lit(0)).alias("count"),
                    (F.coalesce("share", F.lit(0.0)) * 100.0).alias("pct"))
            .orderBy("position"))


# ---------------------------------------------------------------- sort / limit / set

def sort_values(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """L1: order with NULLs last in both directions (pandas)."""
    asc = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(*[F.col(q(c)).asc_nulls_last() if a else F.col(q(c)).desc_nulls_last()
                        for c, a in zip(by, asc)])


def head_n(df: DataFrame, by: Sequence[str], n: int, ascending: bool = False) -> DataFrame:
    """L2: top n by a sort key (TakeOrderedAndProject; the limit is the feature)."""
    return sort_values(df, by, ascending).limit(n)


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """L3: seeded full shuffle = global sort on md5(seed:key) (range-partitioned)."""
    return df.orderBy(seeded_hash(seed, F.col(q(key))), q(key))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """L4: seeded sample of up to n rows (a sampling operator: the limit is the feature)."""
    return df.orderBy(seeded_hash(seed, F.col(q(key))), q(key)).limit(n)


def union_rows(*dfs: DataFrame) -> DataFrame:
    """Concatenate by column name; absent columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def col(c: str) -> Column:
    return F.col(q(c))
