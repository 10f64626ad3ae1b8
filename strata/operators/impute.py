"""Imputation (SURVEY 2.9: I1, I2, I3; I4 = profile.impute_mean_by_class,
I5 = recode.fill_null_constant, I6 = score.fill_label_by_vote).

I1, k-NN imputation with the null-aware Euclidean distance
d(r, x) = sqrt(D / m * sum over the m co-present columns of (r_i - x_i)^2),
on columns standardised with the donors' mean and population std. That
distance is not a metric across missing patterns, so it is split into
pattern pairs: for receivers with missing set Mr and donors with missing set
Md, the distance is Euclidean on S = present(Mr) & present(Md) scaled by
sqrt(D/|S|), and the exact tile index (``neighbours``) applies. Each
pair contributes its own top-k; the global top-k per (row, column) is inside
their union, so the result is exact. Patterns are few in practice; a table
with more distinct patterns than ``max_patterns`` is refused rather than
truncated.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import fit_z_score
from .graph import saved
from .neighbours import NeighbourIndex, tie_key
from .ranks import exact_quantiles
from .select import q


#: Pattern pairs whose searches the driver submits at once.
PAIRS_AT_ONCE = 4


def _pattern(cols: Sequence[str]):
    return F.concat(*[F.when(F.col(q(c)).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])


def knn_impute(df: DataFrame, key: str, cols: Sequence[str], k: int = 5, donors: DataFrame | None = None,
               max_patterns: int = 256, **index_kw) -> DataFrame:
    """Fill NULL cells of ``cols`` with the mean of that column over the
    k nearest donors that have it (null-aware distance on standardised
    columns, ties by donor key). No donor -> the donors' column mean.
    ``donors`` defaults to ``df`` itself (fit and transform on one table)."""
    cols = list(cols)
    D = len(cols)
    donors = df if donors is None else donors
    stats = fit_z_score(donors, cols)  # mean, population std (0 -> 1)
    z = {c: (F.col(q(c)).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in cols}
    rec = df.select(F.col(q(key)).alias("_k"), *[z[c].alias(f"_z{i}") for i, c in enumerate(cols)],
                    _pattern(cols).alias("_pat")).filter(F.col("_pat").contains("0"))
    don = donors.select(F.col(q(key)).alias("_dk"), *[z[c].alias(f"_z{i}") for i, c in enumerate(cols)],
                        *[F.col(q(c)).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
                        _pattern(cols).alias("_pat"))
    rpats = [r[0] for r in rec.select("_pat").distinct().limit(max_patterns + 1).collect()]
    dpats = [r[0] for r in don.select("_pat").distinct().limit(max_patterns + 1).collect()]
    if len(rpats) > max_patterns or len(dpats) > max_patterns:
        raise ValueError("too many missing-value patterns for exact k-NN imputation")
    rec, don = rec.cache(), don.cache()
    def nearest(pair: tuple[str, str]) -> DataFrame | None:
        rp, dp = pair
        useful = [i for i in range(D) if rp[i] == "0" and dp[i] == "1"]  # the donor pattern has a column the receiver lacks
        common = [i for i in range(D) if rp[i] == "1" and dp[i] == "1"]
        if not useful or not common:
            return None
        vec = F.array(*[F.col(f"_z{i}") for i in common])
        r_part = rec.filter(F.col("_pat") == rp).select(F.col("_k").alias("_key"), vec.alias("_vec"))
        d_part = don.filter(F.col("_pat") == dp).select(F.col("_dk").alias("_key"), vec.alias("_vec"))
        nn = NeighbourIndex(d_part, "_key", "_vec", **index_kw).knn(k, queries=r_part, exclude_self=False)
        scale = (D / len(common)) ** 0.5
        return saved(nn.select(F.col("key").alias("_k"), F.col("nbr").alias("_dk"), (F.col("dist") * scale).alias("_d"),
                               F.explode(F.array(*[F.lit(i) for i in useful])).alias("_c")))

    with ThreadPoolExecutor(max_workers=PAIRS_AT_ONCE) as pool:
        parts = [p for p in pool.map(nearest, [(rp, dp) for rp in rpats for dp in dpats]) if p is not None]
    cands = functools.reduce(DataFrame.unionByName, parts) if parts else None
    means = {i: stats[c][0] for i, c in enumerate(cols)}
    if cands is None:
        fills = None
    else:
        w = Window.partitionBy("_k", "_c").orderBy(tie_key(F.col("_d")), "_dk")
        top = cands.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
        vals = top.join(don.select("_dk", *[f"_x{i}" for i in range(D)]).hint("merge"), "_dk")
        pick = F.element_at(F.array(*[F.col(f"_x{i}") for i in range(D)]), F.col("_c") + 1)
        fills = (vals.groupBy("_k", "_c").agg(F.avg(pick).alias("_v"))
                 .groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_v"))).alias("_fill")))
    out = df if fills is None else df.join(fills.hint("merge"), df[q(key)] == fills["_k"], "left")
    rep = {}
    for i, c in enumerate(cols):
        got = F.try_element_at(F.col("_fill"), F.lit(i)) if fills is not None else F.lit(None)
        rep[c] = F.coalesce(F.col(q(c)).cast("double"), got, F.lit(means[i]))
    return out.select(*[rep[c].alias(c) if c in rep else df[q(c)] for c in df.columns])


def simple_impute(df: DataFrame, cols: Sequence[str], strategy: str | None = None) -> DataFrame:
    """I3: 'zero' fills 0, 'median' fills the exact column median, None
    drops rows with a NULL in ``cols``."""
    cols = list(cols)
    if strategy is None:
        return df.na.drop(subset=cols)
    if strategy == "zero":
        return df.select(*[F.coalesce(F.col(q(c)), F.lit(0)).alias(c) if c in cols else F.col(q(c)) for c in df.columns])
    if strategy == "median":
        long = df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
        med = {r["column"]: r["_p"][0] for r in exact_quantiles(long, "value", [0.5], "column").collect()}  # a row a column
        return df.select(*[F.coalesce(F.col(q(c)), F.lit(med.get(c))).alias(c) if c in cols else F.col(q(c))
                           for c in df.columns])
    raise ValueError(f"unknown strategy {strategy!r}")


class Preprocessor:
    """Learn on the training table, apply to any table:
    k-NN imputation from the training donors -> integer rounding per column
    -> derived ratios -> drop raw / redundant columns -> canonical order
    (absent columns NULL) -> drop all-NULL columns."""

    def __init__(self, key: str, cols: Sequence[str], k: int = 5, int_rounding: dict | None = None,
                 ratios: Sequence[tuple[str, str, str]] = (), drop: Sequence[str] = (),
                 order: Sequence[str] | None = None):
        self.key, self.cols, self.k = key, list(cols), k
        self.int_rounding = dict(int_rounding or {})
        self.ratios, self.drop, self.order = list(ratios), list(drop), list(order) if order else None
        self.donors = None

    def fit(self, train: DataFrame) -> "Preprocessor":
        from .recode import detect_integer_like
        ints = detect_integer_like(train, self.cols)
        for c in ints:
            self.int_rounding.setdefault(c, "round")
        self.donors = train
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from ..functions.recode import float_to_int
        from .recode import derive_ratios
        from .select import reindex_columns
        out = knn_impute(df, self.key, self.cols, self.k, donors=self.donors)
        out = out.select(*[float_to_int(F.col(q(c)), self.int_rounding[c], None).cast("double").alias(c)
                           if c in self.int_rounding else F.col(q(c)) for c in out.columns])
        out = derive_ratios(out, self.ratios, drop_inputs=self.drop)
        if self.order:
            out = reindex_columns(out, [self.key] + [c for c in self.order if c != self.key])
        return out
