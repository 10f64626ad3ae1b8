"""Rank tests and redundancy checks.

The rank work is Spark: unpivot, distinct-value tables, bucketed average
ranks, group sums. Only the final per-test numbers (one row per column or
per model pair) go through a tiny pandas UDF for the p-value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import row_mean, row_sum
from ..functions.stats_math import chi2_sf_udf, wilcoxon_p_udf
from .ranks import value_ranks
from .select import q


def kruskal_wallis(df: DataFrame, cols: Sequence[str], group: str, with_p: bool = True) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H per column across the groups of
    ``group`` (NULL values dropped per column). Columns: column, h, dof, n
    [, p_value], most significant first."""
    long = (df.select(q(group), *[F.col(q(c)).cast("double").alias(c) for c in cols])
            .unpivot([group], list(cols), "column", "value").filter(F.col("value").isNotNull()))
    per = long.groupBy("column", q(group), "value").agg(F.count(F.lit(1)).alias("k"))
    ranks = value_ranks(per, "value", ["column"], "rank", weight="k")  # column, value, n (ties), rank
    ties = ranks.groupBy("column").agg(F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("tie"),
                                        F.sum("n").alias("N"))
    rs = (per.join(ranks.select("column", "value", "rank"), ["column", "value"])
          .groupBy("column", q(group)).agg(F.sum(F.col("rank") * F.col("k")).alias("R"), F.sum("k").alias("ng")))
    h = (rs.groupBy("column").agg(F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("s"),
                                  F.count(F.lit(1)).alias("groups"))
         .join(ties, "column"))
    N = F.col("N").cast("double")
    raw = F.lit(12.0) / (N * (N + 1)) * F.col("s") - 3 * (N + 1)
    corr = F.lit(1.0) - F.col("tie") / (N * N * N - N)
    out = h.select("column", F.when(corr > 0, raw / corr).alias("h"), (F.col("groups") - 1).alias("dof"),
                   F.col("N").alias("n"))
    if with_p:
        out = out.withColumn("p_value", chi2_sf_udf(F.col("h"), F.col("dof").cast("double")))
        out = out.orderBy(F.col("p_value").asc_nulls_last(), "column")
    return out


def wilcoxon_pairwise(scores: DataFrame, model: str = "model", block: str = "fold", value: str = "score",
                      with_p: bool = True) -> DataFrame:
    """Two-sided Wilcoxon signed-rank test for every pair of models on
    their paired scores (paired by ``block``). Zero differences are
    dropped; statistic = min(W+, W-); exact p for n <= 50 without ties,
    normal approximation otherwise.

    Pairs are formed by a self-join on the block id with model_a < model_b:
    its size is (models^2 / 2) x blocks, bounded by the experiment design,
    not by the data."""
    a = scores.select(F.col(q(block)).alias("_b"), F.col(q(model)).alias("model_a"), F.col(q(value)).alias("va"))
    b = scores.select(F.col(q(block)).alias("_b"), F.col(q(model)).alias("model_b"), F.col(q(value)).alias("vb"))
    d = (a.join(b, "_b").filter(F.col("model_a") < F.col("model_b"))
         .select("model_a", "model_b", (F.col("va") - F.col("vb")).alias("d"))
         .filter(F.col("d") != 0).withColumn("ad", F.abs("d")).withColumn("sgn", F.signum("d")))
    per = d.groupBy("model_a", "model_b", "ad").agg(F.count(F.lit(1)).alias("k"),
                                                    F.sum(F.when(F.col("sgn") > 0, 1).otherwise(0)).alias("kpos"))
    ranked = value_ranks(per, "ad", ["model_a", "model_b"], "rank", weight="k")
    j = per.join(ranked.select("model_a", "model_b", "ad", "rank"), ["model_a", "model_b", "ad"])
    out = j.groupBy("model_a", "model_b").agg(
        F.sum(F.col("rank") * F.col("kpos")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("k") - F.col("kpos"))).alias("w_minus"),
        F.sum("k").alias("n"),
        F.sum(F.pow(F.col("k"), 3) - F.col("k")).alias("tie_term"),
        F.max("k").alias("_maxk"))
    out = out.select("model_a", "model_b", "n", F.least("w_plus", "w_minus").alias("statistic"), "tie_term",
                     (F.col("_maxk") > 1).alias("has_ties"))
    if with_p:
        out = out.withColumn("p_value", wilcoxon_p_udf(F.col("n"), F.col("statistic"), F.col("tie_term"),
                                                       F.col("has_ties")))
        out = out.orderBy(F.col("p_value").asc_nulls_last(), "model_a", "model_b")
    return out


def linear_redundancy(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, dict]:
    """T4: OLS of ``y`` on ``xs`` (with intercept). One pass for the means,
    one for the centred cross-products (well conditioned); the p x p normal
    equations are solved on the driver. A last pass gives R^2, MSE (the
    figure the reference prints as 'RMSE'), RMSE, max |error| and % of rows
    within +-1."""
    xs = list(xs)
    yc = F.col(q(y)).cast("double")
    xc = [F.col(q(x)).cast("double") for x in xs]
    complete = df.filter(yc.isNotNull())
    for x in xs:
        complete = complete.filter(F.col(q(x)).isNotNull())
    m = complete.agg(F.avg(yc).alias("my"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(xc)]).first()
    my = m["my"] or 0.0
    mx = [m[f"m{i}"] or 0.0 for i in range(len(xs))]
    dx = [c - F.lit(mx[i]) for i, c in enumerate(xc)]
    dy = yc - F.lit(my)
    p = len(xs)
    aggs = [F.sum(dx[i] * dx[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(dx[i] * dy).alias(f"b{i}") for i in range(p)]
    r = complete.agg(*aggs).first()
    A = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            A[i, j] = A[j, i] = r[f"a{i}_{j}"] or 0.0
    bvec = np.array([r[f"b{i}"] or 0.0 for i in range(p)])
    beta = np.linalg.lstsq(A, bvec, rcond=None)[0] if p else np.zeros(0)
    intercept = my - float(sum(beta[i] * mx[i] for i in range(p)))
    fitted = F.lit(intercept) + sum((F.lit(float(beta[i])) * xc[i] for i in range(p)), F.lit(0.0))
    err = yc - fitted
    stats = complete.agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.max(F.abs(err)).alias("max_abs_error"),
        (F.avg((F.abs(err) <= 1).cast("double")) * 100).alias("pct_within_1"),
        F.var_pop(yc).alias("_vy"))
    stats = stats.select("n", (F.lit(1.0) - F.col("mse") / F.col("_vy")).alias("r2"), "mse",
                         F.sqrt("mse").alias("rmse"), "max_abs_error", "pct_within_1",
                         F.lit(intercept).alias("intercept"),
                         *[F.lit(float(beta[i])).alias(f"coef_{x}") for i, x in enumerate(xs)])
    return stats, {"intercept": intercept, **{x: float(beta[i]) for i, x in enumerate(xs)}}


def composite_check(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """T5: is ``total`` the sum or the mean of ``parts``? Max |difference|
    to each and the correlation of the total with each."""
    s, m = row_sum(parts), row_mean(parts)
    t = F.col(q(total)).cast("double")
    return df.agg(F.max(F.abs(t - s)).alias("max_abs_diff_sum"), F.max(F.abs(t - m)).alias("max_abs_diff_mean"),
                  F.corr(t, s).alias("corr_sum"), F.corr(t, m).alias("corr_mean"))


def digamma_int(n) -> "F.Column":
    """psi(n) for integer n >= 1 as a Column expression: exact harmonic sums
    below 8, the asymptotic series above (error < 1e-10)."""
    x = n.cast("double")
    euler = 0.5772156649015329
    small = None
    for m in range(7, 0, -1):
        val = -euler + sum(1.0 / j for j in range(1, m))
        small = F.when(x == m, F.lit(val)) if small is None else small.when(x == m, F.lit(val))
    inv = F.lit(1.0) / x
    inv2 = inv * inv
    big = F.log(x) - 0.5 * inv - inv2 * (F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 120) - inv2 * F.lit(1.0 / 252)))
    return small.otherwise(big)


def mutual_information(df: DataFrame, key: str, feature: str, label: str, k: int = 3) -> DataFrame:
    """Mutual information between a continuous feature and a class label
    (Ross 2014, the k-NN estimator): per point, the distance d_i to its k-th
    nearest neighbour of the same class (exact 1-D k-NN from the tile
    index, grouped by class), m_i = number of points with |x_j - x_i| < d_i
    (self included; points equal to x_i when d_i = 0; distances equal at 1e-9
    are ties, as in the neighbour index), then
    MI = psi(N) + <psi(k_i)> - <psi(N_class)> - <psi(m_i)>, floored at 0.
    Classes with one point are ignored. m_i comes from counts within a
    radius on the same kind of index (neighbourhoods of size ~ k x classes)."""
    from .neighbours import NeighbourIndex
    x = F.col(q(feature)).cast("double")
    d = df.select(F.col(q(key)).alias("_key"), x.alias("_x"), F.col(q(label)).alias("_y")).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    sizes = d.groupBy("_y").agg(F.count(F.lit(1)).alias("_nc"))
    d = d.join(sizes.filter(F.col("_nc") > 1), "_y")
    d = d.withColumn("_k", F.least(F.lit(k), F.col("_nc") - 1)).cache()
    idx = NeighbourIndex(d.select("_key", F.array("_x").alias("_v"), "_y"), "_key", "_v", group="_y")
    nn = idx.knn(k)
    kd = (nn.join(d.select(F.col("_key").alias("key"), "_k"), "key").filter(F.col("rank") == F.col("_k"))
          .select(F.col("key").alias("_key"), F.col("dist").alias("_r")))
    pts = d.join(kd, "_key")
    # m_i: each point's own radius r_i (within-class k-th distances keep
    # these neighbourhoods small), asked once for equal points and radii of
    # an index of all points; '<' is applied to tie keys, as in the index.
    allx = NeighbourIndex(d.select("_key", F.array("_x").alias("_v")), "_key", "_v")
    asked = (allx.points.join(kd.select(F.col("_key").alias("_k"), F.col("_r").alias("_ub")).hint("merge"), "_k")
             .join(kd.select(F.col("_key").alias("_k"), "_r").hint("merge"), "_k"))
    counts = (asked.join(allx.counts_within(asked).hint("merge"), ["_v", "_ub", "_r"])
              .groupBy(F.col("_k").alias("_key")).agg(F.sum("hits").alias("_m")))
    m = pts.join(counts, "_key")
    agg = m.agg(F.count(F.lit(1)).alias("n"), F.avg(digamma_int(F.col("_k"))).alias("pk"),
                F.avg(digamma_int(F.col("_nc"))).alias("pn"), F.avg(digamma_int(F.col("_m"))).alias("pm"))
    return agg.select(F.lit(feature).alias("feature"), "n",
                      F.greatest(F.lit(0.0), digamma_int(F.col("n")) + F.col("pk") - F.col("pn") - F.col("pm"))
                      .alias("mi"))
