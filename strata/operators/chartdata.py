"""The tables behind the reference's charts.

Drawing is out of scope; each function returns the aggregated, bounded
table a plotting library would draw. Nothing here grows with the data
except the scans: every output is bounded by bins x groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_quantiles
from .select import q


def _range(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    r = df.agg(F.min(F.col(q(col)).cast("double")).alias("lo"), F.max(F.col(q(col)).cast("double")).alias("hi")).first()
    return r["lo"], r["hi"]


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1 over [lo, hi]; the last bin is closed."""
    width = (hi - lo) if hi > lo else 1.0
    i = F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(bins)).cast("int")
    return F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1))


def _attach(rows: DataFrame, stats: DataFrame, by: str | None) -> DataFrame:
    """Attach per-group statistics: joined on the group key behind a size
    check, or, with no group, inlined from the single bounded stats row."""
    if by:
        from .joins import join_small
        return join_small(rows, stats, [by], "inner")
    r = stats.first()
    if r is None:
        return rows.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in stats.schema.fields])
    return rows.select("*", *[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in stats.schema.fields])


def histogram_data(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """(by?, bin, left, right, count)."""
    lo, hi = _range(df, col)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, count long")
    x = F.col(q(col)).cast("double")
    width = (hi - lo) / bins if hi > lo else 1.0 / bins
    keys = ([q(by)] if by else [])
    return (df.filter(x.isNotNull()).select(*keys, bin_index(x, lo, hi, bins).alias("bin"))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("left", F.lit(lo) + F.col("bin") * F.lit(width))
            .withColumn("right", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def kde_data(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, prebins: int = 2048,
             by: str | None = None) -> DataFrame:
    """Gaussian KDE on ``grid`` points, Scott bandwidth (sample std *
    n^-1/5), grid from min - cut*h to max + cut*h.

    The data are first reduced to ``prebins`` weighted bin centres (one
    aggregate), so the grid x data work is bounded by grid x prebins and
    does not grow with the rows (binned KDE)."""
    x = F.col(q(col)).cast("double")
    keys = [q(by)] if by else []
    st = df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    st = st.filter(F.col("h") > 0)
    j = _attach(df.filter(x.isNotNull()).select(*keys, x.alias("_x")), st, by)
    width = (F.col("hi") - F.col("lo")) / F.lit(prebins)
    b = F.least(F.floor((F.col("_x") - F.col("lo")) / F.when(width > 0, width).otherwise(F.lit(1.0))), F.lit(prebins - 1))
    centers = (j.withColumn("_b", b).groupBy(*keys, "_b", "n", "h", "lo", "hi")
               .agg(F.count(F.lit(1)).alias("w"), F.avg("_x").alias("c")))
    g = centers.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    g0 = F.col("lo") - F.lit(cut) * F.col("h")
    g1 = F.col("hi") + F.lit(cut) * F.col("h")
    gx = g0 + (g1 - g0) * F.col("gi") / F.lit(grid - 1)
    z = (gx - F.col("c")) / F.col("h")
    dens = F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return (g.select(*keys, "gi", gx.alias("x"), dens.alias("d"))
            .groupBy(*keys, "gi", "x").agg(F.sum("d").alias("density")).drop("gi"))


def box_stats(df: DataFrame, col: str, by: str | None = None, whis: float = 1.5) -> DataFrame:
    """D3: q1, median, q3, whiskers (furthest data inside whis*IQR) and the
    outlier count, optionally per group."""
    x = F.col(q(col)).cast("double")
    keys = [q(by)] if by else []
    qs = exact_quantiles(df, col, [0.25, 0.5, 0.75], [by] if by else [])
    qs = qs.select(*keys, F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3"))
    qs = (qs.withColumn("_lo", F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1")))
          .withColumn("_hi", F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))))
    j = _attach(df.filter(x.isNotNull()).select(*keys, x.alias("_x")), qs, by)
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))


def bar_data(df: DataFrame, x: str, y: str, estimator=F.avg, hue: str | None = None) -> DataFrame:
    """estimator(y) and std per category (any aggregate Column function)."""
    keys = [q(x)] + ([q(hue)] if hue else [])
    return df.groupBy(*keys).agg(estimator(F.col(q(y))).alias("value"), F.stddev_samp(F.col(q(y))).alias("std"),
                                 F.count(F.col(q(y))).alias("n"))


def count_data(df: DataFrame, x: str, hue: str | None = None) -> DataFrame:
    """D5."""
    keys = [q(x)] + ([q(hue)] if hue else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def pie_data(df: DataFrame, x: str) -> DataFrame:
    """Counts and shares; the total is one row, joined to the categories."""
    c = count_data(df, x)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return c.crossJoin(F.broadcast(total)).select(q(x), "count", (F.col("count") / F.col("_total")).alias("share"))  # one row


def heatmap_data(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """(x, y, corr) for every cell of the matrix: both triangles, and 1 on the diagonal (NULL for a column without
    two different values)."""
    from .profile import correlation_matrix
    upper = correlation_matrix(df, cols, method)
    varies = df.agg(*[(F.min(q(c)) < F.max(q(c))).alias(f"{i}") for i, c in enumerate(cols)])
    own = varies.select(F.explode(F.array(*[F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.when(F.col(f"`{i}`"), F.lit(1.0)).alias("corr")) for i, c in enumerate(cols)])).alias("d")).select("d.*")
    both = upper.select(F.explode(F.array(F.struct("x", "y", "corr"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "corr"))).alias("d")).select("d.*")
    return both.unionByName(own)


def hexbin_data(df: DataFrame, x: str, y: str, gridsize: int = 30, hexagonal: bool = True) -> DataFrame:
    """2-D bin counts. Hexagonal cells follow the usual two offset
    lattices (nearest centre wins); ``hexagonal=False`` gives square cells."""
    (xlo, xhi), (ylo, yhi) = _range(df, x), _range(df, y)
    xs = F.col(q(x)).cast("double")
    ys = F.col(q(y)).cast("double")
    base = df.filter(xs.isNotNull() & ys.isNotNull())
    if not hexagonal:
        return (base.select(bin_index(xs, xlo, xhi, gridsize).alias("ix"), bin_index(ys, ylo, yhi, gridsize).alias("iy"))
                .groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("count")))
    nx = gridsize
    ny = max(1, int(nx / math.sqrt(3)))
    sx = (xhi - xlo) / nx if xhi > xlo else 1.0
    sy = (yhi - ylo) / ny if yhi > ylo else 1.0
    px = (xs - F.lit(xlo)) / F.lit(sx)
    py = (ys - F.lit(ylo)) / F.lit(sy)
    i1, j1 = F.floor(px + 0.5), F.floor(py + 0.5)
    i2, j2 = F.floor(px), F.floor(py)
    d1 = (px - i1) * (px - i1) + 3.0 * (py - j1) * (py - j1)
    d2 = (px - i2 - 0.5) * (px - i2 - 0.5) + 3.0 * (py - j2 - 0.5) * (py - j2 - 0.5)
    first = d1 < d2
    return (base.select(first.alias("lattice1"), F.when(first, i1).otherwise(i2).cast("int").alias("ix"),
                        F.when(first, j1).otherwise(j2).cast("int").alias("iy"))
            .groupBy("lattice1", "ix", "iy").agg(F.count(F.lit(1)).alias("count")))


def series_data(df: DataFrame, x: str, y: str, hue: str | None = None, stacked: bool = False) -> DataFrame:
    """Mean y per (x, hue); ``stacked`` adds the running total across
    hues at each x (partitioned by x, so no single-task window)."""
    keys = [q(x)] + ([q(hue)] if hue else [])
    out = df.groupBy(*keys).agg(F.avg(F.col(q(y))).alias("mean"))
    if stacked and hue:
        w = Window.partitionBy(q(x)).orderBy(q(hue)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("stacked", F.sum("mean").over(w))
    return out


def fold_distribution(scores: DataFrame, model: str = "model", value: str = "accuracy") -> DataFrame:
    """Quartiles of per-fold scores per model."""
    v = F.col(q(value)).cast("double")
    return scores.groupBy(q(model)).agg(
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count(v).alias("n")).select(
        q(model), "n", "min", F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3"),
        "max")


def point_sample(df: DataFrame, key: str, cols: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Bounded seeded sample of points for scatter / pair plots."""
    from .profile import sample_n
    return sample_n(df.select(q(key), *[q(c) for c in cols]), key, n, seed)
