"""Scalable ranks.

A plain ``rank() OVER (PARTITION BY g ORDER BY v)`` sorts each whole group in
one task: a group holding a third of the data becomes one straggler, and a
rank with no PARTITION BY pulls everything into one task. Both primitives
here split the order into range buckets:

1. collapse to a small table (distinct values with counts, or bucket counts),
2. cumulate bucket sizes per group (a window over buckets, not rows),
3. rank inside each (group, bucket) and add the bucket's offset.

The final row-level work is a join / a bucket-local window, so every task
holds at most one bucket.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import seeded_hash
from .select import q


def _cols(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def join_groups(big: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per group back; a NULL group is a group like any other."""
    renamed = small.withColumnsRenamed({b: f"_group_{i}" for i, b in enumerate(by)})
    on = [F.col(q(b)).eqNullSafe(F.col(f"_group_{i}")) for i, b in enumerate(by)]
    return big.join(renamed, on, how).drop(*[f"_group_{i}" for i in range(len(by))])


# Distinct values that one task numbers at once, and the most buckets a group is cut into (larger groups get larger
# buckets).
BUCKET_VALUES, MAX_BUCKETS = 50_000, 4_096


def sized_buckets(distinct: DataFrame, by: Sequence[str]) -> int:
    """Buckets for the largest group of a table with a row per distinct (by, value)."""
    n = distinct.groupBy(*[q(b) for b in by]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return max(1, min(MAX_BUCKETS, -(-n // BUCKET_VALUES)))


def cumulative_below(distinct: DataFrame, value: str, by: Sequence[str] | str, weights: Sequence[str],
                     buckets: int | None = None, accuracy: int = 10_000) -> DataFrame:
    """For a table with one row per distinct (by, value), add ``below_<w>``:
    the sum of each weight column over strictly smaller values in the group.

    The order is split into range buckets at approximate quantiles of the
    distinct values; bucket totals are cumulated over buckets (a window over
    at most ``buckets`` rows per group) and rows are cumulated inside their
    bucket, so no task ever holds a whole large group. The number of buckets
    follows the largest group's distinct values unless given.
    """
    by = _cols(by)
    v = F.col(q(value))
    if buckets is None:
        buckets = sized_buckets(distinct, by)
    if buckets == 1:
        w_all = Window.partitionBy(*[q(b) for b in by]).orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
        return distinct.select(*[F.col(q(c)) for c in distinct.columns], *[
            F.coalesce(F.sum(q(w)).over(w_all), F.lit(0)).alias(f"below_{w}") for w in weights])
    accuracy = max(accuracy, 10 * buckets)
    probs = [i / buckets for i in range(1, buckets)]
    if by:
        bounds = distinct.groupBy(*[q(b) for b in by]).agg(F.percentile_approx(v, probs, accuracy).alias("_bounds"))
        d = join_groups(distinct, bounds, by)  # one bounds row per group
    else:
        row = distinct.agg(F.percentile_approx(v, probs, accuracy).alias("b")).first()  # one bounded row
        d = distinct.withColumn("_bounds", F.array(*[F.lit(x) for x in (row["b"] or [])]).cast(
            distinct.schema[value].dataType.simpleString().join(["array<", ">"])))
    d = d.withColumn("_bk", F.size(F.filter("_bounds", lambda b: b < v))).drop("_bounds")
    per_bucket = d.groupBy(*[q(b) for b in by], "_bk").agg(*[F.sum(q(w)).alias(f"_bs_{i}") for i, w in enumerate(weights)])
    w_off = Window.partitionBy(*[q(b) for b in by]).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*[q(b) for b in by], "_bk", *[
        F.coalesce(F.sum(f"_bs_{i}").over(w_off), F.lit(0)).alias(f"_off_{i}") for i in range(len(weights))])
    w_in = Window.partitionBy(*[q(b) for b in by], "_bk").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    out = join_groups(d, per_bucket, by + ["_bk"])
    return out.select(*[F.col(q(c)) for c in distinct.columns], *[
        (F.col(f"_off_{i}") + F.coalesce(F.sum(q(w)).over(w_in), F.lit(0))).alias(f"below_{w}")
        for i, w in enumerate(weights)])


def _rank_distinct(distinct: DataFrame, value: str, by: list[str], out: str, buckets: int | None,
                   accuracy: int) -> DataFrame:
    """(by, value, n) with distinct (by, value) -> adds the tie-averaged rank."""
    c = cumulative_below(distinct, value, by, ["n"], buckets, accuracy)
    return c.select(*[q(b) for b in by], q(value), "n", (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(out))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] | str = (), out: str = "rank",
                buckets: int | None = None, accuracy: int = 10_000, weight: str | None = None) -> DataFrame:
    """Distinct (by, value) table with count ``n`` and tie-averaged rank:
    what rank-sum statistics need, without going back to row level.
    ``weight`` names a count column when ``df`` is already aggregated."""
    by = _cols(by)
    v = F.col(q(value))
    n = F.sum(q(weight)) if weight else F.count(F.lit(1))
    distinct = df.filter(v.isNotNull()).groupBy(*[q(b) for b in by], q(value)).agg(n.cast("long").alias("n"))
    return _rank_distinct(distinct, value, by, out, buckets, accuracy)


def average_rank(df: DataFrame, value: str, by: Sequence[str] | str = (), out: str = "rank",
                 buckets: int | None = None, accuracy: int = 10_000) -> DataFrame:
    """1-based rank of ``value`` within ``by`` with ties averaged, as a
    new column. NULL values get a NULL rank and do not count."""
    by = _cols(by)
    ranked = value_ranks(df, value, by, out, buckets, accuracy).drop("n")
    return join_groups(df, ranked, by + [value], "left")


def seeded_rank(df: DataFrame, seed, key: Sequence[str] | str, by: Sequence[str] | str = (),
                out: str = "rank", prefix_hex: int = 4, extra_keys: Sequence = ()) -> DataFrame:
    """1-based row number within ``by`` in the order md5('seed:key').

    md5 is uniform, so its leading hex digits are equal-width range buckets:
    counts per (group, bucket) give offsets, and each task numbers one bucket.
    The order equals ``row_number() OVER (PARTITION BY by ORDER BY md5(...))``;
    rows whose group is NULL are numbered as one group.
    """
    by = _cols(by)
    keys = _cols(key)
    h = seeded_hash(seed, *extra_keys, *[F.col(q(k)) for k in keys])
    x = df.withColumn("_h", h).withColumn("_bk", F.substring("_h", 1, prefix_hex))
    counts = x.groupBy(*[q(b) for b in by], "_bk").agg(F.count(F.lit(1)).alias("_bn"))
    w_off = Window.partitionBy(*[q(b) for b in by]).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(w_off), F.lit(0))).drop("_bn")
    w_in = Window.partitionBy(*[q(b) for b in by], "_bk").orderBy("_h", *[q(k) for k in keys])
    return (join_groups(x, offsets, by + ["_bk"])
            .withColumn(out, (F.col("_off") + F.row_number().over(w_in)).cast("long"))
            .drop("_h", "_bk", "_off"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] | str = (), out: str = "_p") -> DataFrame:
    """(by..., ``out``): exact quantiles with linear interpolation per group,
    as an array in the order of ``probs``; NULL values do not count, a group
    without values has no row (without ``by`` the one row holds NULLs then).

    Order statistics come from cumulated counts of distinct values, so the
    state of a task is one bucket, not the values of a column. Only the rows
    that hold a wanted position reach the last aggregate.
    """
    by = _cols(by)
    v = F.col(q(value)).cast("double")
    distinct = df.select(*[q(b) for b in by], v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*[q(b) for b in by], "_v").agg(
        F.count(F.lit(1)).alias("n"))
    total = distinct.groupBy(*[q(b) for b in by]).agg(F.sum("n").alias("_total"))
    below = cumulative_below(distinct, "_v", by, ["n"])
    placed = join_groups(below, total, by) if by else below.crossJoin(F.broadcast(total))  # one row
    lo, hi, last = F.col("below_n"), F.col("below_n") + F.col("n") - 1, (F.col("_total") - 1).cast("double")

    def at(position):
        return F.max(F.when((lo <= position) & (position <= hi), F.col("_v")))

    wanted = functools.reduce(lambda a, b: a | b, [(lo <= F.ceil(last * p)) & (hi >= F.floor(last * p)) for p in probs])
    ends = placed.filter(wanted).groupBy(*[q(b) for b in by]).agg(F.max(last).alias("_last"), *[
        x for i, p in enumerate(probs) for x in (at(F.floor(last * p)).alias(f"_lo{i}"), at(F.ceil(last * p)).alias(f"_hi{i}"))])

    def between(i, p):
        share = F.col("_last") * p - F.floor(F.col("_last") * p)
        return F.col(f"_lo{i}") + share * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))

    return ends.select(*[q(b) for b in by], F.array(*[between(i, p) for i, p in enumerate(probs)]).alias(out))
