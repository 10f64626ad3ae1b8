"""Contributions of features to predictions, and local linear surrogates.

A scorer is anything with ``classes`` and ``transform(df)``, which adds ``probs`` (one number a class) to rows that hold the
features: a fitted classifier, or ``LinearScorer``. One that also has ``scores(matrix)`` can score
them where they are made. Rows to explain are turned into many artificial rows in the tasks that
hold them; those are scored in one batch, and summed up in the tasks again, so that a few numbers a row are shuffled.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import seeded_hash
from .select import q

#: Background rows at most (they come to the driver and go to all tasks), perturbed rows, and features that are reported.
BACKGROUND, SAMPLES, TOP = 100, 5000, 35
#: Artificial rows that a task makes at once.
AT_ONCE = 8192


@dataclass
class LinearScorer:
    """Scores that are linear in the features: intercept + sum of weight * value for each class."""

    features: list[str]
    classes: list[str]
    weights: list[list[float]]
    intercepts: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (rows, classes) of a matrix of features, as ``transform`` has them in ``probs``."""
        return x @ np.asarray(self.weights, dtype=float).reshape(len(self.classes), len(self.features)).T + np.asarray(self.intercepts, dtype=float)

    def transform(self, df: DataFrame) -> DataFrame:
        x = [F.col(q(c)).cast("double") for c in self.features]
        score = [functools.reduce(lambda s, t: s + t, [c * F.lit(float(v)) for c, v in zip(x, w)], F.lit(float(b))) for w, b in zip(self.weights, self.intercepts)]
        out = df.withColumn("probs", F.array(*score))
        return out.withColumn("pred", F.array(*[F.lit(c) for c in self.classes])[F.array_position("probs", F.array_max("probs")) - 1])


def mean_difference_scorer(df: DataFrame, features: Sequence[str], label: str) -> LinearScorer:
    """A linear scorer by one aggregate: the weight of a feature for a class is the class's mean less the mean of all rows,
    and a class's score is 0 half-way between the two."""
    own = df.where(F.col(q(label)).isNotNull())
    means = {r[label]: r for r in own.groupBy(F.col(q(label)).cast("string").alias(label)).agg(*[F.avg(q(c)).alias(c) for c in features]).collect()}  # one row a class
    whole = own.agg(*[F.avg(q(c)).alias(c) for c in features]).first()
    classes = sorted(means)
    weights = [[means[c][f] - whole[f] for f in features] for c in classes]
    return LinearScorer(list(features), classes, weights, [-sum(w * (means[c][f] + whole[f]) / 2 for w, f in zip(ws, features)) for c, ws in zip(classes, weights)])


def background_rows(df: DataFrame, key: str, features: Sequence[str], n: int = BACKGROUND, seed: int = 42) -> np.ndarray:
    """The first ``n`` rows in md5 order of ``seed:key`` (all, if fewer), as a matrix; NULLs are NaN."""
    rows = df.orderBy(seeded_hash(seed, F.col(q(key)))).limit(n).select(*[F.col(q(c)).cast("double") for c in features]).toArrow()
    return np.stack([c.to_numpy() for c in rows.columns], axis=1) if rows.num_rows else np.empty((0, len(features)))


def matrix_of(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """Columns ``first`` .. ``first + n`` of doubles as a matrix; NULLs are NaN."""
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)], axis=1) if n else np.empty((batch.num_rows, 0))


def feature_orders(n_background: int, orders: int, n_features: int, seed: int) -> np.ndarray:
    """(background * orders, features): a random order of the features for each pair of a background row and a number; every
    second one is the reverse of the one before, which takes much of the sampling error away."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_background):
        for i in range(orders):
            out.append(out[-1][::-1] if i % 2 else rng.permutation(n_features))
    return np.array(out, dtype=np.int64).reshape(n_background * orders, n_features)


def shapley_sampling(scorer, rows: DataFrame, background: np.ndarray, features: Sequence[str], key: str, orders: int = 2, seed: int = 42) -> DataFrame:
    """(key, class, feature, contribution, base, prediction) by sampled feature orders.

    For a row, a background row and an order of the features, hybrid rows take the features one after the other from the
    row in place of the background row. What a step adds to a class's score is that feature's share, and the contribution
    is the mean over all background rows and ``orders`` orders each. So contributions of a row always add up to
    ``prediction - base`` (its score, and the mean score of the background), and for linear scores they are exact: weight
    * (value - background mean).

    The background is at most a few hundred rows (``background_rows``) and goes to all tasks; there are background * orders
    * (features + 1) hybrids a row, made and scored where the row lies: by ``scorer.scores`` as a matrix in the task that made
    them, if the scorer has it, else by ``scorer.transform``. Sums are made in tasks, so features + 2 small rows
    a row and batch are shuffled. Repeated keys are explained together; NULL features are NaN to the scorer.
    """
    p, b = len(features), len(background)
    if not b:
        raise ValueError("no background rows")
    order = feature_orders(b, orders, p, seed)
    paired = np.repeat(background, orders, axis=0)
    n = b * orders
    # Hybrid t of a pair holds the first t features of its order: it adds to the t-th, and is what the next one starts from.
    rank = np.argsort(order, axis=1)
    adds = np.concatenate([np.full((n, 1), p), order], axis=1)
    subtracts = np.concatenate([order, np.full((n, 1), p + 1)], axis=1)
    step = max(1, AT_ONCE // (p + 1))
    names = [f"x{i}" for i in range(p)]
    kind = rows.schema[key].dataType.simpleString()

    def hybrids(batches):
        for batch in batches:
            x = matrix_of(batch, 1, p)
            for i in range(batch.num_rows):
                for at in range(0, n, step):
                    taken = rank[at:at + step, None, :] < np.arange(p + 1)[None, :, None]
                    made = np.where(taken, x[i], paired[at:at + step, None, :]).reshape(-1, p)
                    own = batch.column(0).take(pa.array(np.full(len(made), i)))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(made[:, j]) for j in range(p)], pa.array(adds[at:at + step].ravel().astype(np.int32)), pa.array(subtracts[at:at + step].ravel().astype(np.int32))],
                                                     names=[key, *names, "_add", "_subtract"])

    made = rows.select(q(key), *[F.col(q(c)).cast("double").alias(a) for c, a in zip(features, names)]).mapInArrow(hybrids, ", ".join([f"`{key}` {kind}", *[f"{a} double" for a in names], "_add int, _subtract int"]))
    made = made.select(q(key), *[F.col(a).alias(c) for c, a in zip(features, names)], "_add", "_subtract")
    k = len(scorer.classes)

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            codes = keys.dictionary_encode()
            row = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            score = batch.column(3).flatten().to_numpy().reshape(-1, k)
            width = p + 2
            total = np.zeros(((int(row.max()) + 1) * width, k))
            np.add.at(total, row * width + batch.column(1).to_numpy(), score)
            np.subtract.at(total, row * width + batch.column(2).to_numpy(), score)
            first = np.unique(row, return_index=True)
            at = (first[0][:, None] * width + np.arange(width)).ravel()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(first[1], width))), pa.array(np.tile(np.arange(width, dtype=np.int32), len(first[0]))),
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(total[at].ravel()))], names=[key, "i", "total"])

    def scored_sums(batches):
        width = p + 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x, total = matrix_of(batch, 1, p), np.zeros((batch.num_rows, width, k))
            for i in range(batch.num_rows):
                for at in range(0, n, step):
                    own = rank[at:at + step]
                    made = np.where(own[:, None, :] < np.arange(p + 1)[None, :, None], x[i], paired[at:at + step, None, :])
                    score = scorer.scores(made.reshape(-1, p)).reshape(len(own), p + 1, k)
                    total[i, :p] += np.take_along_axis(np.diff(score, axis=1), own[:, :, None], axis=1).sum(axis=0)
                    total[i, p] += score[:, 0].sum(axis=0)
                    total[i, p + 1] -= score[:, p].sum(axis=0)
            at = np.repeat(np.arange(batch.num_rows), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(width, dtype=np.int32), batch.num_rows)),
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(total.ravel()))], names=[key, "i", "total"])

    if hasattr(scorer, "scores"):
        # a row is many hybrids, so the tasks are many small ones
        spread = rows.select(q(key), *[F.col(q(c)).cast("double").alias(a) for c, a in zip(features, names)]).repartition(rows.sparkSession.sparkContext.defaultParallelism * 4)
        parts = spread.mapInArrow(scored_sums, f"`{key}` {kind}, i int, total array<double>")
    else:
        scored = scorer.transform(made).select(q(key), "_add", "_subtract", "probs")
        parts = scored.mapInArrow(sums, f"`{key}` {kind}, i int, total array<double>")
    parts = parts.select(q(key), "i", F.posexplode("total").alias("c", "v"))
    copies = rows.groupBy(q(key)).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    found = parts.groupBy(q(key), "i", "c").agg((F.sum("v") / n).alias("v"))
    w = Window.partitionBy(q(key), "c")
    found = found.withColumn("base", F.max(F.when(F.col("i") == p, F.col("v"))).over(w)).withColumn("prediction", -F.min(F.when(F.col("i") == p + 1, F.col("v"))).over(w))
    found = found.join(copies, key, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    label, feature = F.array(*[F.lit(c) for c in scorer.classes])[F.col("c")], F.array(*[F.lit(f) for f in features])
    return found.where(F.col("i") < p).select(q(key), label.alias("class"), feature[F.col("i")].alias("feature"), *[(F.col(v) / F.col("_copies")).alias(a) for v, a in (("v", "contribution"), ("base", "base"), ("prediction", "prediction"))])


def shapley_summary(contributions: DataFrame) -> DataFrame:
    """(class, feature, mean_abs): the mean size of the contributions, the global importance for each class."""
    return contributions.groupBy("class", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def instance_explanation(scorer, rows: DataFrame, keys: Sequence, background: np.ndarray, features: Sequence[str], key: str, orders: int = 2, seed: int = 42) -> DataFrame:
    """E5: for listed rows the path from the background's mean score to the row's own: (key, class, step, feature, value,
    contribution, before, after), largest contributions first (ties: the feature's name).

    Only the listed rows are turned into hybrids: the keys prune before anything is made. ``before`` of step 1 is the
    base, ``after`` of the last step the prediction. Contributions are those of ``shapley_sampling``.
    """
    chosen = rows.where(F.col(q(key)).isin(list(keys)))
    found = shapley_sampling(scorer, chosen, background, features, key, orders, seed)
    values = chosen.select(q(key), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(q(c)).cast("double").alias("value")) for c in features])).alias("f")).select(q(key), "f.*").dropDuplicates([key, "feature"])
    w = Window.partitionBy(q(key), "class").orderBy(F.desc(F.abs("contribution")), "feature")
    found = found.withColumn("step", F.row_number().over(w)).withColumn("after", F.col("base") + F.sum("contribution").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.join(values, [key, "feature"]).select(q(key), "class", "step", "feature", "value", "contribution", (F.col("after") - F.col("contribution")).alias("before"), "after")


def local_surrogate(scorer, rows: DataFrame, features: Sequence[str], key: str, scales: Mapping[str, float], samples: int = SAMPLES, top: int = TOP, kernel_width: float | None = None, ridge: float = 0.0,
                    seed: int = 42) -> DataFrame:
    """A weighted linear fit around each row: (key, class, rank, feature, weight, coefficient), the ``top`` features by
    size of weight.

    ``samples`` rows around a row (the first is the row itself) differ from it by normal noise of each feature's scale
    (``scales``: standard deviations; features of scale 0 stay fixed and get no weight). They are scored in one batch and
    weigh exp(-d^2 / (2 width^2)) by their distance d in scales; the width is 0.75 * sqrt(features) unless given.
    ``weight`` is the slope per scale, ``coefficient`` per unit of the feature; for linear scores it is their weight.

    The normal equations of a row are summed in tasks and solved once they are put together, by key: (features + 1)^2 numbers
    a batch. Noise depends on ``seed`` and the key only. A row with a NULL feature cannot be varied and is left out;
    repeated keys are one row, the first.
    """
    p, k = len(features), len(scorer.classes)
    scale = np.array([float(scales.get(c) or 0.0) for c in features])
    width = kernel_width or 0.75 * max(1, p) ** 0.5
    names = [f"x{i}" for i in range(p)]
    kind = rows.schema[key].dataType.simpleString()

    def perturbed(batches):
        for batch in batches:
            x, keys = matrix_of(batch, 1, p), batch.column(0)
            for i in range(batch.num_rows):
                rng = np.random.default_rng([seed, zlib.crc32(str(keys[i].as_py()).encode())])
                for at in range(0, samples, AT_ONCE):
                    z = rng.standard_normal((min(AT_ONCE, samples - at), p)) * (scale > 0)
                    if at == 0:
                        z[0] = 0.0
                    made = x[i] + z * scale
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.full(len(z), i))), *[pa.array(made[:, j]) for j in range(p)], pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * p), pa.array(z.ravel()))],
                                                     names=[key, *names, "_z"])

    whole = rows.dropna(subset=list(features)).dropDuplicates([key])
    made = whole.select(q(key), *[F.col(q(c)).cast("double").alias(a) for c, a in zip(features, names)]).mapInArrow(perturbed, ", ".join([f"`{key}` {kind}", *[f"{a} double" for a in names], "_z array<double>"]))
    made = made.select(q(key), *[F.col(a).alias(c) for c, a in zip(features, names)], "_z")

    def equations(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            row = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            z, y = batch.column(1).flatten().to_numpy().reshape(-1, p), batch.column(2).flatten().to_numpy().reshape(-1, k)
            out = []
            for r in np.unique(row):
                at = np.flatnonzero(row == r)
                a = np.concatenate([np.ones((len(at), 1)), z[at]], axis=1)
                w = np.exp(-np.square(z[at]).sum(axis=1) / (2 * width * width))[:, None]
                out.append((at[0], (a.T @ (w * a)).tobytes(), (a.T @ (w * y[at])).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out])), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=[key, "left", "right"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, own = np.zeros((p + 1, p + 1)), np.zeros((p + 1, k)), None
        for batch in batches:
            own = batch.column(key).slice(0, 1)
            for a, b in zip(batch.column("left"), batch.column("right")):
                left += np.frombuffer(a.as_buffer(), dtype=np.float64).reshape(p + 1, p + 1)
                right += np.frombuffer(b.as_buffer(), dtype=np.float64).reshape(p + 1, k)
        fitted = np.linalg.lstsq(left + ridge * np.diag([0.0] + [1.0] * p), right, rcond=None)[0][1:]
        per_unit = np.divide(fitted, scale[:, None], out=np.zeros_like(fitted), where=scale[:, None] > 0)
        yield pa.RecordBatch.from_arrays([own.take(pa.array(np.zeros(p * k, dtype=np.int64))), pa.array(np.tile(np.arange(k, dtype=np.int32), p)), pa.array(np.repeat(np.arange(p, dtype=np.int32), k)),
                                          pa.array(fitted.ravel()), pa.array(per_unit.ravel())], names=[key, "c", "i", "weight", "coefficient"])

    scored = scorer.transform(made).select(q(key), "_z", "probs")
    fits = scored.mapInArrow(equations, f"`{key}` {kind}, left binary, right binary").groupBy(q(key)).applyInArrow(solve, f"`{key}` {kind}, c int, i int, weight double, coefficient double")
    label, feature = F.array(*[F.lit(c) for c in scorer.classes])[F.col("c")], F.array(*[F.lit(f) for f in features])[F.col("i")]
    named = fits.select(q(key), label.alias("class"), feature.alias("feature"), "weight", "coefficient")
    w = Window.partitionBy(q(key), "class").orderBy(F.desc(F.abs("weight")), "feature")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(q(key), "class", "rank", "feature", "weight", "coefficient")
