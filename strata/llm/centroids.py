"""Centroid clustering of integer vectors: in each round a vantage-point tree of the centroids is broadcast and searched best-first."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Components are floor(SCALE * x).
SCALE = 1024
#: Centroids in a leaf of the tree, and vectors that are searched together.
LEAF, TOGETHER = 2, 2048
#: Components up to this size have squared distances that fit 64 bits (at 64 components); others are compared as Python integers.
NARROW = 1 << 27
#: Components beyond this do not fit 64 bits.
WIDEST = 1 << 62
#: What the rounding of two square roots and their difference can add, in proportion.
SLACK = 1e-12


@dataclass
class Node:
    """A leaf with ``members``; or a vantage point with its two children and the ranges of their distances to it."""

    members: list[int]
    vantage: int = -1
    children: tuple[int, int] = (-1, -1)
    ranges: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


@dataclass
class VantagePointTree:
    """Centroids as exact integers (int64, or Python integers where a component is over ``NARROW``)."""

    centroids: np.ndarray
    nodes: list[Node]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (ties: the smaller number) and the exact squared distance.

        Every vector has its own queue of nodes by their lower bound and always opens the nearest; all vectors that open the
        same node are compared at once. A vector is done when its nearest open node is farther than the best so far: one at
        exactly that distance is opened too, since it may hold a tie with a smaller number.
        """
        n, far = len(vectors), np.inf
        wide = vectors.dtype == object or self.centroids.dtype == object
        rows, points = (x.astype(object) if wide else x for x in (vectors, self.centroids))
        best = np.full(n, -1, dtype=object if wide else np.int64)
        number = np.full(n, len(points), dtype=np.int64)
        bounds = np.full((n, len(self.nodes)), far)
        bounds[:, 0] = 0.0
        reach = np.full(n, far)
        active = np.arange(n)
        while len(active):
            at = bounds[active].argmin(axis=1)
            low = bounds[active, at]
            going = (low < far) & (low <= reach[active])
            active, at, low = active[going], at[going], low[going]
            bounds[active, at] = far
            for k in np.unique(at).tolist():
                node, own, low_k = self.nodes[k], active[at == k], low[at == k]
                for c in node.members if node.vantage < 0 else [node.vantage]:
                    gap = rows[own] - points[c]
                    square = (gap * gap).sum(axis=1)
                    less = (best[own] < 0) | (square < best[own]) | ((square == best[own]) & (c < number[own]))
                    best[own[less]], number[own[less]] = square[less], c
                    if node.vantage >= 0:
                        d = np.sqrt(square.astype(np.float64))
                        for child, (near, out) in zip(node.children, node.ranges):
                            slack = SLACK * (d + out)
                            bounds[own, child] = np.maximum(low_k, np.maximum(near - d, d - out) - slack)
                reach[own] = np.sqrt(best[own].astype(np.float64)) * (1 + SLACK)
        return number, best


def integers(values: list[list[int]]) -> np.ndarray:
    """Rows of integers: int64 if all are at most ``NARROW``, else Python integers."""
    wide = any(abs(x) > NARROW for v in values for x in v)
    return np.array(values, dtype=object if wide else np.int64)


def vantage_point_tree(centroids: list[list[int]]) -> VantagePointTree:
    """Split at the median of the distances to a vantage point, the centroid farthest from the first, down to ``LEAF``."""
    points = integers(centroids)
    nodes: list[Node] = []

    def distances(c: int, members: list[int]) -> np.ndarray:
        gap = points[members].astype(object) - points[c].astype(object)
        return np.sqrt((gap * gap).sum(axis=1).astype(np.float64))

    def add(members: list[int]) -> int:
        k = len(nodes)
        nodes.append(Node(members))
        if len(members) <= LEAF:
            return k
        vantage = members[int(distances(members[0], members).argmax())]
        others = [m for m in members if m != vantage]
        d = distances(vantage, others)
        order = np.argsort(d, kind="stable")
        halves = [order[:(len(order) + 1) // 2], order[(len(order) + 1) // 2:]]
        nodes[k] = Node([], vantage, tuple(add([others[i] for i in half]) for half in halves), tuple((float(d[half].min()), float(d[half].max())) for half in halves))
        return k

    add(list(range(len(centroids))))
    return VantagePointTree(points, nodes)


def whole_vectors(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): the vectors of ``dim`` finite components, as integers."""
    def rows(batches):
        for b in batches:
            column = b.column(1)
            sized = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim))
            column = column.take(pa.array(sized))
            flat = column.flatten()
            x = np.floor(flat.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * SCALE)
            fine = (np.abs(x) <= WIDEST).all(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(sized[fine])), pa.ListArray.from_arrays(pa.array(np.arange(fine.sum() + 1, dtype=np.int32) * dim), pa.array(x[fine].astype(np.int64).ravel()))], names=["vec_id", "vec"])

    own = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    return own.mapInArrow(rows, "vec_id bigint, vec array<bigint>")


def blocks(batch: pa.RecordBatch, dim: int):
    """(ids, rows) of parts of a batch."""
    for at in range(0, batch.num_rows, TOGETHER):
        b = batch.slice(at, TOGETHER)
        rows = b.column(1).flatten().to_numpy().reshape(-1, dim)
        yield b.column(0), rows if not len(rows) or max(-int(rows.min()), int(rows.max())) <= NARROW else rows.astype(object)


def sums(points: DataFrame, tree: VantagePointTree, dim: int) -> dict[int, list[int]]:
    """The floor of the mean of each centroid's vectors. Tasks add up their vectors batch by batch, Spark the batches; the
    driver gets one number for each component of a centroid."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def rows(batches):
        for batch in batches:
            count, total = {}, {}
            for _, own in blocks(batch, dim):
                number, _ = shared.value.nearest(own)
                for c in np.unique(number).tolist():
                    part = own[number == c]
                    # Under 2**62 each, so 2,048 of them do not fit 64 bits: wide ones are added up as Python integers.
                    count[c] = count.get(c, 0) + len(part)
                    total[c] = total.get(c, 0) + part.sum(axis=0).astype(object)
            keys = list(count)
            values = pa.array([Decimal(int(x)) for c in keys for x in total[c]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([count[c] for c in keys], pa.int64()), pa.ListArray.from_arrays(pa.array([dim * i for i in range(len(keys) + 1)], pa.int32()), values)], names=["cluster", "n", "total"])

    parts = points.mapInArrow(rows, "cluster int, n bigint, total array<decimal(38,0)>")
    found = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    shared.destroy()
    moved: dict[int, list[int]] = {r["cluster"]: [0] * dim for r in found}
    for r in found:
        moved[r["cluster"]][r["i"]] = int(r["x"]) // r["n"]
    return moved


def assigned(points: DataFrame, tree: VantagePointTree, dim: int) -> DataFrame:
    """(vec_id, cluster, distance); a squared distance that does not fit 64 bits is null."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def rows(batches):
        for batch in batches:
            for ids, own in blocks(batch, dim):
                number, square = shared.value.nearest(own)
                far = pa.array(square) if square.dtype != object else pa.array([x if x < 1 << 63 else None for x in square.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    return points.mapInArrow(rows, "vec_id bigint, cluster int, distance bigint")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Lloyd's rounds over integer vectors, exact at each step. One row a kept vector: vec_id, cluster, distance (squared),
    cluster_inertia and inertia (distance summed over the cluster, and over all), centroid_sha256 (of the final centroid's
    components as decimal integers joined by commas).

    1. Vectors of exactly ``dim`` finite components are kept, as floor(1024 * x). The ``k`` with the smallest sha256 of
       ``seed:vec_id`` (in hexadecimal) are the first centroids, in that order; equal ids are ordered by their components.
    2. In each of ``rounds`` rounds a vantage-point tree of the centroids is built and broadcast; each vector searches it
       best-first. A centroid with vectors becomes the floor of their mean, one without stays. Sums come from the tasks
       batch by batch, so a centroid of any share of the vectors is a few rows.
    3. All vectors are assigned once more.

    Squared distances are integers; ties go to the smaller number, so of equal centroids the first has all vectors. Rows with
    equal ids or vectors stay rows of their own. A null id has no hash: its vector is kept, and is a first centroid only if
    fewer than ``k`` others are. With fewer than ``k`` vectors, each is a centroid. Components up to 2**17 as numbers give
    64-bit distances; beyond that they are compared as Python integers, and a distance, or a sum of distances, that does not
    fit 64 bits is null. A vector with an integer beyond 2**62 is not kept. Other columns are not used; an empty table, or one
    without such vectors, gives no rows. The tree holds ``k`` vectors, whatever the number of rows.
    """
    spark = vectors.sparkSession
    points = written(whole_vectors(vectors, dim, id_col, vector_col), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["vec"]) for r in points.orderBy(order.asc_nulls_last(), "vec").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        moved = sums(points, vantage_point_tree(centroids), dim)
        centroids = [moved.get(c, old) for c, old in enumerate(centroids)]
    found = written(assigned(points, vantage_point_tree(centroids), dim), "assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    known = F.count("distance") == F.count(F.lit(1))
    each = [(r["cluster"], int(r["s"]) if r["known"] else None) for r in found.groupBy("cluster").agg(whole.alias("s"), known.alias("known")).collect()]  # at most k rows
    total = sum(s for _, s in each) if all(s is not None for _, s in each) else None
    fitting = lambda s: s if s is not None and s < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, fitting(s), fitting(total), sha[c]) for c, s in each], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
