"""Exact nearest-neighbour joins and the operators built on them
(SURVEY 2.4 J3/J4, 2.6 W5, 2.10 O4-O6, 2.11 R5).

No cross join of rows: points lie in tiles, and only tiles that can hold
neighbours of each other meet, in one numpy kernel a pair of tiles.

1. A k-d tree, split at the medians of a sample (at most 16,384 rows and
   10**6 numbers on the driver), deals every point to a leaf. A leaf that
   holds far more rows than planned is cut into parts by a hash, so a tile has
   about ``ring_size`` rows whatever the sample said. A tile's box (least and
   greatest value of each coordinate) comes from one aggregate.
2. k-NN: of points that are equal only as many as a result can hold stay (the
   smallest keys), equal queries are asked once. A query's home tile gives an
   upper bound on its k-th distance; other tiles are visited only if the boxes
   are no farther apart than the largest bound in the query's tile.
3. Radius questions visit the tiles whose boxes are within the radius.

Boxes and bounds carry a slack, and distances are computed from the
coordinates themselves, so the result is exact; the sample only decides how
many tiles meet. Vectors are array<double> without NULLs (Euclidean metric).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from .graph import connected_components, saved
from .ranks import exact_quantiles
from .select import q


# Distances equal at 1e-9 are ties (broken by the smaller key): mathematically
# equal distances can differ by an ulp with the evaluation order.
TIE_SLACK = 1e-9

#: Rows and numbers of the sample that the tree is fitted on.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 1_000_000
#: Tiles at most, as far as hashing does not cut a leaf further: tiles grow with the table.
TILES = 2048
#: Up to so many coordinates squares are summed up directly, beyond that candidates come from a matrix product.
DIRECT = 8
#: Rows of a tile that a kernel compares with the other tile at once.
AT_ONCE = 256
#: Numbers of the tiles that a task gets of each side at once, with more than 8 coordinates, and the least blocks of such tiles.
BLOCK_NUMBERS, LEAST_BLOCKS = 1 << 21, 8
#: Parts that the classes to grow are dealt to; their neighbours are looked for at once.
CLASSES_AT_ONCE = 2


def tie_key(d: Column) -> Column:
    """Distance rounded to 1e-9 (the same arithmetic in SQL engines)."""
    return F.floor(d * F.lit(1e9) + F.lit(0.5))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The vectors of an array column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != d * len(column):
        raise ValueError("vectors must have one length and no nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), d)


def _squares(Q: np.ndarray, P: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of ``Q`` and ``P``, and how far they may be off."""
    if P.shape[1] <= DIRECT:
        out = np.zeros((len(Q), len(P)))
        for j in range(P.shape[1]):
            x = Q[:, j, None] - P[None, :, j]
            out += x * x
        return out, 0.0
    mid = P.mean(axis=0)
    a, b = Q - mid, P - mid
    qq, pp = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    return qq[:, None] + pp[None, :] - 2.0 * (a @ b.T), 1e-12 * float(qq.max() + pp.max())


def _exact(Q: np.ndarray, P: np.ndarray, qi: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Distances of the pairs (qi, pi) of rows."""
    out = np.empty(len(qi))
    for at in range(0, len(qi), 65_536):
        diff = Q[qi[at:at + 65_536]] - P[pi[at:at + 65_536]]
        out[at:at + 65_536] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _within(Q: np.ndarray, P: np.ndarray, ub: np.ndarray, need: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, point rows, distances) in parts: all pairs within the query's bound and, with ``need``, no farther than
    its need-th nearest (ties included)."""
    step = max(1, min(AT_ONCE, AT_ONCE * 8192 // max(1, len(P))))
    many = 4 if len(P) <= 16_384 else 1
    for at in range(0, len(Q), step):
        q_, u = Q[at:at + step], ub[at:at + step]
        a, off = _squares(q_, P)
        lim = (u + 2 * TIE_SLACK) ** 2 + off
        ok = a <= lim[:, None]
        if need is not None and len(P) > need and np.count_nonzero(ok) > many * need * len(q_):
            kth = np.partition(a, need - 1, axis=1)[:, need - 1]
            ok = a <= np.minimum(lim, (np.sqrt(np.maximum(kth, 0) + off) + 2 * TIE_SLACK) ** 2 + off)[:, None]
        qi, pi = np.nonzero(ok)
        d = _exact(q_, P, qi, pi)
        keep = d <= (u + TIE_SLACK)[qi]
        yield qi[keep] + at, pi[keep], d[keep]


def _gathered(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(parts)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Tree:
    """A k-d tree over a sample: ``leaf`` deals vectors to its leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.thr, self.left, self.right = [], [], [], []
        self.small = max(1.0, len(sample) / leaves)
        self.depth = self._add(sample, 0)

    def _add(self, x: np.ndarray, depth: int) -> int:
        at = len(self.dim)
        for c, v in ((self.dim, 0), (self.thr, 0.0), (self.left, at), (self.right, at)):
            c.append(v)
        spread = x.max(axis=0) - x.min(axis=0)
        j = int(np.argmax(np.nan_to_num(spread, nan=0.0, posinf=0.0)))
        if len(x) <= self.small or not np.isfinite(spread[j]) or spread[j] <= 0:
            return depth
        v = np.sort(x[:, j])
        t = v[(len(v) - 1) // 2]
        t = t if t < v[-1] else v[np.searchsorted(v, t) - 1]
        self.dim[at], self.thr[at], self.left[at] = j, float(t), len(self.dim)
        deep = self._add(x[x[:, j] <= t], depth + 1)
        self.right[at] = len(self.dim)
        return max(deep, self._add(x[~(x[:, j] <= t)], depth + 1))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        dim, thr, left, right = map(np.asarray, (self.dim, self.thr, self.left, self.right))
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, dim[at]] <= thr[at], left[at], right[at])
        return at


class _Tiles:
    """A saved table whose rows have a ``_tile``, and what is known of each tile: group, rows, box."""

    def __init__(self, rows: DataFrame, stats: list, groups: dict[int, object]):
        self.rows, self.ids = rows, np.asarray([r["_tile"] for r in stats], dtype=np.int64)
        self.n = np.asarray([r["n"] for r in stats], dtype=np.int64)
        self.lo, self.hi = (np.asarray([r[c] for r in stats], dtype=float).reshape(len(stats), -1) for c in ("lo", "hi"))
        self.groups = [groups[int(t)] for t in self.ids]

    def gaps(self, i: int, other: "_Tiles") -> np.ndarray:
        """Least distance of each of the other's tiles to the box of tile number ``i``; infinite in other groups."""
        gap = np.fmax(0.0, np.fmax(other.lo - self.hi[i], self.lo[i] - other.hi))
        out = np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-12)
        same = np.fromiter((g == self.groups[i] for g in other.groups), dtype=bool, count=len(other.groups))
        return np.where(same, out, np.inf)


class NeighbourIndex:
    """Points laid out in tiles; built once, queried for k-NN or radius
    neighbours. ``pivots``: sample rows for each tile that the tree is fitted
    on, ``ring_size``: rows of a tile (default: 1,024, with more than
    8 coordinates 8,192)."""

    def __init__(self, df: DataFrame, key: str, vec: str, group: str | None = None, ring_size: int | None = None, seed: int = 42, pivots: int = 64):
        self.key, self.vec, self.group = key, vec, group
        self.g = ["_g"] if group else []
        self.points = self._named(df)
        n = self.points.count()
        first = self.points.where("_v IS NOT NULL").first()
        if first is None:
            raise ValueError("no points")
        self.d = len(first["_v"])
        self.size = max(ring_size or (1024 if self.d <= DIRECT else 8192), math.ceil(n / TILES))
        leaves = math.ceil(n / self.size)
        want = min(SAMPLE_ROWS, pivots * leaves, SAMPLE_NUMBERS // max(1, self.d))
        few = self.points if leaves == 1 or want >= n else self.points.where(F.pmod(F.xxhash64(F.lit(seed), "_k", "_v"), F.lit(1 << 30)) < int(want / n * (1 << 30)))
        sample = [first["_v"]] if leaves == 1 else [r["_v"] for r in few.select("_v").collect()] or [first["_v"]]
        if any(v is None or len(v) != self.d or None in v for v in sample):
            raise ValueError("vectors must have one length and no nulls")
        self.tree = _Tree(np.asarray(sample, dtype=float).reshape(len(sample), self.d), leaves)

    def _named(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(q(self.key)).alias("_k"), F.col(q(self.vec)).cast("array<double>").alias("_v"),
                         *([F.col(q(self.group)).alias("_g")] if self.group else []))

    # ------------------------------------------------------------------ tiles
    def _tiled(self, df: DataFrame, parts_by: Sequence[str] = ("_v",)) -> _Tiles:
        """``df`` (with ``_v`` and the group) saved with the tile of each row; a leaf's parts are told by a hash of ``parts_by``."""
        tree, d = self.tree, self.d
        at = df.columns.index("_v")

        def leaves(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(_matrix(b.column(at), d)), pa.int64())], names=[*b.schema.names, "_leaf"])

        rows = saved(df.mapInArrow(leaves, StructType([*df.schema.fields, *StructType.fromDDL("_leaf bigint").fields])))
        by, groups, base, total = [], {}, 0, 0
        for r in rows.groupBy(*self.g, "_leaf").agg(F.count(F.lit(1)).alias("n")).orderBy("_leaf").collect():  # a row a leaf and group
            parts = 1 if r["n"] <= 2 * self.size else math.ceil(r["n"] / self.size)
            by.append((*[r[g] for g in self.g], r["_leaf"], base, parts))
            groups |= {base + i: r["_g"] if self.group else None for i in range(parts)}
            base += parts
            total += r["n"]
        schema = StructType([*[StructField("_lg", rows.schema[g].dataType) for g in self.g], *StructType.fromDDL("_ll bigint, _base int, _parts int").fields])
        small = F.broadcast(df.sparkSession.createDataFrame(by, schema))
        cond = rows["_leaf"] == small["_ll"]
        if self.group:
            cond = cond & rows["_g"].eqNullSafe(small["_lg"])
        rows = rows.join(small, cond).select(*df.columns, (F.col("_base") + F.pmod(F.xxhash64(*parts_by), F.col("_parts"))).cast("int").alias("_tile"))
        if base == 1:  # the only tile: nothing is told apart by its box
            far = np.finfo(float).max / 4
            return _Tiles(rows, [{"_tile": 0, "n": total, "lo": [-far] * d, "hi": [far] * d}], groups)
        box = [F.expr(f"array({', '.join(f'{f}(get(_v, {i}))' for i in range(d))}) AS {name}") for f, name in (("min", "lo"), ("max", "hi"))]
        return _Tiles(rows, rows.groupBy("_tile").agg(F.count(F.lit(1)).alias("n"), *box).collect(), groups)

    def _met(self, left: DataFrame, right: DataFrame, pairs: list[tuple[int, int]], kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
        """``kernel`` over the rows of each pair of tiles. Where there are many tiles of many coordinates, each of which meets most
        others, blocks of tiles meet: a tile is handed on once for each block in place of each tile, and ``kernel`` has a tile
        and all rows of the block that it meets."""
        block = self._block(1 + max((max(p) for p in pairs), default=0))
        if block > 1:
            return self._met_by_block(left, right, pairs, kernel, schema, block)
        t, s = zip(*pairs) if pairs else ((), ())
        table = left.sparkSession.createDataFrame(pa.table({"_t": pa.array(t, pa.int32()), "_s": pa.array(s, pa.int32())}))
        table = F.broadcast(table) if len(pairs) <= 500_000 else table
        a = left.join(table.withColumnRenamed("_t", "_tile"), "_tile").withColumnRenamed("_tile", "_t")
        b = right.join(table.withColumnRenamed("_s", "_tile"), "_tile").withColumnRenamed("_tile", "_s")
        b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own, as both sides may come from one table
        return a.groupBy("_t", "_s").cogroup(b.groupBy("_t", "_s")).applyInArrow(kernel, schema)

    def _block(self, tiles: int) -> int:
        """Tiles of a block."""
        return 1 if self.d <= DIRECT else max(1, min(BLOCK_NUMBERS // (self.size * self.d), tiles // LEAST_BLOCKS))

    @staticmethod
    def _met_by_block(left: DataFrame, right: DataFrame, pairs: list[tuple[int, int]], kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType, block: int) -> DataFrame:
        spark, meets, asked = left.sparkSession, {}, set()
        for t, s in pairs:
            meets.setdefault((t, s // block), []).append(s)
            asked.add((s, t // block))
        a = spark.createDataFrame([(t, t // block, b, m) for (t, b), m in meets.items()], "_tile int, _a int, _b int, _with array<int>")
        b = spark.createDataFrame([(s, c, s // block) for s, c in asked], "_tile int, _a int, _b int")
        few = len(meets) + len(asked) <= 500_000
        a = left.join(F.broadcast(a) if few else a, "_tile").withColumnRenamed("_tile", "_t")
        b = right.join(F.broadcast(b) if few else b, "_tile").withColumnRenamed("_tile", "_s")
        b = b.select(*[F.col(c).alias(c) for c in b.columns])
        names = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names
        empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            tile, other, out = left["_t"].to_numpy(), right["_s"].to_numpy(), []
            for t in np.unique(tile):
                mine = np.nonzero(tile == t)[0]
                theirs = np.nonzero(np.isin(other, left["_with"][int(mine[0])].as_py()))[0]
                out.append(kernel(left.take(pa.array(mine)), right.take(pa.array(theirs))).select(names))
            return pa.concat_tables(out) if out else empty

        return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(met, schema)

    # ------------------------------------------------------------------ k-NN
    def knn(self, k: int, queries: DataFrame | None = None, exclude_self: bool = True) -> DataFrame:
        """k nearest points for every query (default: every indexed point).
        Returns (key, nbr, dist, rank) with rank 1..k (ties: smaller key)."""
        d, kk = self.d, int(k)
        asked = self.points if queries is None else self._named(queries)
        most = lambda df: int(df.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
        repeats = most(asked)
        own = 0 if not exclude_self else repeats if queries is None else most(self.points)
        need = kk + own  # rows of a query's own key are left out at the end
        w = Window.partitionBy("_v", *self.g).orderBy("_k")
        pts = self._tiled(self.points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= need))
        if queries is None:
            ask = _Tiles.__new__(_Tiles)
            ask.__dict__ |= pts.__dict__
            ask.rows = pts.rows.where("_rn = 1").select("_v", *self.g, "_tile")
        else:
            ask = self._tiled(asked.select("_v", *self.g).distinct())
        if not len(ask.ids):
            return asked.sparkSession.createDataFrame([], self._result_schema())
        numbered = saved(ask.rows.withColumn("_q", F.monotonically_increasing_id()))
        ktype = self.points.schema["_k"].dataType.simpleString()
        points = pts.rows.select("_k", "_v", "_tile")

        # the home tile: the nearest one that holds enough rows
        home: dict[int, int] = {}
        for i in range(len(ask.ids)):
            gap = ask.gaps(i, pts)
            mid = np.nan_to_num((((ask.lo[i] + ask.hi[i]) / 2 - (pts.lo + pts.hi) / 2) ** 2).sum(axis=1))
            best = int(np.lexsort((mid, gap, (pts.n < need) | np.isinf(gap), np.isinf(gap)))[0])
            if np.isfinite(gap[best]):
                home[i] = best
        near = f"array<struct<nbr:{ktype},dist:double>>"

        def first(left: pa.Table, right: pa.Table) -> pa.Table:
            Q, P = _matrix(left["_v"], d), _matrix(right["_v"], d)
            qi, pi, dist = _gathered(_within(Q, P, np.full(len(Q), np.inf), need)) if len(P) else _gathered(())
            order = np.lexsort((dist, qi))
            qi, pi, dist = qi[order], pi[order], dist[order]
            ends = np.searchsorted(qi, np.arange(len(Q) + 1))
            ub = np.full(len(Q), np.inf)
            full = np.nonzero(np.diff(ends) >= need)[0]
            ub[full] = dist[ends[full] + need - 1]
            return pa.table({"_q": left["_q"], "_v": left["_v"], "_tile": left["_t"], "_ub": ub, "near": _lists(right["_k"], ends, pi, dist)})

        begun = saved(self._met(numbered, points, [(int(ask.ids[i]), int(pts.ids[j])) for i, j in home.items()], first,
                                f"_q bigint, _v array<double>, _tile int, _ub double, near {near}"))
        far = {r["_tile"]: r["u"] for r in begun.groupBy("_tile").agg(F.max("_ub").alias("u")).collect()}
        pairs = []
        for i, t in enumerate(ask.ids):
            gap = ask.gaps(i, pts)
            visit = (gap <= far.get(int(t), -1.0) + 2 * TIE_SLACK) & np.isfinite(gap)
            visit[home.get(i, slice(0))] = False
            pairs += [(int(t), int(s)) for s in pts.ids[visit]]

        def more(left: pa.Table, right: pa.Table) -> pa.Table:
            Q, P = _matrix(left["_v"], d), _matrix(right["_v"], d)
            qi, pi, dist = _gathered(_within(Q, P, left["_ub"].to_numpy(), need)) if len(P) and len(Q) else _gathered(())
            asked_, starts = np.unique(qi, return_index=True)
            return pa.table({"_q": left["_q"].take(pa.array(asked_)), "near": _lists(right["_k"], np.append(starts, len(qi)), pi, dist)})

        found = begun.select("_q", "near")
        if pairs:
            found = found.unionAll(self._met(begun.select("_q", "_v", "_ub", "_tile"), points, pairs, more, f"_q bigint, near {near}"))
        ranked = F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct(tie_key(x["dist"]).alias("t"), x["nbr"].alias("nbr"), x["dist"].alias("dist")))), 1, need)
        lists = saved(found.groupBy("_q").agg(ranked.alias("near")).join(numbered.drop("_tile").hint("merge"), "_q").drop("_q")
                      .select(F.col("_v").alias("_lv"), *[F.col(g).alias("_lg") for g in self.g], "near"))
        cond = asked["_v"] == F.col("_lv")
        if self.group:
            cond = cond & asked["_g"].eqNullSafe(F.col("_lg"))
        mine = F.col("near")
        if exclude_self:
            mine = F.filter(mine, lambda x: F.coalesce(x["nbr"] != F.col("_k"), F.lit(True)))
        out = asked.join(lists.hint("merge"), cond).select(F.col("_k").alias("key"), F.posexplode(F.slice(mine, 1, kk)).alias("_p", "_x"))
        out = out.select("key", F.col("_x.nbr").alias("nbr"), F.col("_x.dist").alias("dist"), (F.col("_p") + 1).alias("rank"))
        if repeats > 1:  # rows of one key share its k places
            w = Window.partitionBy("key").orderBy(tie_key(F.col("dist")), "nbr")
            out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kk)
        return out

    def _result_schema(self) -> str:
        ktype = self.points.schema["_k"].dataType.simpleString()
        return f"key {ktype}, nbr {ktype}, dist double, rank int"

    # ------------------------------------------------------------------ radius
    @staticmethod
    def _near_pairs(ask: _Tiles, pts: _Tiles, radius: dict[int, float] | float) -> list[tuple[int, int]]:
        out = []
        for i, t in enumerate(ask.ids):
            gap = ask.gaps(i, pts)
            u = radius if isinstance(radius, float) else radius.get(int(t), -1.0)
            out += [(int(t), int(s)) for s in pts.ids[(gap <= u + 2 * TIE_SLACK) & np.isfinite(gap)]]
        return out

    def radius(self, eps: float, include_self: bool = True) -> DataFrame:
        """All (key, nbr, dist) with dist <= eps: the eps-graph."""
        pts, d, eps = self._tiled(self.points, ("_k", "_v")), self.d, float(eps)
        ktype = self.points.schema["_k"].dataType.simpleString()

        def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
            Q, P = _matrix(left["_v"], d), _matrix(right["_v"], d)
            qi, pi, dist = _gathered(_within(Q, P, np.full(len(Q), eps))) if len(P) else _gathered(())
            keep = dist <= eps
            return pa.table({"key": left["_k"].take(pa.array(qi[keep])), "nbr": right["_k"].take(pa.array(pi[keep])), "dist": dist[keep]})

        rows = pts.rows.select("_k", "_v", "_tile")
        out = self._met(rows, rows, self._near_pairs(pts, pts, eps), pairs, f"key {ktype}, nbr {ktype}, dist double")
        return out if include_self else out.filter(F.col("key") != F.col("nbr"))

    def counts_within(self, asked: DataFrame) -> DataFrame:
        """For each distinct (_v, _ub, _r) of ``asked``: ``hits``, the number of points at a distance of at most ``_ub`` that is
        less than ``_r`` (points equal to it where ``_r`` is 0), both at 1e-9. Equal points are one row with their number."""
        d = self.d
        pts = self._tiled(self.points.groupBy("_v").agg(F.count(F.lit(1)).alias("_w")))
        ask = self._tiled(asked.select("_v", "_ub", "_r").distinct())
        far = {r["_tile"]: r["u"] for r in ask.rows.groupBy("_tile").agg(F.max("_ub").alias("u")).collect()}
        tie = lambda x: np.floor(x * 1e9 + 0.5)

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            Q, P, w = _matrix(left["_v"], d), _matrix(right["_v"], d), right["_w"].to_numpy()
            ub, r = left["_ub"].to_numpy(), tie(left["_r"].to_numpy())
            hits = np.zeros(len(Q), dtype=np.int64)
            if len(P):
                for qi, pi, dist in _within(Q, P, ub):
                    t = tie(dist)
                    ok = (dist <= ub[qi]) & np.where(r[qi] > 0, t < r[qi], t == 0)
                    np.add.at(hits, qi[ok], w[pi[ok]])
            return pa.table({"_v": left["_v"], "_ub": left["_ub"], "_r": left["_r"], "hits": hits})

        each = self._met(ask.rows, pts.rows, self._near_pairs(ask, pts, far), count, "_v array<double>, _ub double, _r double, hits bigint")
        return each.groupBy("_v", "_ub", "_r").agg(F.sum("hits").alias("hits"))


def _lists(keys: pa.ChunkedArray, ends: np.ndarray, pi: np.ndarray, dist: np.ndarray) -> pa.ListArray:
    nbr = keys.combine_chunks().take(pa.array(pi)) if len(pi) else pa.array([], keys.type)
    nbr = pa.concat_arrays(nbr.chunks) if isinstance(nbr, pa.ChunkedArray) else nbr
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([nbr, pa.array(dist)], names=["nbr", "dist"]))


def knn_join(df: DataFrame, key: str, vec: str, k: int, group: str | None = None, **kw) -> DataFrame:
    """Exact k nearest neighbours of every row (self excluded)."""
    return NeighbourIndex(df, key, vec, group, **kw).knn(k)


def eps_join(df: DataFrame, key: str, vec: str, eps: float, **kw) -> DataFrame:
    """Every pair within distance eps (self pairs included)."""
    return NeighbourIndex(df, key, vec, **kw).radius(eps)


# ------------------------------------------------------------------ O4 / O5 LOF

def lof_scores(df: DataFrame, key: str, vec: str, k: int = 20, threshold: float = 1.5, **kw) -> DataFrame:
    """Local Outlier Factor. k is reduced to n - 1 for tiny inputs.
    k-distance, reachability, local reachability density and LOF are two
    equi-joins and two group-bys over the k-NN table. Returns (key, lof,
    is_outlier) with is_outlier = lof > threshold."""
    n = df.count()
    k = max(1, min(k, n - 1))
    nn = knn_join(df, key, vec, k, **kw).cache()
    kdist = nn.filter(F.col("rank") == k).select(F.col("key").alias("nbr"), F.col("dist").alias("kd"))
    reach = nn.join(kdist.hint("merge"), "nbr").withColumn("reach", F.greatest("dist", "kd"))
    lrd = reach.groupBy("key").agg((F.lit(1.0) / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    nl = nn.join(lrd.select(F.col("key").alias("nbr"), F.col("lrd").alias("nlrd")).hint("merge"), "nbr")
    lof = nl.groupBy("key").agg(F.avg("nlrd").alias("m")).join(lrd.hint("merge"), "key").select(
        F.col("key").alias(key), (F.col("m") / F.col("lrd")).alias("lof"))
    return lof.withColumn("is_outlier", F.col("lof") > F.lit(threshold))


def lof_groups(df: DataFrame, key: str, groups: dict, k: int = 20, q_top: float = 0.95, over: str = "flagged",
               **kw) -> DataFrame:
    """LOF per feature group (name -> array column); keep scores at or
    above the q_top quantile of the flagged scores (``over='flagged'``, the
    reference's code) or of all scores (``'all'``)."""
    out = None
    for name, vec in groups.items():
        s = lof_scores(df, key, vec, k, **kw).withColumn("group", F.lit(name))
        base = s.filter("is_outlier") if over == "flagged" else s
        row = exact_quantiles(base, "lof", [q_top]).first()
        cut = None if row is None else row["_p"][0]
        part = s.filter("is_outlier").filter(F.col("lof") >= F.lit(cut)) if cut is not None else s.limit(0)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ O6 DBSCAN

def dbscan(df: DataFrame, key: str, vec: str, eps: float = 0.5, min_samples: int | None = None, **kw) -> DataFrame:
    """DBSCAN. core = at least min_samples points within eps, itself
    included (default 2 * dims); clusters = connected components of core-core
    edges of the eps-graph (``graph``, until nothing changes, whatever the
    length of a chain); border points take the smallest label of an adjacent
    core point; noise = -1. A cluster's label is its smallest member key
    (comparable across runs).

    The eps-graph (J4) never becomes rows: for each pair of tiles one kernel
    counts neighbours, a second one links the core points that the pair
    connects to one of them (no more edges than points, however dense the
    data), a third one takes the smallest label in reach of a border point."""
    if min_samples is None:
        d = len(df.select(q(vec)).first()[0])
        min_samples = max(1, 2 * d)
    index = NeighbourIndex(df, key, vec, **kw)
    tiles, d, eps = index._tiled(index.points, ("_k", "_v")), index.d, float(eps)
    ktype = index.points.schema["_k"].dataType.simpleString()
    rows, pairs = tiles.rows.select("_k", "_v", "_tile"), index._near_pairs(tiles, tiles, eps)
    present = lambda r: {x[0] for x in r.select("_tile").distinct().collect()}

    def found(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        Q, P = _matrix(left["_v"], d), _matrix(right["_v"], d)
        for qi, pi, dist in _within(Q, P, np.full(len(Q), eps)):
            yield qi[dist <= eps], pi[dist <= eps]

    def degrees(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(left.num_rows, dtype=np.int64)
        for qi, _ in found(left, right):
            n += np.bincount(qi, minlength=len(n))
        return pa.table({"node": left["_k"], "n": n})

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        root = np.arange(left.num_rows + right.num_rows)
        for qi, pi in found(left, right):
            u, v = qi, pi + left.num_rows
            while True:
                ru, rv = root[u], root[v]
                if (ru == rv).all():
                    break
                u, v, ru, rv = (x[ru != rv] for x in (u, v, ru, rv))
                np.minimum.at(root, ru, rv)
                np.minimum.at(root, rv, ru)
                while (root[root] != root).any():
                    root = root[root]
        keys = pa.concat_arrays([*left["_k"].chunks, *right["_k"].chunks])
        moved = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": keys.take(pa.array(moved)), "b": keys.take(pa.array(root[moved]))})

    def least(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, code = np.unique(right["lbl"].to_numpy(), return_inverse=True)
        best = np.full(left.num_rows, len(labels))
        for qi, pi in found(left, right):
            np.minimum.at(best, qi, code[pi])
        got = np.nonzero(best < len(labels))[0]
        return pa.table({"node": left["_k"].take(pa.array(got)), "blbl": pa.array(labels[best[got]], right["lbl"].type)})

    core = saved(index._met(rows, rows, pairs, degrees, f"node {ktype}, n bigint").where("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
                 .where(F.col("n") >= min_samples).select(F.col("node").alias("_k")))
    inner, outer = saved(rows.join(core.hint("merge"), "_k")), saved(rows.where("_k IS NOT NULL").join(core.hint("merge"), "_k", "left_anti"))
    held = present(inner)
    both = [(t, s) for t, s in pairs if t <= s and t in held and s in held]
    edges = core.select(F.col("_k").alias("a"), F.col("_k").alias("b"))  # a core point without core neighbours is a cluster of its own
    if both:
        edges = edges.unionAll(index._met(inner, inner, both, links, f"a {ktype}, b {ktype}"))
    lab = saved(connected_components(saved(edges)).withColumnRenamed("component", "lbl"))
    out = index.points.select(F.col("_k").alias("node")).join(lab.hint("merge"), "node", "left")
    asking = present(outer)
    near = [(t, s) for t, s in pairs if t in asking and s in held]
    if near:
        told = inner.join(lab.withColumnRenamed("node", "_k").hint("merge"), "_k").select("_v", "lbl", "_tile")
        border = index._met(outer, told, near, least, f"node {ktype}, blbl {ktype}").groupBy("node").agg(F.min("blbl").alias("blbl"))
        out = out.join(border.hint("merge"), "node", "left")
    else:
        out = out.withColumn("blbl", F.lit(None).cast(ktype))
    return out.select(F.col("node").alias(key), F.coalesce("lbl", "blbl", F.lit(-1)).cast("long").alias("cluster"))


# ------------------------------------------------------------------ R5 SMOTE-NC

def smotenc_oversample(df: DataFrame, key: str, label: str, continuous: Sequence[str], categorical: Sequence[str],
                       targets: dict, k: int = 5, seed: int = 42, **kw) -> DataFrame:
    """Grow the listed classes to their target size with synthetic rows.
    Continuous = x + u * (neighbour - x); categorical = most frequent value
    among the k neighbours (ties: smallest). Distance: Euclidean on the
    continuous features plus, per categorical mismatch, the median of the
    class's continuous stds (squared) -- realised by one-hot coordinates
    scaled by median/sqrt(2), so the exact index applies. Base rows,
    neighbours and u come from md5(seed:class:i), so runs are reproducible."""
    from .ranks import seeded_rank
    from .resample import class_counts
    counts = class_counts(df, label)
    short = {cls: int(target) - counts.get(cls, 0) for cls, target in targets.items()}
    short = {cls: need for cls, need in short.items() if need > 0}
    if not short:
        return df
    if any(not counts.get(cls) for cls in short):
        raise ValueError("no points")
    spark, kk = df.sparkSession, {cls: max(1, min(k, counts[cls] - 1)) for cls in short}
    # all classes grow at once: a class is told by its number, and neighbours are looked for within it
    small = F.broadcast(spark.createDataFrame(
        [(cls, i, str(cls), list(targets).index(cls), need, counts[cls], kk[cls]) for i, (cls, need) in enumerate(short.items())],
        StructType([StructField("_cls", df.schema[label].dataType), *StructType.fromDDL("_c int, _name string, _at bigint, _need bigint, _n bigint, _kk bigint").fields])))
    part = df.join(small.select("_cls", "_c"), F.col(q(label)) == F.col("_cls")).drop("_cls")
    coords = [f"CAST({q(c)} AS DOUBLE)" for c in continuous]
    if categorical:  # how far a mismatch is, which nothing else asks for
        med = {}
        for r in part.groupBy("_c").agg(*[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(continuous)]).collect():
            vals = sorted(float(r[f"s{i}"] or 0.0) for i in range(len(continuous)))
            med[r["_c"]] = vals[len(vals) // 2] if len(vals) % 2 else (vals[len(vals) // 2 - 1] + vals[len(vals) // 2]) / 2.0
        far = F.broadcast(spark.createDataFrame([(c, m / math.sqrt(2)) for c, m in med.items()], "_c int, _far double"))
        part = part.join(far, "_c")
        for i, c in enumerate(categorical):
            values = sorted({r[0] for r in part.select(q(c)).distinct().collect() if r[0] is not None})
            part = part.withColumn(f"_m{i}", F.array(*[F.when(F.col(q(c)) == F.lit(v), F.col("_far")).otherwise(F.lit(0.0)) for v in values]).cast("array<double>"))
    vec = F.expr(f"array({', '.join(coords)})")
    pv = part.withColumn("_vec", F.concat(vec, *[F.col(f"_m{i}") for i in range(len(categorical))]) if categorical else vec)
    points = pv.select(F.struct("_c", F.col(q(key)).alias("k")).alias("_id"), "_vec", "_c")  # a key may stand in more than one class
    dealt = [points.where(F.col("_c") % CLASSES_AT_ONCE == i) for i in range(min(CLASSES_AT_ONCE, len(short)))]
    with ThreadPoolExecutor(max_workers=CLASSES_AT_ONCE) as pool:
        nn = functools.reduce(DataFrame.unionAll, pool.map(lambda x: knn_join(x, "_id", "_vec", max(kk.values()), group="_c", **kw), dealt))
    nn = nn.select(F.col("key._c").alias("_c"), F.col("key.k").alias(key), F.col("nbr.k").alias("_nbr"), F.col("rank").alias("_nr"))
    base = seeded_rank(pv.select("_c", q(key)), seed, key, "_c", out="_pos")
    gen = spark.range(max(short.values())).select(F.col("id").alias("i")).crossJoin(small).where("i < _need")
    gen = gen.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_name"), F.col("i").cast("string"))))
    gen = gen.withColumn("_pos", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("_n")) + 1)
    gen = gen.withColumn("_nr", (F.conv(F.substring("_h", 9, 8), 16, 10).cast("long") % F.col("_kk")) + 1)
    gen = gen.withColumn("_u", F.conv(F.substring("_h", 17, 8), 16, 10).cast("double") / float(16 ** 8))
    g = gen.join(base, ["_c", "_pos"]).join(nn, ["_c", key, "_nr"])
    features = "named_struct(" + ", ".join(f"'f{i}', {q(c)}" for i, c in enumerate(continuous)) + ")"
    x = pv.selectExpr("_c", q(key), f"{features} AS _x")  # one column through the joins
    y = pv.selectExpr("_c", f"{q(key)} AS _nbr", f"{features} AS _y")
    g = g.join(x, ["_c", key]).join(y, ["_c", "_nbr"])
    # categorical: mode over the base row's k neighbours
    modes = None
    for c in categorical:
        m = (nn.join(small.select("_c", "_kk"), "_c").where("_nr <= _kk").select("_c", q(key), "_nbr")
             .join(part.select("_c", F.col(q(key)).alias("_nbr"), F.col(q(c)).alias("_cv")), ["_c", "_nbr"])
             .groupBy("_c", q(key), "_cv").agg(F.count(F.lit(1)).alias("_cn"))
             .groupBy("_c", q(key)).agg(F.min(F.struct((-F.col("_cn")).alias("n"), F.col("_cv").alias("v")))["v"].alias(c)))
        modes = m if modes is None else modes.join(m, ["_c", key])
    if modes is not None:
        g = g.join(modes, ["_c", key])
    syn = g.select(
        F.concat(F.lit("syn:"), F.col("_name"), F.lit(":"), F.col("i").cast("string")).alias(key) if dict(df.dtypes)[key] == "string"
        else (-(F.col("i") + 1) - F.lit(10 ** 12) * F.col("_at")).alias(key),
        F.col("_cls").alias(label),
        *[F.expr(f"_x.f{i} + _u * (_y.f{i} - _x.f{i})").alias(c) for i, c in enumerate(continuous)],
        *[F.col(q(c)) for c in categorical])
    return df.unionByName(syn, allowMissingColumns=True)


def hybrid_resample(df: DataFrame, key: str, label: str, continuous: Sequence[str], categorical: Sequence[str], target: int,
                    k: int = 5, seed: int = 42, out: str = "position", **kw) -> DataFrame:
    """Every class at ``target`` rows: larger classes are undersampled,
    smaller ones grown by SMOTE-NC; ``out`` numbers the rows in seeded
    shuffled order (1-based). Rows without a label stay out."""
    from .ranks import seeded_rank
    from .resample import class_counts, random_undersample
    df = df.filter(F.col(q(label)).isNotNull())
    counts = class_counts(df, label)
    large = {c: target for c, n in counts.items() if n > target}
    small = {c: target for c, n in sorted(counts.items(), key=lambda x: str(x[0])) if n < target}
    even = random_undersample(df, label, key, large, seed) if large else df
    if small:
        even = saved(even)  # growing reads it many times
        even = saved(smotenc_oversample(even, key, label, continuous, categorical, small, k, seed, **kw))
    return seeded_rank(even, seed, key, out=out)
