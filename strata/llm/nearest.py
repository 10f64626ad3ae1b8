"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Vectors of the sample that the trees' planes are fitted on, and trees.
SAMPLE, TREES = 20_000, 8
#: Rows that a leaf should hold, the fewest leaves of a tree, and the fewest sample vectors for a leaf.
LEAF_ROWS, FEWEST_LEAVES, LEAF_SAMPLE = 512, 16, 16
#: The share of a query's neighbours that its leaves should hold, and sample vectors that are searched to find out how far to go.
RECALL, PROBES = 0.97, 100
#: Rows of a leaf that one task compares at once.
BLOCK_ROWS = 20_000


@dataclass
class Tree:
    """Planes (normal, threshold) with the numbers of the nodes on their two sides; a leaf has -1."""

    normals: np.ndarray
    thresholds: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.below[node] < 0:
                at[rows] = node
                continue
            side = vectors[rows] @ self.normals[node] > self.thresholds[node]
            todo += [(self.below[node], rows[~side]), (self.above[node], rows[side])]
        return at


def fit_tree(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
    """Split at the median along the line through two random vectors until ``leaves`` parts are made (or one cannot be split)."""
    least = max(1, len(sample) // leaves)
    normals, thresholds, below, above = [], [], [], []

    def add(rows: np.ndarray) -> int:
        node = len(below)
        normals.append(np.zeros(sample.shape[1]))
        for c, v in ((thresholds, 0.0), (below, -1), (above, -1)):
            c.append(v)
        if len(rows) <= 1.5 * least:
            return node
        for _ in range(5):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            if not (length := np.linalg.norm(a - b)):
                continue
            along = sample[rows] @ ((a - b) / length)
            side = along > (cut := np.median(along))
            if side.any() and not side.all():
                normals[node], thresholds[node] = (a - b) / length, cut
                below[node] = add(rows[~side])
                above[node] = add(rows[side])
                return node
        return node

    add(np.arange(len(sample)))
    return Tree(np.asarray(normals), np.asarray(thresholds), np.asarray(below), np.asarray(above))


def nearest_leaves(forest: list[Tree], sizes: dict[tuple[int, int], int], total: int, vector: np.ndarray):
    """(tree, leaf, taken, missed) for one query, from one queue over all trees ordered by the distance to the planes on the way:
    the most rows of one tree that were taken, and the share of rows that would be missed if trees were independent."""
    queue, taken = [(0.0, t, 0) for t in range(len(forest))], [0] * len(forest)
    while queue:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        if tree.below[node] < 0:
            if n := sizes.get((t, node), 0):
                taken[t] += n
                yield t, node, max(taken), float(np.prod([1 - x / total for x in taken]))
            continue
        gap = float(vector @ tree.normals[node] - tree.thresholds[node])
        heapq.heappush(queue, (max(far, gap) if gap > 0 else far, t, int(tree.below[node])))
        heapq.heappush(queue, (max(far, -gap) if gap <= 0 else far, t, int(tree.above[node])))


def visits(forest: list[Tree], sizes: dict[tuple[int, int], int], total: int, vector: np.ndarray, coverage: float, least: int) -> list[tuple[int, int]]:
    """Leaves for one query, until they reach ``coverage`` and one tree's hold ``least`` rows."""
    out = []
    for t, node, taken, missed in nearest_leaves(forest, sizes, total, vector):
        out.append((t, node))
        if missed <= 1 - coverage and taken >= least:
            break
    return out


def needed_coverage(forest: list[Tree], data: np.ndarray, k: int, recall: float, probes: int = PROBES) -> float:
    """The coverage that finds the share ``recall`` of the ``k`` nearest sample vectors of the first ``probes`` ones. Vectors
    with structure need little of the table, vectors without much of it; the sample is searched exactly to know."""
    at = [tree.leaves(data) for tree in forest]
    sizes = {(t, int(leaf)): int(n) for t, own in enumerate(at) for leaf, n in zip(*np.unique(own, return_counts=True))}
    if len(data) <= 4 * k:
        return 1.0
    needed = []
    for i in range(min(probes, len(data))):
        far = np.square(data - data[i]).sum(axis=1)
        far[i] = np.inf
        near = np.argpartition(far, k)[:k]
        left = dict.fromkeys(near.tolist())
        for t, leaf, _, missed in nearest_leaves(forest, sizes, len(data), data[i]):
            for x in [x for x in left if at[t][x] == leaf]:
                del left[x]
                needed.append(1 - missed)
            if not left:
                break
    return float(np.quantile(needed, recall, method="higher"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, not zero."""
    v, fine = F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", coverage: float | None = None,
            recall: float = RECALL, sample: int = SAMPLE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 5) -> DataFrame:
    """The ``k`` nearest found of all other rows for each row that meets ``is_query`` (a condition on ``vec_id``):
    query_id, rank (from 1), vec_id, score (Euclidean distance in double precision, on the original vectors);
    nearest first, ties to the smaller vec_id.

    1. Equal vectors become one row with their k + 1 smallest distinct ids and how often each stands there (more can
       be in no result), counted and limited before the shuffle, so a vector that a third of all rows have is one row.
    2. ``trees`` trees are fitted on at most ``sample`` vectors (the first by a hash), which come to the driver; every
       vector is put in a leaf of each tree. Leaves grow in number with the rows, up to what the sample can tell apart;
       a leaf's rows are dealt to blocks of about ``block_rows``.
    3. A query takes leaves of all trees from one priority queue until they reach ``coverage``: unless given, what
       ``recall`` of the neighbours of some sample vectors, searched exactly within the sample, needs. Those leaves' rows are
       compared exactly, and each block sends on the nearest only that leave k whichever single id is taken out.

    Rows with null id, or with a vector that is null, zero or holds null or non-finite components, take no part,
    as candidates or queries; neither do vectors of another length than the most frequent. Repeated ids stay
    rows of their own as candidates, but an id is never its own neighbour. With too few candidates all are
    returned. Other columns are not used. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vec")).where(F.col("vec_id").isNotNull() & usable("vec"))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dim = lengths["d"]
    rows = rows.where(F.size("vec") == dim).withColumn("h", F.xxhash64("vec"))
    counted = rows.groupBy("h", "vec", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    smallest = counted.withColumn("r", F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = smallest.groupBy("h", "vec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    points = written(points.select("h", "vec", "ids", F.monotonically_increasing_id().alias("node")), "points")
    asked = written(rows.where(is_query).select("vec_id", "h", "vec").join(points.select("h", "vec", "node"), ["h", "vec"]).select("vec_id", "node").distinct(), "asked")
    own = asked.groupBy("vec_id").count().agg(F.max("count").alias("n")).first()["n"] or 0  # most vectors of one query id

    leaves = max(FEWEST_LEAVES, points.count() // leaf_rows)
    forest, data = fitted(points, dim, sample, trees, leaves, seed)
    if coverage is None:
        coverage = needed_coverage(forest, data, k, recall)
    only = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]).alias("only")
    placed = written(points.select("node", "vec", only).mapInArrow(_placer(forest, dim), "tree int, leaf int, node bigint, only bigint, vec " + points.schema["vec"].dataType.simpleString()), "leaves")
    sizes = {(r["tree"], r["leaf"]): r["count"] for r in placed.groupBy("tree", "leaf").count().collect()}  # at most trees * 2 * sample / LEAF_SAMPLE
    total = sum(n for (t, _), n in sizes.items() if t == 0)
    blocks = max(1, -(-max(sizes.values(), default=1) // block_rows))

    queries = points.join(asked.select("node").distinct(), "node").select("node", "vec")
    visited = queries.mapInArrow(_searcher(forest, sizes, total, dim, coverage, k + own), placed.drop("only").schema).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    candidates = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    keys = ["tree", "leaf", "block"]
    near = visited.groupBy(keys).cogroup(candidates.groupBy(keys)).applyInArrow(_comparer(dim, k), "query bigint, node bigint, score double")

    # Of each id its k nearest rows, and of those the k + 1 nearest ids: whichever is the query's own, k rows are left.
    best = near.groupBy("query", "node").agg(F.min("score").alias("score"))
    best = best.join(points.select("node", "ids"), "node").select("query", "score", F.inline("ids"))
    best = best.groupBy("query", "vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "times"))), 1, k).alias("rows"))
    best = best.withColumn("f", F.row_number().over(Window.partitionBy("query").orderBy(F.col("rows")[0]["score"], "vec_id"))).where(F.col("f") <= k + 1)
    found = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(best, "query").where("query_id != vec_id")
    found = found.select("query_id", "vec_id", F.inline("rows")).select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "times")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(points: DataFrame, dim: int, sample: int, trees: int, leaves: int, seed: int) -> tuple[list[Tree], np.ndarray]:
    """The forest, on the driver, from a sample of bounded size, and that sample."""
    chosen = points.select("h", "vec").orderBy(F.xxhash64("h"), "h").limit(sample).select("vec").toArrow()
    data = matrix(chosen["vec"], dim)
    leaves = max(2, min(leaves, len(data) // LEAF_SAMPLE))
    return [fit_tree(data, leaves, np.random.default_rng(seed + t)) for t in range(trees)], data


def _placer(forest: list[Tree], dim: int):
    def rows(batches):
        for b in batches:
            data = matrix(b.column(1), dim)
            for t, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), t, dtype=np.int32)), pa.array(tree.leaves(data).astype(np.int32)), b.column(0), b.column(2), b.column(1)], names=["tree", "leaf", "node", "only", "vec"])
    return rows


def _searcher(forest: list[Tree], sizes: dict[tuple[int, int], int], total: int, dim: int, coverage: float, least: int):
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                data = matrix(b.column(1), dim)
                seen = [visits(forest, sizes, total, v, coverage, least) for v in data]
                own = pa.array(np.repeat(np.arange(len(data)), [len(s) for s in seen]))
                flat = [x for s in seen for x in s]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in flat], pa.int32()), pa.array([n for _, n in flat], pa.int32()), b.column(0).take(own), b.column(1).take(own)], names=["tree", "leaf", "node", "vec"])
    return rows


def nearest_rows(score: np.ndarray, ids: np.ndarray, single: np.ndarray, k: int) -> np.ndarray:
    """The nearest rows, with all that tie with the last, that hold ``k`` with another id whichever one id is taken out;
    ``ids`` is for rows of a single id. More than ``k`` rows of one single id are not needed, but for ties."""
    size = k + 1
    while True:
        best = np.flatnonzero(score <= np.partition(score, min(size, len(score)) - 1)[min(size, len(score)) - 1])
        best = best[np.argsort(score[best], kind="stable")]
        # How many rows of its own single id come up to each row.
        alone = single[best]
        times = np.zeros(len(best), dtype=np.int64)
        order = np.argsort(ids[best[alone]], kind="stable")
        ranked = ids[best[alone]][order]
        new = np.ones(len(ranked), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        place = np.arange(len(ranked))
        back = np.empty(len(ranked), dtype=np.int64)
        back[order] = place - np.maximum.accumulate(np.where(new, place, 0)) + 1
        times[alone] = back
        enough = np.flatnonzero(np.arange(1, len(best) + 1) - np.maximum.accumulate(times) >= k)
        if len(enough) or size >= len(score):
            last = score[best[enough[0]]] if len(enough) else np.inf
            return best[(times <= k) & (score[best] <= last)]
        size *= 4


def _comparer(dim: int, k: int):
    def compare(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and points.num_rows:
            nodes, data = points["node"].to_numpy(), matrix(points["vec"], dim)
            ids, single = points["only"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), points["only"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            for query, vector in zip(queries["node"].to_pylist(), matrix(queries["vec"], dim)):
                score = np.sqrt(np.square(data - vector).sum(axis=1))
                # All that tie with the last too: of equal ones the smallest ids are chosen later.
                best = nearest_rows(score, ids, single, k)
                out[0].append(np.full(len(best), query, dtype=np.int64))
                out[1].append(nodes[best])
                out[2].append(score[best])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table(dict(zip(("query", "node", "score"), (pa.array(np.concatenate([np.empty(0, t), *c]).astype(t)) for t, c in zip(kinds, out)))))
    return compare
