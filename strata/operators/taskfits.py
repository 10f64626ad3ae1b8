"""Fits that a task makes on its own, for tables whose rows a task can hold.

MLlib starts several jobs for each level of each tree or step of a descent, which is most of the time of a fit while its rows
fit a task. Here a fit is one job: every task gets all rows once, grows its share of the trees in numpy and hands them on
packed. The models are those that MLlib fits for the same settings: thresholds at weighted quantiles of at most 32 bins,
weighted impurities, the least rows of a node, leaves of one answer merged; SAMME finds its thresholds anew each round, as the
weights change. Trees draw from generators of their own (seed and number), and rows are put in order of a hash first, so a
model does not depend on how rows and trees were dealt.
"""

from __future__ import annotations

import io
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .select import q

#: Cells (rows x features) of a training table that a task holds.
TASK_CELLS = 1 << 24
#: Bins of a feature, as MLlib has them.
BINS = 32
#: Numbers that the histograms of one step have at most.
AT_ONCE = 1 << 21
#: Rows whose answers to the cuts that their nodes draw are held at once.
ROWS_AT_ONCE = 1 << 11
#: Smallest impurity of a node that is split.
PURE = 2.0 ** -52


class Rows:
    """Classes, weights and counts of the rows that a tree is grown on. ``each``: the weight of a class, where its rows weigh alike."""

    def __init__(self, y: np.ndarray, w: np.ndarray, classes: int, count: np.ndarray | None = None):
        self.y, self.classes, self.count = y.astype(np.int64), classes, count
        self.w = w if count is None else w * count
        least, most = np.full(classes, np.inf), np.full(classes, -np.inf)
        np.minimum.at(least, self.y, w)
        np.maximum.at(most, self.y, w)
        self.each = np.where(np.isfinite(least), least, 0.0) if (least >= most).all() else None

    def tally(self, r: np.ndarray) -> Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
        """Tells weights by class (size x classes) and numbers (size) of the rows ``r`` that are counted at places
        (place * classes + class)."""
        count, w, k = None if self.count is None else self.count[r], None if self.each is not None else self.w[r], self.classes

        def told(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            n = np.bincount(at, count, size * k).reshape(size, k)
            return n * self.each if w is None else np.bincount(at, w, size * k).reshape(size, k), n.sum(axis=1)

        return told


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.where(x > 0, x, 1.0))


def _spread(w: np.ndarray, impurity: str) -> np.ndarray:
    """Weight times impurity of class weights in the last axis."""
    total = w.sum(axis=-1)
    if impurity == "entropy":
        return _xlogx(total) - _xlogx(w).sum(axis=-1)
    return total - (w * w).sum(axis=-1) / np.where(total > 0, total, 1.0)


class Tree:
    """Nodes of a tree as arrays; the right child follows the left one, a leaf has no left child (-1)."""

    def __init__(self, feature, threshold, left, weight, n, impurity):
        self.feature, self.threshold, self.left, self.weight, self.n, self.impurity = feature, threshold, left, weight, n, impurity

    def merged(self, ends: Sequence[int]) -> Tree:
        """Leaves of one parent that give one answer become their parent; what no node leads to any more is left out.
        ``ends``: where each level of nodes ends."""
        left, answer = self.left.copy(), self.weight.argmax(axis=1)
        for a, b in reversed([*zip([0, *ends], ends)]):
            inner = a + np.nonzero(left[a:b] >= 0)[0]
            l, r = left[inner], left[inner] + 1
            left[inner[(left[l] < 0) & (left[r] < 0) & (answer[l] == answer[r])]] = -1
        kept = np.zeros(len(left), dtype=bool)
        kept[0] = True
        for a, b in zip([0, *ends], ends):
            inner = a + np.nonzero(kept[a:b] & (left[a:b] >= 0))[0]
            kept[left[inner]] = kept[left[inner] + 1] = True
        number = np.cumsum(kept) - 1
        left = np.where(left >= 0, number[left], -1)[kept]
        return Tree(np.where(left >= 0, self.feature[kept], -1), np.where(left >= 0, self.threshold[kept], 0.0), left, self.weight[kept], self.n[kept], self.impurity[kept])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: left where a value is at most the threshold (nothing compares with NaN, which goes right)."""
        at, going = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(going):
            here = at[going]
            inner = self.left[here] >= 0
            going, here = going[inner], here[inner]
            at[going] = self.left[here] + ~(x[going, self.feature[here]] <= self.threshold[here])
        return at

    def node_rows(self) -> list[dict]:
        """Nodes as ``models.prune_rows`` and ``forest_expression`` have them."""
        total = np.where(self.weight.sum(axis=1) > 0, self.weight.sum(axis=1), 1.0)[:, None]
        return [{"id": i, "left": int(l), "right": int(l) + 1 if l >= 0 else -1, "fi": int(f), "thr": float(t) if l >= 0 else None, "pred": int(np.argmax(w)),
                 "probs": p.tolist(), "impurity": float(g), "n": int(n)}
                for i, (f, t, l, w, p, n, g) in enumerate(zip(self.feature, self.threshold, self.left, self.weight, self.weight / total, self.n, self.impurity))]


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def grow(rows: Rows, codes: np.ndarray, thresholds: Sequence[np.ndarray], search: Search, impurity: str, depth: int) -> tuple[Tree, np.ndarray]:
    """A tree, level by level, and the leaf of each row before leaves were merged. ``codes`` (features x rows): thresholds below
    a value; ``search`` (rows sorted by node and class, their node, weights and numbers of the nodes) -> gain, feature, code of the best split."""
    k = rows.classes
    r = np.arange(len(rows.y)) if rows.count is None else np.nonzero(rows.count)[0]
    r = r[np.argsort(rows.y[r], kind="stable")]
    pos, first = np.zeros(len(r), dtype=np.int64), 0
    weight, n = rows.tally(r)(rows.y[r], 1)
    where = np.zeros(len(rows.y), dtype=np.int64)
    parts, ends = [], []
    for level in range(depth + 1):
        m = len(n)
        imp = _spread(weight, impurity) / np.where(weight.sum(axis=1) > 0, weight.sum(axis=1), 1.0)
        feature, threshold, left = np.full(m, -1, dtype=np.int32), np.zeros(m), np.full(m, -1, dtype=np.int64)
        parts.append((feature, threshold, left, weight, n, imp))
        ends.append(first + m)
        open_ = np.nonzero((imp >= PURE) & (n >= 2))[0] if level < depth else []
        if not len(open_):
            break
        number = np.full(m, -1, dtype=np.int64)
        number[open_] = np.arange(len(open_))
        keep = number[pos] >= 0
        r, pos = r[keep], number[pos[keep]]
        gain, f, code = search(r, pos, weight[open_], n[open_])
        split = np.nonzero(gain > 0)[0]
        if not len(split):
            break
        feature[open_[split]] = f[split]
        threshold[open_[split]] = [thresholds[a][b] for a, b in zip(f[split], code[split])]
        left[open_[split]] = first + m + 2 * np.arange(len(split))
        number = np.full(len(open_), -1, dtype=np.int64)
        number[split] = np.arange(len(split))
        keep = number[pos] >= 0
        r, pos = r[keep], pos[keep]
        pos = 2 * number[pos] + (codes[f[pos], r] > code[pos])
        order = np.argsort(pos.astype(np.uint16) if 2 * len(split) <= 1 << 16 else pos, kind="stable")
        r, pos, first = r[order], pos[order], first + m
        where[r] = first + pos
        weight, n = rows.tally(r)(pos * k + rows.y[r], 2 * len(split))
    return Tree(*[np.concatenate(x) for x in zip(*parts)]).merged(ends), where


def _gains(lw: np.ndarray, ln: np.ndarray, weight: np.ndarray, n: np.ndarray, impurity: str, leaf: int) -> np.ndarray:
    """Gain of splits with class weights ``lw`` (.., classes) and ``ln`` rows at the left of nodes with ``weight`` and ``n``."""
    total = weight.sum(axis=-1)
    parent = _spread(weight, impurity)
    gain = (parent - _spread(lw, impurity) - _spread(np.maximum(weight - lw, 0.0), impurity)) / total
    return np.where((ln >= leaf) & (n - ln >= leaf) & (gain >= 0), gain, -np.inf)


def binned_search(rows: Rows, codes: np.ndarray, splits: np.ndarray, impurity: str, leaf: int, subset: int | None = None, rng: np.random.Generator | None = None) -> Search:
    """All thresholds of all features of a node, or of ``subset`` features that it draws."""
    features, bins, k = len(codes), int(splits.max(initial=0)) + 1, rows.classes

    def some(r, pos, weight, n):
        m, tally = len(n), rows.tally(r)
        at = rows.y[r] + pos * (bins * k)
        lw, ln = np.empty((m, features, bins - 1, k)), np.empty((m, features, bins - 1))
        for f in range(features):
            w, c = tally(at + codes[f][r].astype(np.int64) * k, m * bins)
            lw[:, f], ln[:, f] = w.reshape(m, bins, k).cumsum(axis=1)[:, :-1], c.reshape(m, bins).cumsum(axis=1)[:, :-1]
        gain = _gains(lw, ln, weight[:, None, None], n[:, None, None], impurity, leaf)
        gain[:, np.arange(bins - 1)[None, :] >= splits[:, None]] = -np.inf
        if subset is not None and subset < features:
            out = np.argsort(rng.random((m, features)), axis=1)[:, subset:]
            gain[np.arange(m)[:, None], out] = -np.inf
        gain = gain.reshape(m, -1)
        best = gain.argmax(axis=1)
        return gain[np.arange(m), best], best // (bins - 1), best % (bins - 1)

    def search(r, pos, weight, n):
        if bins == 1:
            return np.full(len(n), -np.inf), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        return _in_parts(some, max(1, AT_ONCE // (features * bins * k)), r, pos, weight, n)

    return search


def _in_parts(some: Search, step: int, r, pos, weight, n):
    """``search`` for some nodes after others, so that what it holds is bounded."""
    found = []
    for a in range(0, len(n), step):
        i, j = np.searchsorted(pos, [a, a + step])
        found.append(some(r[i:j], pos[i:j] - a, weight[a:a + step], n[a:a + step]))
    return tuple(np.concatenate(x) for x in zip(*found))


def drawn(rng: np.random.Generator, m: int, size: int, of: int) -> np.ndarray:
    """``size`` different numbers below ``of`` for each of m nodes, all sets alike (Floyd's way, for all nodes at once)."""
    taken, out, node = np.zeros((m, of), dtype=bool), np.empty((m, size), dtype=np.int64), np.arange(m)
    for i, last in enumerate(range(of - size, of)):
        t = rng.integers(0, last + 1, m)
        t = np.where(taken[node, t], last, t)
        taken[node, t] = True
        out[:, i] = t
    return out


def drawn_search(rows: Rows, codes: np.ndarray, cuts: np.ndarray, impurity: str, leaf: int, size: int, rng: np.random.Generator) -> Search:
    """``size`` random ones of ``cuts`` (feature, code) for each node: extra trees."""
    k, by_row, features = rows.classes, np.ascontiguousarray(codes.T).ravel(), len(codes)
    alike = rows.each is not None

    def some(r, pos, weight, n):
        m = len(n)
        pick = drawn(rng, m, size, len(cuts))
        feature, code = cuts[pick, 0], cuts[pick, 1].astype(codes.dtype)
        lw = np.zeros((m, k, size))
        ln = lw if alike else np.zeros((m, k, size))
        for a in range(0, len(r), ROWS_AT_ONCE):
            part, node = r[a:a + ROWS_AT_ONCE], pos[a:a + ROWS_AT_ONCE]
            inside = (by_row.take((part * features)[:, None] + feature[node], mode="clip") <= code[node]).astype(np.float32)
            group = node * k + rows.y[part]  # in order, as the rows of a node are sorted by class
            start = np.append(0, np.nonzero(np.diff(group))[0] + 1)
            at, cls = np.divmod(group[start], k)
            ln[at, cls] += np.add.reduceat(inside if rows.count is None else inside * rows.count[part][:, None], start, axis=0)
            if not alike:
                lw[at, cls] += np.add.reduceat(inside * rows.w[part][:, None], start, axis=0)
        ln, lw = ln.sum(axis=1), lw * rows.each[:, None] if alike else lw
        gain = _gains(lw.swapaxes(1, 2), ln, weight[:, None], n[:, None], impurity, leaf)
        best, at = gain.argmax(axis=1), np.arange(m)
        return gain[at, best], feature[at, best], code[at, best].astype(np.int64)

    def search(r, pos, weight, n):
        out = np.full(len(n), -np.inf), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        able = n >= 2 * leaf  # others have no split with enough rows at both sides
        if not able.any():
            return out
        number, keep = np.cumsum(able) - 1, able[pos]
        for o, x in zip(out, _in_parts(some, max(1, AT_ONCE // (size * k)), r[keep], number[pos[keep]], weight[able], n[able])):
            o[able] = x
        return out

    return search


# ------------------------------------------------------------------ thresholds

class Order:
    """The values of each feature in order, so that thresholds can be found for any weights."""

    def __init__(self, x: np.ndarray):
        self.shape = x.shape
        self.features = []
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable").astype(np.int32)
            v = x[order, j]
            v = v[:len(v) - np.count_nonzero(np.isnan(v))]  # NaN sorts last, and is beyond each threshold
            last = np.append(np.nonzero(v[1:] != v[:-1])[0], len(v) - 1) if len(v) else np.empty(0, dtype=np.int64)
            self.features.append((order, v[last], last))

    def bins(self, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Codes (features x rows) and thresholds: between all values where they are few, else next to quantiles of the weights."""
        most = min(BINS, self.shape[0]) - 1
        codes, thresholds = np.empty(self.shape[::-1], dtype=np.uint8), []
        for j, (order, values, last) in enumerate(self.features):
            mids = (values[:-1] + values[1:]) / 2
            if len(mids) > most:
                c = np.cumsum(w[order[:last[-1] + 1]])[last]
                want = np.searchsorted((c[:-1] + c[1:]) / 2, c[-1] / (most + 1) * np.arange(1, most + 1), side="right")
                want = np.maximum.accumulate(want - np.arange(len(want))) + np.arange(len(want))  # each at a value of its own
                want = want[want < len(mids)]
            else:
                want = np.arange(len(mids))
            edge = last[want] + 1
            codes[j, order] = np.repeat(np.arange(len(edge) + 1, dtype=np.uint8), np.diff([0, *edge, len(order)]))
            thresholds.append(mids[want])
        return codes, thresholds


# ------------------------------------------------------------------ fits

def _settings(p: Mapping) -> tuple[str, int, int]:
    impurity = str(p.get("impurity", "gini")).lower()
    if impurity not in ("gini", "entropy"):
        raise ValueError(f"unknown impurity {impurity!r}")
    depth, leaf = int(p.get("maxDepth", 5)), int(p.get("minInstancesPerNode", 1))
    if depth < 0 or leaf < 1:
        raise ValueError("a tree has a depth of 0 or more and a row or more in each leaf")
    return impurity, min(depth, 30), leaf


def _subset(p: Mapping, features: int) -> int:
    s = str(p.get("featureSubsetStrategy", "all"))
    return features if s == "all" else math.ceil(features ** 0.5) if s == "sqrt" else math.ceil(float(s) * features)


def forest(x, y, w, classes: int, p: Mapping, seed: int, mine: Sequence[int]) -> list[Tree]:
    """The trees number ``mine`` of a random forest: each over rows drawn with replacement (Poisson, one a row on average)."""
    impurity, depth, leaf = _settings(p)
    codes, thresholds = Order(x).bins(w)
    splits, subset, out = np.asarray([len(t) for t in thresholds]), _subset(p, x.shape[1]), []
    for i in mine:
        rng = np.random.default_rng([seed, i])
        rows = Rows(y, w, classes, rng.poisson(1.0, len(y)).astype(float))
        if not rows.count.any():
            rows = Rows(y, w, classes)
        out.append(grow(rows, codes, thresholds, binned_search(rows, codes, splits, impurity, leaf, subset, rng), impurity, depth)[0])
    return out


def one_tree(x, y, w, classes: int, p: Mapping, seed: int) -> Tree:
    impurity, depth, leaf = _settings(p)
    codes, thresholds = Order(x).bins(w)
    rows = Rows(y, w, classes)
    return grow(rows, codes, thresholds, binned_search(rows, codes, np.asarray([len(t) for t in thresholds]), impurity, leaf), impurity, depth)[0]


def extra_trees(x, y, w, classes: int, p: Mapping, seed: int, mine: Sequence[int]) -> list[Tree]:
    """The trees number ``mine``: no rows drawn, each node takes the best of as many random cuts as it has features to look at.
    ``cuts`` random cuts a feature, uniform between its least and greatest value; no value (-inf here) is below each cut."""
    impurity, depth, leaf = _settings(p)
    cuts, share = int(p.get("cuts", 16)), str(p.get("featureSubsetStrategy", "all"))
    share = 1.0 if share == "all" else x.shape[1] ** -0.5 if share == "sqrt" else float(share)
    draw, thresholds, known = random.Random(seed), [], x > -np.inf
    for j in range(x.shape[1]):
        v = x[:, j][known[:, j] | np.isnan(x[:, j])]
        lo, hi = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
        thresholds.append(np.asarray(sorted(draw.uniform(lo, hi) for _ in range(cuts)) if hi > lo else []))
    codes = np.stack([np.searchsorted(t, x[:, j], side="left") for j, t in enumerate(thresholds)]).astype(np.uint8 if cuts < 256 else np.int32)
    every = np.asarray([(j, c) for j, t in enumerate(thresholds) for c in range(len(t))], dtype=np.int64).reshape(-1, 2)
    rows, out = Rows(y, w, classes), []
    size = min(len(every), math.ceil(min(1.0, share / max(cuts, 1)) * len(every)))
    for i in mine:
        rng = np.random.default_rng([seed, i])
        search = drawn_search(rows, codes, every, impurity, leaf, size, rng) if size else binned_search(rows, codes, np.zeros(len(codes), dtype=int), impurity, leaf)
        out.append(grow(rows, codes, thresholds, search, impurity, depth)[0])
    return out


def boosted(x, y, w, classes: int, p: Mapping, seed: int) -> tuple[list[Tree], list[float]]:
    """SAMME: trees over boosted weights times ``w``, and how much each one says (as ``models._fit_samme``)."""
    impurity, depth, leaf = _settings(p)
    rate, order, own = float(p.get("learningRate", 1.0)), Order(x), np.full(len(y), 1.0 / len(y))
    trees, says = [], []
    for _ in range(int(p.get("rounds", 50))):
        codes, thresholds = order.bins(own * w)
        rows = Rows(y, own * w, classes)
        tree, _ = grow(rows, codes, thresholds, binned_search(rows, codes, np.asarray([len(t) for t in thresholds]), impurity, leaf), impurity, depth)
        miss = tree.weight.argmax(axis=1)[tree.leaves(x)] != y
        e = float(own[miss].sum() / own.sum())
        if math.isnan(e) or e >= 1.0 - 1.0 / classes:
            if not trees:
                trees, says = [tree], [1.0]
            break
        trees.append(tree)
        if e <= 0:
            says.append(1.0)
            break
        says.append(rate * (math.log((1.0 - e) / e) + math.log(classes - 1)))
        own = own * np.where(miss, math.exp(says[-1]), 1.0)
        own /= own.sum()
    return trees, says


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def logistic(x, y, w, classes: int, p: Mapping) -> np.ndarray:
    """Weights (features + 1 x classes, the last row for the intercepts, which nothing holds back) of the multinomial logistic
    model: mean weighted loss + the penalty of ``models._fit``, by accelerated proximal steps that start again where they overshoot."""
    total = float(w.sum())
    reg, l1 = 1.0 / (float(p.get("C", 1.0)) * total), p.get("penalty", "l2") == "l1"
    z = np.column_stack([x, np.ones(len(x))])
    rows, share = np.arange(len(y)), w / total
    step = 1.0 / (0.5 * float(np.linalg.eigvalsh((z * share[:, None]).T @ z)[-1]) + (0.0 if l1 else reg) + 1e-12)
    held = np.append(np.full(x.shape[1], reg), 0.0)[:, None]
    at = np.zeros((z.shape[1], classes))
    at[-1] = np.log1p(np.bincount(y, w, classes))
    at[-1] -= at[-1].mean()

    def loss(b):
        s = z @ b
        top = s.max(axis=1)
        return float(share @ (np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[rows, y])) + float((held * (np.abs(b) if l1 else b * b / 2)).sum())

    ahead, pace, value, calm = at, 1.0, loss(at), 0
    for _ in range(10 * int(p.get("maxIter", 200))):
        probs = _softmax(z @ ahead)
        probs[rows, y] -= 1.0
        to = ahead - step * (z.T @ (probs * share[:, None]) + (0.0 if l1 else held * ahead))
        if l1:
            to = np.sign(to) * np.maximum(np.abs(to) - step * held, 0.0)
        new = loss(to)
        if new > value and pace > 1.0:  # overshot
            ahead, pace = at, 1.0
            continue
        calm = calm + 1 if value - new <= 1e-10 * max(abs(new), 1e-12) else 0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, at, pace, value = to + (pace - 1) / faster * (to - at), to, faster, new
        if calm >= 5:
            break
    return at


# ------------------------------------------------------------------ packed models

def pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def pack_trees(trees: Sequence[Tree], says: Sequence[float] | None = None) -> bytes:
    """Trees one after the other; each leaf has its class probabilities."""
    leaf = [t.left < 0 for t in trees]
    weight = [t.weight[a] for t, a in zip(trees, leaf)]
    return pack(size=[len(t.left) for t in trees], says=np.asarray([1.0] * len(trees) if says is None else says),
                feature=np.concatenate([t.feature for t in trees]).astype(np.int32), threshold=np.concatenate([t.threshold for t in trees]),
                left=np.concatenate([t.left for t in trees]).astype(np.int32),
                probs=np.concatenate([v / np.where(v.sum(axis=1) > 0, v.sum(axis=1), 1.0)[:, None] for v in weight]))


class Packed:
    """What packed parts say: ``mode`` 'avg' (mean of the trees' probabilities), 'samme' (weighted votes) or 'linear'."""

    def __init__(self, parts: Sequence[bytes], mode: str):
        self.mode, self.trees, self.says, self.weights = mode, [], [], None
        for part in parts:
            a = dict(np.load(io.BytesIO(part)))
            if mode == "linear":
                self.weights = a["weights"]
                continue
            ends = np.cumsum(a["size"])
            leaf = np.cumsum(a["left"] < 0) - 1
            for i, j in zip([0, *ends], ends):
                t = Tree(a["feature"][i:j], a["threshold"][i:j], a["left"][i:j], None, None, None)
                self.trees.append((t, leaf[i:j], a["probs"]))
            self.says += a["says"].tolist()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.mode == "linear":
            return _softmax(np.column_stack([x, np.ones(len(x))]) @ self.weights)
        k = self.trees[0][2].shape[1]
        total = np.zeros((len(x), k))
        if self.mode == "avg":
            for tree, leaf, probs in self.trees:
                total += probs[leaf[tree.leaves(x)]]
            return total / np.where(total.sum(axis=1) > 0, total.sum(axis=1), 1.0)[:, None]
        every = sum(self.says) or 1.0
        for (tree, leaf, probs), says in zip(self.trees, self.says):
            vote = probs.argmax(axis=1)[leaf[tree.leaves(x)]]
            total += np.where(vote[:, None] == np.arange(k), 1.0, -1.0 / max(k - 1, 1)) * (says / every)
        return _softmax(total / max(k - 1, 1))


# ------------------------------------------------------------------ in tasks

def features_of(features: Sequence[str], kind: str) -> Column:
    """The features as an array of doubles; extra trees take no value as below every cut."""
    one = "coalesce(CAST({} AS DOUBLE), CAST('-Infinity' AS DOUBLE))" if kind == "et" else "CAST({} AS DOUBLE)"
    return F.expr(f"array({', '.join(one.format(q(c)) for c in features)})")


def _numbers(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` partitions that a hash puts there."""
    found = spark.range(64 * parts).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in found.collect())


def fit(data: DataFrame, features: Sequence[str], label: str, weight: str | None, kind: str, p: Mapping, seed: int, classes: int, parts: int = 1) -> list[bytes]:
    """The packed parts of a model of ``data`` (label: class numbers): each of ``parts`` tasks has all rows and fits its share of the trees."""
    _settings(p) if kind != "lr" else None
    trees = int(p.get("numTrees", 100)) if kind in ("rf", "et") else 1
    rows = data.select(features_of(features, kind).alias("_x"), F.col(q(label)).alias("_y"),
                       (F.col(q(weight)).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = rows.withColumn("_h", F.xxhash64(*rows.columns))
    numbers = _numbers(data.sparkSession, min(parts, trees)) if min(parts, trees) > 1 else [0]
    rows = rows.withColumn("_part", F.explode(F.array(*[F.lit(i).cast("int") for i in numbers])))
    rows = rows.repartition(len(numbers), "_part") if len(numbers) > 1 else rows.coalesce(1)
    d = len(features)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        part = table["_part"].to_numpy()
        for mine in np.unique(part):
            own = np.nonzero(part == mine)[0]
            own = own[np.argsort(table["_h"].to_numpy()[own], kind="stable")]
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), d) for c in table["_x"].chunks])[own]
            if table["_y"].null_count:
                raise ValueError("a label is none of the classes")
            if kind != "et" and not np.isfinite(x).all():  # as MLlib's vectors
                raise ValueError("features must be finite numbers")
            y, w = table["_y"].to_numpy()[own].astype(np.int64), table["_w"].to_numpy()[own]
            n = numbers.index(int(mine))
            if kind in ("rf", "et"):
                share = range(n, trees, len(numbers))
                packed = pack_trees((forest if kind == "rf" else extra_trees)(x, y, w, classes, p, seed, share))
            elif kind == "ada":
                packed = pack_trees(*boosted(x, y, w, classes, p, seed))
            elif kind == "lr":
                packed = pack(weights=logistic(x, y, w, classes, p))
            elif kind == "dt":
                from .models import prune_rows
                nodes = prune_rows(one_tree(x, y, w, classes, p, seed).node_rows(), float(p.get("ccp_alpha", 0.0) or 0.0))
                packed = pack_trees([_tree_of(nodes)])
            else:
                raise ValueError(f"unknown model kind {kind}")
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([packed], pa.binary())], names=["part", "packed"])

    got = sorted((r["part"], bytes(r["packed"])) for r in rows.mapInArrow(fitted, "part int, packed binary").collect())
    if not got:
        raise ValueError("no rows to learn from")
    return [b for _, b in got]


def _tree_of(nodes: list[dict]) -> Tree:
    """Node rows that are left after pruning as arrays, the right child after the left one."""
    by_id, order = {r["id"]: r for r in nodes}, [0]
    left = []
    for i in order:  # grows while it is read
        r = by_id[i]
        left.append(len(order) if r["left"] >= 0 else -1)
        if r["left"] >= 0:
            order += [r["left"], r["right"]]
    kept = [by_id[i] for i in order]
    inner = np.asarray(left) >= 0
    return Tree(np.where(inner, [r["fi"] for r in kept], -1), np.asarray([r["thr"] if i else 0.0 for r, i in zip(kept, inner)]), np.asarray(left),
                np.asarray([r["probs"] for r in kept]), np.asarray([r["n"] for r in kept]), np.asarray([r["impurity"] for r in kept]))


def scorer(parts: Sequence[bytes], mode: str, features: int) -> Callable[[Column], Column]:
    """A function of an array of ``features`` numbers: the class probabilities that the packed model gives."""
    parts, once = list(parts), []

    @F.arrow_udf("array<double>")
    def probabilities(x: pa.Array) -> pa.Array:
        if not once:
            once.append(Packed(parts, mode))
        out = once[0].probabilities(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), features))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return probabilities
