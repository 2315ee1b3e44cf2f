"""Trees of boxes from a bounded sample, which deal points to blocks of similar size however they are spread, and exact neighbours within a block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that a tree is built from, and the most blocks of one: what the driver holds at any size of the data.
SAMPLE, MOST_BLOCKS = 50_000, 1 << 16
#: Distances that are measured at once.
_AT_ONCE = 1 << 22
#: Targets of a leaf of the tree within a task, at least; distances to leaves that are measured at once, and queries that are answered at once.
LEAF, _LEAVES_AT_ONCE, _QUERIES_AT_ONCE = 24, 1 << 19, 1 << 14


def valid(columns: tuple[str, ...]) -> Column:
    """Neither null nor NaN."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


class Tree:
    """A balanced tree of splits, each at the median of the wider side of its sample. Blocks are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        d = sample.shape[1]
        self.depth, self.axis, self.at = depth, np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [sample]
        for level in range(depth):
            first, below = (1 << level) - 1, []
            for i, part in enumerate(parts):
                axis = int(np.argmax(part.max(0) - part.min(0))) if len(part) else level % d
                at = float(np.median(part[:, axis])) if len(part) else 0.0
                right = part[:, axis] >= at
                if right.all() and len(part):  # many at the least value: the others go right
                    right = part[:, axis] > at
                    at = float(part[right, axis].min()) if right.any() else at
                self.axis[first + i], self.at[first + i] = axis, at
                right = part[:, axis] >= at
                below += [part[~right], part[right]]
            parts = below
        self.lo = self.hi = None

    @property
    def blocks(self) -> int:
        return 1 << self.depth

    def block(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] >= self.at[node])
        return node - (self.blocks - 1)

    def bound(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Set the boxes around what each block holds, (blocks, d) each; infinite the wrong way round where it is empty."""
        levels_lo, levels_hi = [lo], [hi]
        for _ in range(self.depth):
            levels_lo.insert(0, np.minimum(levels_lo[0][0::2], levels_lo[0][1::2]))
            levels_hi.insert(0, np.maximum(levels_hi[0][0::2], levels_hi[0][1::2]))
        self.lo, self.hi = np.concatenate(levels_lo), np.concatenate(levels_hi)

    def touching(self, x: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the blocks of which the box comes as near to a row as its squared radius."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth + 1):
            gap = np.maximum(np.maximum(self.lo[node] - x[row], x[row] - self.hi[node]), 0)
            near = (gap * gap).sum(1) <= r2[row] * (1 + 1e-12)
            row, node = row[near], node[near]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
        return row, node - (self.blocks - 1)


def build(points: DataFrame, columns: tuple[str, ...], per_block: int, n: int | None = None) -> Tree:
    """A tree over ``points`` (pid, columns without null) with about ``per_block`` of them to a block, ``MOST_BLOCKS`` blocks at most."""
    n = points.count() if n is None else n
    depth = _depth(n, per_block)
    return Tree(_sample(points, columns, n) if depth else np.zeros((0, len(columns))), depth)


def _depth(n: int, per_block: int) -> int:
    return min(max(0, math.ceil(math.log2(max(1, n) / per_block))), int(math.log2(MOST_BLOCKS)))


def _sample(points: DataFrame, columns: tuple[str, ...], n: int) -> np.ndarray:
    share = SAMPLE / max(n, 1)
    rows = points.filter(F.pmod(F.xxhash64("pid"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else points
    return rows.select(*(F.col(c).cast("double") for c in columns)).limit(2 * SAMPLE).toPandas().to_numpy(float)


def split(points: DataFrame, columns: tuple[str, ...], per_block: int, narrowest: float) -> Tree:
    """A tree as ``build`` makes it, but for cuts that would leave less than ``narrowest`` on a side; it is bounded by the parts of space that its blocks cover."""
    n, d = points.count(), len(columns)
    depth = _depth(n, per_block)
    tree = Tree(np.zeros((0, d)), 0)
    tree.depth, tree.axis, tree.at = depth, np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, -np.inf)
    lo, hi, parts = np.full((1, d), -np.inf), np.full((1, d), np.inf), [_sample(points, columns, n) if depth else np.zeros((0, d))]
    for level in range(depth):
        first, below, all_lo, all_hi = (1 << level) - 1, [], np.repeat(lo, 2, 0), np.repeat(hi, 2, 0)
        for i, part in enumerate(parts):
            axis, at = 0, -np.inf
            if len(part):
                least, most = np.maximum(lo[i], part.min(0)), np.minimum(hi[i], part.max(0))
                axis = int(np.argmax(most - least))
                if most[axis] - least[axis] >= 2 * narrowest:
                    at = float(np.clip(np.median(part[:, axis]), least[axis] + narrowest, most[axis] - narrowest))
            tree.axis[first + i], tree.at[first + i] = axis, at
            right = part[:, axis] >= at
            below += [part[~right], part[right]]
            if at > -np.inf:
                all_hi[2 * i, axis] = all_lo[2 * i + 1, axis] = at
            else:  # all go right
                all_lo[2 * i], all_hi[2 * i] = np.inf, -np.inf
        lo, hi, parts = all_lo, all_hi, below
    tree.bound(lo, hi)
    return tree


def block_of(tree: Tree, columns: tuple[str, ...]) -> Column:
    """The block of a row."""
    if tree.depth == 0:
        return F.lit(0)

    @F.pandas_udf("int")
    def block(x: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.block(x.to_numpy(float)).astype(np.int32))

    return block(F.struct(*(F.col(c).cast("double").alias(c) for c in columns)))


def _first(q: np.ndarray, t: np.ndarray, d2: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query, target, squared distance) the first k of each query by distance, then by the targets' order."""
    s = np.lexsort((order[t], d2, q))
    q, t, d2 = q[s], t[s], d2[s]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    return q[keep], t[keep], d2[keep]


def _plain(targets, order, queries, own, k, r2):
    """``nearest`` by measuring all."""
    found = []
    step = max(1, _AT_ONCE // max(1, len(targets)))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        d2 = np.zeros((len(some), len(targets)))
        for c in range(targets.shape[1]):
            gap = some[:, c, None] - targets[None, :, c]
            d2 += gap * gap
        d2[own[at : at + step, None] == order[None]] = np.inf
        most = r2[at : at + step]
        if len(targets) > k:
            most = np.minimum(most, np.partition(d2, k - 1, 1)[:, k - 1])
        i, j = np.nonzero((d2 <= most[:, None]) & np.isfinite(d2))
        found.append(_first(i + at, j, d2[i, j], order, k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _leaves(targets: np.ndarray, depth: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A bounded tree that cuts targets into halves of the same size; the targets in order of its leaves, and where those begin and end."""
    n, d = targets.shape
    tree = Tree(np.zeros((0, d)), 0)
    tree.depth, tree.axis, tree.at = depth, np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    by, edges = np.arange(n), np.array([0, n])
    for level in range(depth):
        x = targets[by]
        axis = np.argmax(np.maximum.reduceat(x, edges[:-1]) - np.minimum.reduceat(x, edges[:-1]), 1)
        node = np.repeat(np.arange(1 << level), np.diff(edges))
        by = by[np.lexsort((x[np.arange(n), axis[node]], node))]
        middle = (edges[:-1] + edges[1:]) // 2
        first = (1 << level) - 1
        tree.axis[first : first + len(axis)], tree.at[first : first + len(axis)] = axis, targets[by[middle], axis]
        edges = np.sort(np.r_[edges, middle])
    x = targets[by]
    tree.bound(np.minimum.reduceat(x, edges[:-1]), np.maximum.reduceat(x, edges[:-1]))
    return tree, by, edges


def nearest(targets: np.ndarray, order: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, squared distance), sorted by query and rank, of the k nearest targets of each query within its squared radius, but for the one whose ``order`` is the query's ``own``.

    Ties go to the smaller order. Many targets are dealt to small leaves of a tree of their own; a query is measured against its own leaf, then against those that the ball of its k nearest there touches, so
    the cost stays in proportion.
    """
    leaf = max(LEAF, 2 * (k + 1))
    if len(targets) < 4 * leaf or not len(queries):
        return _plain(targets, order, queries, own, k, r2)
    tree, by, edges = _leaves(targets, int(math.log2(len(targets) / leaf)))
    x, ids = np.ascontiguousarray(targets[by].T), order[by]
    width = int(np.diff(edges).max())
    step = max(1, _LEAVES_AT_ONCE // width)

    def measured(rows: np.ndarray, leaves: np.ndarray):
        """Squared distances of queries to the targets of a leaf each, infinite where there is none, and the places of those; some at a time."""
        for at in range(0, len(rows), step):
            q, start = rows[at : at + step], edges[leaves[at : at + step]]
            place = start[:, None] + np.arange(width)
            none = place >= edges[leaves[at : at + step] + 1][:, None]
            np.minimum(place, len(ids) - 1, out=place)
            d2 = np.zeros(place.shape)
            for c in range(len(x)):
                gap = queries[q, c, None] - x[c][place]
                d2 += gap * gap
            d2[none | (ids[place] == own[q, None])] = np.inf
            yield q, place, d2

    found, home, limit = [], tree.block(queries), np.empty(len(queries))
    by_leaf = np.argsort(home, kind="stable")
    for at in range(0, len(by_leaf), _QUERIES_AT_ONCE):
        some, parts = by_leaf[at : at + _QUERIES_AT_ONCE], []
        for rows, place, d2 in measured(some, home[some]):
            limit[rows] = np.fmin(r2[rows], np.partition(d2, k - 1, 1)[:, k - 1])
            i, j = np.nonzero((d2 <= limit[rows, None]) & np.isfinite(d2))
            parts.append((rows[i], by[place[i, j]], d2[i, j]))
        row, leaves = tree.touching(queries[some], limit[some])
        other = leaves != home[some[row]]
        for rows, place, d2 in measured(some[row[other]], leaves[other]):
            i, j = np.nonzero((d2 <= limit[rows, None]) & np.isfinite(d2))
            parts.append((rows[i], by[place[i, j]], d2[i, j]))
        found.append(_first(*(np.concatenate(v) for v in zip(*parts, strict=True)), order, k))
    q, t, d2 = (np.concatenate(v) for v in zip(*found, strict=True))
    s = np.argsort(q, kind="stable")
    return q[s], t[s], d2[s]
