"""Density clustering and peeling of points in blocks of space, a task each: what lies within twice eps of a block is there as a copy, and only what leads from one block to another is joined."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kd
from .storage import delete, written

#: Points in a block, copies not counted; a block is this many times eps wide at least; and rows that a task may hold. Where a block has more, points are crowded, and the callers go by cells instead.
BLOCK, WIDTH, MOST = 40_000, 8, 600_000
#: Pairs that are measured at once.
_AT_ONCE = 1 << 21


def dealt(points: DataFrame, eps: float, columns: tuple[str, ...], by: tuple[str, ...], per_block: int | None = None, whole: bool = False) -> DataFrame | None:
    """(by..., pid, columns, __block, __home, __sent), written: each point in its own block (``__home``) and in those that come within twice eps of it; ``__sent`` if there are any. None if points are too crowded.

    With ``whole`` also __whole: whether the block holds all that lies within eps of the row.
    """
    tree = kd.split(points, columns, BLOCK if per_block is None else per_block, WIDTH * eps)
    kinds = {f.name: f.dataType for f in points.schema.fields}
    head = [*by, "pid"]
    ddl = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in head), *(f"`{c}` double" for c in columns), "__block int, __home int, __sent boolean", *(["__whole boolean"] if whole else [])])

    def deal(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
            home = tree.block(x)
            row, at = tree.touching(x, np.full(len(x), 4 * eps * eps * (1 + 1e-9)))
            away = at != home[row]
            row, at = row[away], at[away]
            sent = np.zeros(len(x), bool)
            sent[row] = True
            rows = np.concatenate([np.arange(len(x)), row])
            taken = batch.take(pa.array(rows))
            more = [pa.array(np.concatenate([home, at]).astype(np.int32)), pa.array(home[rows].astype(np.int32)), pa.array(sent[rows])]
            names = [*head, *columns, "__block", "__home", "__sent"]
            if whole:
                close, block = tree.touching(x, np.full(len(x), eps * eps * (1 - 1e-9)))
                held = np.isin(row * tree.blocks + at, close * tree.blocks + block)
                more.append(pa.array(np.concatenate([np.ones(len(x), bool), held])))
                names.append("__whole")
            yield pa.RecordBatch.from_arrays([*taken.columns, *more], names)

    plain = points.select(*head, *(F.col(c).cast("double").alias(c) for c in columns))
    out = written(plain.mapInArrow(deal, ddl), "blocks")
    if (out.groupBy("__block").count().agg(F.max("count")).first()[0] or 0) > MOST:
        delete(out)
        return None
    return out


def merged(n: int, a: np.ndarray, b: np.ndarray, rep: np.ndarray | None = None) -> np.ndarray:
    """The smallest number that each of n is linked with by links (a, b)."""
    rep = np.arange(n) if rep is None else rep
    while len(a):
        x, y = rep[a], rep[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(rep, np.maximum(x, y), np.minimum(x, y))
        while (rep[rep] != rep).any():
            rep = rep[rep]
    return rep


class Cells:
    """Points in order of cells so small that any two of a cell are neighbours, their neighbours in emptier cells, and the clusters of cells."""

    def __init__(self, group: np.ndarray, x: np.ndarray, eps: float, least: float) -> None:
        d = x.shape[1]
        self.reach, self.least = eps * eps, least
        key, widths = np.unique(group, return_inverse=True)[1].astype(np.int64), []
        for i in range(d):
            at, place = np.unique(np.floor(x[:, i] / (eps / math.sqrt(d) * (1 - 1e-9))), return_inverse=True)
            # Gaps that no neighbour spans are closed, so that numbers of cells stay small.
            near = np.r_[0, np.cumsum(np.minimum(np.diff(at), 3).astype(np.int64))] + 2
            widths.append(int(near[-1]) + 3)
            key = key * widths[-1] + near[place]
            if (int(key.max()) + 1) * 3 * (len(x) + 2) >= 1 << 63:
                raise ValueError("too many cells for one block")
        steps = [math.prod(widths[i + 1 :]) for i in range(d)]
        self.deltas = [sum(o * s for o, s in zip(offset, steps, strict=True)) for offset in itertools.product((-2, -1, 0, 1, 2), repeat=d)]
        self.offsets = list(itertools.product((-2, -1, 0, 1, 2), repeat=d))
        self.order = np.argsort(key, kind="stable")
        self.x, key = x[self.order], key[self.order]
        self.start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.keys = key[self.start]
        self.count = np.diff(np.r_[self.start, len(key)])
        self.cell = np.repeat(np.arange(len(self.start)), self.count)
        self.dense = self.count >= least

    def beside(self, delta: int) -> np.ndarray:
        """The cell at an offset from each cell, -1 if there is none."""
        at = np.minimum(np.searchsorted(self.keys, self.keys + delta), len(self.keys) - 1)
        return np.where(self.keys[at] == self.keys + delta, at, -1)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d2 = np.zeros(len(i))
        for c in range(self.x.shape[1]):
            gap = self.x[i, c] - self.x[j, c]
            d2 += gap * gap
        return d2 <= self.reach

    def loose_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of neighbours of points i of emptier cells, themselves included, some at a time."""
        loose = np.flatnonzero(~self.dense[self.cell])
        for delta in self.deltas:
            to = self.beside(delta)[self.cell[loose]]
            i, to = loose[to >= 0], to[to >= 0]
            ends = np.cumsum(self.count[to])
            at = 0
            while at < len(i):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, side="right")))
                n = self.count[to[at:upto]]
                p = np.repeat(i[at:upto], n)
                q = np.repeat(self.start[to[at:upto]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                close = self.near(p, q)
                yield p[close], q[close]
                at = upto

    def neighbours(self) -> None:
        """Sets ``degree`` of points in emptier cells, ``pairs`` with others in such cells, and ``beside_dense`` (point, cell) with how many of a full cell are near."""
        self.degree = np.zeros(len(self.x), np.int64)
        pairs, cells = [], []
        for p, q in self.loose_pairs():
            self.degree += np.bincount(p, minlength=len(self.x))
            full = self.dense[self.cell[q]]
            pairs.append((p[~full], q[~full]))
            one, times = np.unique(p[full], return_counts=True)
            if len(one):
                first = np.searchsorted(p[full], one)
                cells.append((one, self.cell[q[full]][first], times))
        none = np.zeros(0, np.int64)
        self.pairs = tuple(np.concatenate(v) for v in zip(*pairs, strict=True)) if pairs else (none, none)
        self.beside_dense = tuple(np.concatenate(v) for v in zip(*cells, strict=True)) if cells else (none, none, none)

    def clusters(self, core: np.ndarray) -> np.ndarray:
        """The cluster of each cell with core points: links between core points of emptier cells and others, then between full cells by boxes, by outermost points, and by nearest neighbours where both are apart."""
        n = len(self.start)
        p, q = self.pairs
        both = core[p] & core[q]
        s, c, _ = self.beside_dense
        rep = merged(n, np.r_[self.cell[p[both]], self.cell[s[core[s]]]], np.r_[self.cell[q[both]], c[core[s]]])
        lo, hi = np.minimum.reduceat(self.x, self.start), np.maximum.reduceat(self.x, self.start)
        open_a, open_b = [], []
        for offset, delta in zip(self.offsets, self.deltas, strict=True):
            if delta <= 0:
                continue
            to = self.beside(delta)
            a = np.flatnonzero(self.dense & (to >= 0))
            a = a[self.dense[to[a]]]
            if not len(a):
                continue
            b = to[a]
            gap = np.maximum(np.maximum(lo[b] - hi[a], lo[a] - hi[b]), 0)
            a, b = a[(gap * gap).sum(1) <= self.reach * (1 + 1e-9)], b[(gap * gap).sum(1) <= self.reach * (1 + 1e-9)]
            along = self.x @ np.array(offset, float)
            place = np.lexsort((along, self.cell))
            i, j = place[self.start[a] + self.count[a] - 1], place[self.start[b]]
            linked = self.near(i, j)
            rep = merged(n, a[linked], b[linked], rep)
            open_a.append(a[~linked])
            open_b.append(b[~linked])
        for a, b in zip(np.concatenate(open_a).tolist() if open_a else [], np.concatenate(open_b).tolist() if open_b else [], strict=True):
            if rep[a] == rep[b]:
                continue
            side = []
            for own, other in ((a, b), (b, a)):
                v = self.x[self.start[own] : self.start[own] + self.count[own]]
                gap = np.maximum(np.maximum(lo[other] - v, v - hi[other]), 0)
                side.append(v[(gap * gap).sum(1) <= self.reach * (1 + 1e-9)])
            u, v = side
            if len(u) and len(v) and len(kd.nearest(v, np.arange(len(v)), u, np.full(len(u), -1), 1, np.full(len(u), self.reach))[0]):
                low, high = sorted((rep[a], rep[b]))
                rep[rep == high] = low
        return rep


def _codes(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    code = np.zeros(len(table), np.int64)
    for c in by:
        own = table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return code


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct combination of keys."""
    s = np.lexsort(keys[::-1])
    new = np.zeros(len(s), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[s][1:] != k[s][:-1]
    return s[new]


#: What a row of ``_clustered`` says: a core point and the first one of its cluster in the block; a cluster and a core point of another block that belongs to it; a border point and a core point of this
#: or of another block near it; noise.
CORE, LINK, BORDER, FAR_BORDER, LONE = range(5)


def _clustered(table: pa.Table, eps: float, least: float, all_core: bool, columns: tuple[str, ...], by: tuple[str, ...]) -> pa.Table:
    """(by..., pid, ref, kind, sent) of the points of a block."""
    cells = Cells(_codes(table, by), np.stack([table[c].to_numpy() for c in columns], 1), eps, least)
    cells.neighbours()
    table = table.take(pa.array(cells.order))
    block, home, pid = table["__block"][0].as_py(), table["__home"].to_numpy(), table["pid"].to_numpy()
    if pid.dtype.kind not in "iu":
        pid = np.unique(pid, return_inverse=True)[1]
    core = np.ones(len(pid), bool) if all_core else cells.dense[cells.cell] | (cells.degree >= least)
    own = home == block
    cluster = cells.clusters(core)[cells.cell]
    first = np.full(len(cells.start), -1)
    mine = np.flatnonzero(core & own)
    by_pid = mine[np.lexsort((pid[mine], cluster[mine]))]
    heads = by_pid[_firsts(cluster[by_pid])] if len(by_pid) else by_pid
    first[cluster[heads]] = heads
    rows, refs, kinds = [mine], [first[cluster[mine]]], [np.full(len(mine), CORE)]
    there = np.flatnonzero(core & (home > block))
    there = there[first[cluster[there]] >= 0]
    there = there[_firsts(cells.cell[there], home[there])]
    rows, refs, kinds = [*rows, first[cluster[there]]], [*refs, there], [*kinds, np.full(len(there), LINK)]
    rim = own & ~core
    p, q = cells.pairs
    good = rim[p] & core[q]
    s, c, _ = cells.beside_dense
    p, q = np.r_[p[good], s[rim[s]]], np.r_[q[good], cells.start[c[rim[s]]]]
    known = first[cluster[q]]
    q, far = np.where(known >= 0, known, q), known < 0
    one = _firsts(p, q)
    rows, refs, kinds = [*rows, p[one]], [*refs, q[one]], [*kinds, np.where(far[one], FAR_BORDER, BORDER)]
    rim[p] = False
    lone = np.flatnonzero(rim)
    rows, refs, kinds = (np.concatenate(v) for v in ([*rows, lone], [*refs, lone], [*kinds, np.full(len(lone), LONE)]))
    taken = table.take(pa.array(rows))
    values = [*(taken[c] for c in (*by, "pid")), table["pid"].take(pa.array(refs)), pa.array(kinds.astype(np.int8)), taken["__sent"]]
    return pa.Table.from_arrays(values, [*by, "pid", "__ref", "__kind", "__sent"])


def clustered(blocks: DataFrame, eps: float, least: float, columns: tuple[str, ...], by: tuple[str, ...], all_core: bool = False) -> DataFrame:
    """(by..., pid, label, is_core), written: density clusters of points dealt by ``dealt``, numbered by their smallest pid; ``all_core`` if all of them are known to be core."""
    from .clustering import NOISE, _numbered
    from .components import connected_components

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, "pid")), f"__ref {kinds['pid']}, __kind tinyint, __sent boolean"])
    said = written(blocks.groupBy("__block").applyInArrow(lambda t: _clustered(t, eps, least, all_core, columns, by), ddl), "block-clusters")
    of = lambda kind: said.filter(F.col("__kind") == kind)
    key = lambda c: F.struct(*by, F.col(c).alias("pid")) if by else F.col(c)
    met = of(CORE).filter("__sent").select(*by, F.col("pid").alias("__ref"), F.col("__ref").alias("__there"))
    parts = connected_components(of(LINK).select(*by, "pid", "__ref").join(met, [*by, "__ref"]).select(key("pid").alias("a"), key("__there").alias("b")))
    heads = of(CORE).select(*by, "__ref").distinct().select(*by, "__ref", key("__ref").alias("id")).join(parts, "id", "left")
    least_of = F.coalesce(F.col("component.pid") if by else F.col("component"), F.col("__ref"))
    numbers = written(_numbered(heads.select(*by, F.col("__ref").alias("pid"), least_of.alias("rep")), by).withColumnRenamed("pid", "__ref"), "block-labels")
    core = of(CORE).select(*by, "pid", "__ref").join(numbers, [*by, "__ref"]).select(*by, "pid", "label", F.lit(True).alias("is_core"))
    far = of(FAR_BORDER).select(*by, "pid", "__ref").join(met, [*by, "__ref"]).select(*by, "pid", F.col("__there").alias("__ref"))
    rim = of(BORDER).select(*by, "pid", "__ref").unionByName(far).join(numbers, [*by, "__ref"]).groupBy(*by, "pid").agg(F.min("label").alias("label"))
    rest = rim.unionByName(of(LONE).select(*by, "pid", F.lit(NOISE).alias("label"))).withColumn("is_core", F.lit(False))
    out = written(core.unionByName(rest), "dbscan")
    delete(said, parts, numbers)
    return out


def _falls(table: pa.Table, eps: float, least: int, columns: tuple[str, ...], by: tuple[str, ...]) -> pa.Table:
    """(by..., pid, home, sent) of the block's own points that fall one after the other, while all copies stand."""
    from .clustering import _fallen

    cells = Cells(_codes(table, by), np.stack([table[c].to_numpy() for c in columns], 1), eps, least)
    cells.neighbours()
    table = table.take(pa.array(cells.order))
    stays = (table["__home"].to_numpy() != table["__block"].to_numpy()) | cells.dense[cells.cell]
    base = np.where(stays, least, 1).astype(np.int64)  # a point counts itself
    s, _, times = cells.beside_dense
    np.add.at(base, s, times)
    p, q = cells.pairs
    linked = (p != q) & ~stays[p]
    gone = _fallen(base, p[linked], np.where(stays[q[linked]], -1, q[linked]), least)
    return table.select([*by, "pid", "__home", "__sent"]).filter(pa.array(gone & ~stays))


def stood(blocks: DataFrame, eps: float, least: int, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """``blocks``, written again, with what is left when points with fewer than ``least`` neighbours, themselves included, fall one after the other.

    A block lets its own fall until nothing moves, taking copies as they stand. Then blocks are told what fell of their copies, and only those that hold some go on. The rounds follow how many blocks in a row
    a peeling runs through.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, "pid")), "__home int, __sent boolean"])
    key, gone, rows = [*by, "pid"], [], blocks
    while True:
        news = written(rows.groupBy("__block").applyInArrow(lambda t: _falls(t, eps, least, columns, by), ddl), "fallen")
        gone.append(news)
        told = news.filter("__sent").select(*key)
        if not told.take(1):
            break
        touched = blocks.filter("__home != __block").join(told, key, "left_semi").select("__block").distinct()
        fallen = gone[0]
        for more in gone[1:]:
            fallen = fallen.unionByName(more)
        rows = blocks.join(F.broadcast(touched), "__block", "left_semi").join(fallen.select(*key), key, "left_anti")  # a row a block
    fallen = gone[0]
    for more in gone[1:]:
        fallen = fallen.unionByName(more)
    out = written(blocks.join(fallen.select(*key), key, "left_anti"), "stood")
    delete(*gone)
    return out
