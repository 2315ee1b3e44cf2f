"""Clusterings at all settings of a grid, in blocks of space with margins, a task each: pairs never leave their block, and a point's labels are one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import connected_components
from .storage import delete, written

#: Points in a block, copies not counted, and pairs that a task may hold; where a block has more, points are crowded.
BLOCK, MOST_PAIRS = 20_000, 40_000_000


class Neighbours:
    """The points of a block and their pairs within the largest sigma, each both ways and by point, with the first sigma that holds it."""

    def __init__(self, x: np.ndarray, sigmas: list[float]) -> None:
        n, k = len(x), len(sigmas)
        cells = blocks.Cells(np.zeros(n, np.int64), x, max(sigmas), np.inf)
        of, to, first = [], [], []
        for p, q in cells.loose_pairs():
            p, q = p[p < q], q[p < q]
            d2 = np.zeros(len(p))
            for c in range(x.shape[1]):
                gap = cells.x[p, c] - cells.x[q, c]
                d2 += gap * gap
            of.append(p.astype(np.int32))
            to.append(q.astype(np.int32))
            first.append(sum((d2 > s * s).astype(np.int8) for s in sigmas))
        self.order, self.n = cells.order, n
        self.p, self.q, self.s0 = np.concatenate(of), np.concatenate(to), np.concatenate(first)
        #: Neighbours of each point at each sigma, without itself.
        self.degree = sum(np.bincount(v * np.int64(k) + self.s0, minlength=n * k) for v in (self.p, self.q)).reshape(n, k).cumsum(1)

    def by_point(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, other): the neighbours of a point from its start on, those of smaller sigmas first."""
        key = np.concatenate([self.p, self.q]) * np.int64(128) + np.concatenate([self.s0, self.s0])
        other = np.concatenate([self.q, self.p])[np.argsort(key, kind="stable")]
        total = self.degree[:, -1]
        return np.cumsum(total) - total, other

    def settled(self, thresholds: list[int], own: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Levels (n, sigmas) at which points stay core among the points of at least their level, at most those ``known``; those that are not ``own``, whose neighbours are not all here, have the ``known`` ones."""
        start, other = self.by_point()
        out = known.copy()
        out[own] = 0
        for s in range(known.shape[1]):
            near, left, up = self.degree[:, s], self.degree[:, s] + 1, np.ones(self.n, bool)
            for j, t in enumerate(thresholds):
                wave = np.flatnonzero(up & ((known[:, s] <= j) | (own & (left < t))))
                while len(wave):
                    up[wave] = False
                    size = near[wave]
                    met = other[np.repeat(start[wave] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    cut = np.bincount(met, minlength=self.n)
                    left = left - cut
                    wave = np.flatnonzero((cut > 0) & up & own & (left < t))
                out[up & own, s] = j + 1
                if not up.any():
                    break
        return out

    def reps(self, level: np.ndarray, s: int, most: int):
        """(j, representative of each point) for the thresholds of a sigma from the highest to the first: core points that are linked have one."""
        weight = np.where(self.s0 <= s, np.minimum(level[self.p, s], level[self.q, s]), 0)
        by = np.argsort(weight, kind="stable")
        edge, rep = np.searchsorted(weight[by], np.arange(most + 2)), np.arange(self.n)
        for j in range(most, 0, -1):
            here = by[edge[j] : edge[j + 1]]
            rep = blocks.merged(self.n, self.p[here], self.q[here], rep)
            yield j, rep


def _points(table: pa.Table, sigmas: list[float], columns: tuple[str, ...]) -> tuple[Neighbours, pa.Table, np.ndarray]:
    near = Neighbours(np.stack([table[c].to_numpy() for c in columns], 1), sigmas)
    table = table.take(pa.array(near.order))
    return near, table, table["__home"].to_numpy() == table["__block"].to_numpy()


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel(), kind))


def _matrix(lists: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), k)


def _crowded(placed: DataFrame, eps: float, columns: tuple[str, ...]) -> bool:
    cells = placed.groupBy("__block", *(F.floor(F.col(c) / eps) for c in columns)).count()
    most = cells.groupBy("__block").agg(F.sum(F.col("count") * F.col("count")).alias("n")).agg(F.max("n")).first()[0]
    return 3 * (most or 0) > MOST_PAIRS


def _levels(placed: DataFrame, sigmas: list[float], thresholds: list[int], columns: tuple[str, ...]) -> DataFrame:
    """(pid, block, sent, v), written: levels of points as ``Neighbours.settled`` has them, over all blocks: blocks are told what fell of their copies until nothing does."""
    top = len(thresholds)
    kind = placed.schema["pid"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        near, table, own = _points(table, sigmas, columns)
        known = np.full((near.n, len(sigmas)), top, np.int8)
        told = np.flatnonzero(table["v"].is_valid().to_numpy())
        known[told] = _matrix(table["v"].take(pa.array(told)), len(sigmas))
        v = near.settled(thresholds, table["__whole"].to_numpy(), known)
        mine = pa.array(np.flatnonzero(own))
        said = table.take(mine)
        return pa.Table.from_arrays([said["pid"], said["__block"], said["__sent"], _lists(v[own], pa.int8()), pa.array((v[own] != known[own]).any(1))], ["pid", "block", "sent", "v", "changed"])

    ddl = f"pid {kind}, block int, sent boolean, v array<tinyint>, changed boolean"
    copies = placed.filter("__home != __block")
    now = written(placed.withColumn("v", F.lit(None).cast("array<tinyint>")).groupBy("__block").applyInArrow(run, ddl), "levels")
    while True:
        told = now.filter("sent and changed").select("pid")
        touched = written(copies.join(told, "pid", "left_semi").select("__block").distinct(), "touched")
        if not touched.take(1):
            delete(touched)
            return now
        rows = placed.join(F.broadcast(touched), "__block", "left_semi").join(now.select("pid", "v"), "pid")  # a row a block
        new = rows.select(*placed.columns, "v").groupBy("__block").applyInArrow(run, ddl)
        kept = now.join(F.broadcast(touched.withColumnRenamed("__block", "block")), "block", "left_anti").withColumn("changed", F.lit(False))
        after = written(new.unionByName(kept), "levels")
        delete(now, touched)
        now = after


#: What a row of ``_clustered`` is: a point of the block with its cluster at each setting, a copy with the same, a cluster with its smallest pid, and a border point between several clusters.
POINT, COPY, CLUSTER, BETWEEN = range(4)


def _clustered(table: pa.Table, cells: list[tuple[int, int]], sigmas: list[float], thresholds: list[int], noise_free: bool, columns: tuple[str, ...]) -> pa.Table:
    """(kind, block, pid, sent, c, idx, cluster): clusters of a block at settings (sigma, threshold), numbered by a point of them; ``idx`` is a setting's place."""
    near, table, own = _points(table, sigmas, columns)
    if noise_free:
        level = _matrix(table["v"], len(sigmas)).astype(np.int8)
    else:
        level = sum(((near.degree + 1 >= t).astype(np.int8) for t in thresholds), np.zeros(near.degree.shape, np.int8))
    pid = table["pid"].to_numpy()
    by_pid = np.argsort(pid, kind="stable")
    mine = by_pid[own[by_pid]]
    out = np.full((near.n, len(cells)), -1, np.int32)
    place = {c: i for i, c in enumerate(cells)}
    heads, between = [], []
    for s in range(len(sigmas)):
        for j, rep in near.reps(level, s, len(thresholds)):
            i = place.get((s, j - 1))
            if i is None:
                continue
            core = level[:, s] >= j
            used = np.zeros(near.n, bool)
            used[rep[core & own]] = True
            rim_of = rim_in = np.zeros(0, np.int64)
            if not noise_free:
                for a, b in ((near.p, near.q), (near.q, near.p)):
                    good = np.flatnonzero((near.s0 <= s) & ~core[a] & own[a] & core[b])
                    rim_of, rim_in = np.concatenate([rim_of, a[good]]), np.concatenate([rim_in, rep[b[good]]])
                pairs = np.unique(rim_of * np.int64(near.n) + rim_in)
                rim_of, rim_in = pairs // near.n, pairs % near.n
                used[rim_in] = True
            kept = core & used[rep]
            out[kept, i] = rep[kept]
            if len(rim_of):
                several = np.bincount(rim_of, minlength=near.n)[rim_of] > 1
                out[rim_of[~several], i] = rim_in[~several]
                between.append((np.full(several.sum(), i), rim_of[several], rim_in[several]))
            first = np.full(near.n, -1)
            ours = mine[core[mine]][::-1]
            first[rep[ours]] = ours  # the smallest pid is written last
            number = np.flatnonzero(used)
            heads.append((np.full(len(number), i), first[number], number))
    none = (np.zeros(0, np.int64),) * 3
    heads, between = (tuple(np.concatenate(v) for v in zip(*(x or [none]), strict=True)) for x in (heads, between))
    there = np.flatnonzero(~own & (out >= 0).any(1))
    rows = [np.flatnonzero(own), there, heads[1], between[1]]
    sizes = [len(r) for r in rows]
    ids = pa.concat_arrays([pa.nulls(0, table["pid"].type), table["pid"].combine_chunks().take(pa.array(np.concatenate(rows), mask=np.concatenate(rows) < 0))])
    lists = pa.concat_arrays([_lists(out[np.concatenate(rows[:2])], pa.int32()), pa.nulls(sizes[2] + sizes[3], pa.list_(pa.int32()))])
    blank = pa.nulls(sizes[0] + sizes[1], pa.int32())
    number = [pa.concat_arrays([blank, pa.array(np.concatenate([heads[k], between[k]]).astype(np.int32))]) for k in (0, 2)]
    sent = np.zeros(sum(sizes), bool)
    sent[: sizes[0]] = table["__sent"].to_numpy()[rows[0]]
    block = np.full(sum(sizes), table["__block"][0].as_py(), np.int32)
    kinds = np.repeat(np.array([POINT, COPY, CLUSTER, BETWEEN], np.int8), sizes)
    return pa.Table.from_arrays([pa.array(kinds), pa.array(block), ids, pa.array(sent), lists, *number], ["kind", "block", "pid", "sent", "c", "idx", "cluster"])


def labels(points: DataFrame, cells: list[tuple[int, float, int]], noise_free: bool = False, columns: tuple[str, ...] = ("x", "y")) -> DataFrame | None:
    """(pid, block, labels), written: the labels of each point at all settings (idx, sigma, threshold), in their order; None if points are too crowded for blocks.

    A block finds its pairs, once, at the largest sigma, and its clusters at all settings. Points that lie in one block and as copies in others say which clusters of blocks are one. Without border points
    (``noise_free``) the levels at which points stay are settled first, see ``_levels``.
    """
    from .clustering import _finite, _numbered

    sigmas, thresholds = sorted({s for _, s, _ in cells}), sorted({t for _, _, t in cells})
    at, width = [(sigmas.index(s), thresholds.index(t)) for _, s, t in cells], len(cells)
    good = points.filter(_finite(columns))
    placed = blocks.dealt(good, max(sigmas), columns, (), BLOCK, noise_free)
    if placed is None:
        return None
    if _crowded(placed, max(sigmas), columns):
        delete(placed)
        return None
    kind = points.schema["pid"].dataType.simpleString()
    rows = placed
    if noise_free:
        levels = _levels(placed, sigmas, thresholds, columns)
        rows = placed.join(levels.select("pid", "v"), "pid").select(*placed.columns, "v")
    found = rows.groupBy("__block").applyInArrow(lambda t: _clustered(t, at, sigmas, thresholds, noise_free, columns), f"kind tinyint, block int, pid {kind}, sent boolean, c array<int>, idx int, cluster int")
    found = written(found, "block-clusters")
    of = lambda k: found.filter(F.col("kind") == k)

    def met(batches):
        for batch in batches:
            own, other, a, b = batch.columns
            a, b = _matrix(a, width), _matrix(b, width)
            row, idx = np.nonzero((a >= 0) & (b >= 0))
            keys = [idx, own.to_numpy()[row], a[row, idx], other.to_numpy()[row], b[row, idx]]
            one = blocks._firsts(*keys)
            yield pa.RecordBatch.from_arrays([pa.array(k[one].astype(np.int32)) for k in keys], ["idx", "b1", "c1", "b2", "c2"])

    both = of(POINT).filter("sent").select("pid", F.col("block").alias("b1"), F.col("c").alias("a")).join(of(COPY).select("pid", F.col("block").alias("b2"), F.col("c").alias("b")), "pid")
    links = both.select("b1", "b2", "a", "b").mapInArrow(met, "idx int, b1 int, c1 int, b2 int, c2 int")
    node = lambda b, c: F.struct("idx", F.col(b).alias("block"), F.col(c).alias("cluster"))
    parts = connected_components(links.select(node("b1", "c1").alias("a"), node("b2", "c2").alias("b")))
    named = of(CLUSTER).select(node("block", "cluster").alias("id"), "pid").join(parts, "id", "left").select("id", "pid", F.coalesce("component", "id").alias("whole"))
    named = written(named, "cluster-names")
    reps = named.join(named.groupBy("whole").agg(F.min("pid").alias("rep")), "whole").select("id.idx", F.col("id").alias("pid"), "rep")
    numbers = written(_numbered(reps, ("idx",)).select("idx", F.col("pid.block").alias("block"), F.col("pid.cluster").alias("cluster"), "label"), "cluster-labels")
    between = of(BETWEEN).select("block", "idx", "cluster", "pid").join(numbers, ["block", "idx", "cluster"]).groupBy("block", "idx", "pid").agg(F.min("label").alias("label"))
    names = numbers.select("block", "idx", "cluster", "label", F.lit(None).cast(kind).alias("pid")).unionByName(between.select("block", "idx", F.lit(None).cast("int").alias("cluster"), "label", "pid"))

    def name(own: pa.Table, names: pa.Table) -> pa.Table:
        if not len(own):
            return pa.Table.from_arrays([pa.nulls(0, own["pid"].type), pa.nulls(0, pa.int32()), pa.nulls(0, pa.list_(pa.int32()))], ["pid", "block", "labels"])
        c = _matrix(own["c"], width)
        most = int(c.max(initial=0)) + 1
        idx, number = names["idx"].to_numpy(), names["label"].to_numpy()
        whole = names["cluster"].is_valid().to_numpy()
        cluster = names["cluster"].fill_null(0).to_numpy()
        whole_in = whole & (cluster < most)  # clusters of border points between several can be named by a point of a higher place
        table = np.full(width * most + 1, -1, np.int32)
        table[idx[whole_in].astype(np.int64) * most + cluster[whole_in]] = number[whole_in]
        out = table[np.where(c >= 0, np.arange(width)[None] * most + c, width * most)]
        pid = own["pid"].to_numpy()
        by = np.argsort(pid, kind="stable")
        some = np.flatnonzero(~whole)
        if len(some):
            out[by[np.searchsorted(pid[by], names["pid"].take(pa.array(some)).to_numpy())], idx[some]] = number[some]
        return pa.Table.from_arrays([own["pid"], own["block"], _lists(out, pa.int32())], ["pid", "block", "labels"])

    own = of(POINT).select("pid", "block", "c")
    out = own.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(name, f"pid {kind}, block int, labels array<int>")
    lost = points.filter(~_finite(columns)).select("pid", F.lit(-1).alias("block"), F.array(*(F.lit(-1) for _ in cells)).alias("labels"))
    out = written(out.unionByName(lost), "grid-labels")
    delete(placed, found, parts, named, numbers, *([levels] if noise_free else []))
    return out


def sizes(wide: DataFrame, width: int) -> DataFrame:
    """(block, idx, label, n, total), written: how many points of a block a cluster has, and in all."""

    def count(table: pa.Table) -> pa.Table:
        values = _matrix(table["labels"], width)
        out = []
        for i in range(width):
            label, n = np.unique(values[values[:, i] >= 0, i], return_counts=True)
            out.append((np.full(len(label), i), label, n))
        idx, label, n = (np.concatenate(v) for v in zip(*out, strict=True))
        block = np.full(len(idx), table["block"][0].as_py())
        return pa.Table.from_arrays([pa.array(block, pa.int32()), pa.array(idx, pa.int32()), pa.array(label, pa.int32()), pa.array(n, pa.int64())], ["block", "idx", "label", "n"])

    part = written(wide.filter("block >= 0").groupBy("block").applyInArrow(count, "block int, idx int, label int, n long"), "part-sizes")
    whole = part.groupBy("idx", "label").agg(F.sum("n").alias("total"))
    out = written(part.join(whole, ["idx", "label"]).select("block", "idx", "label", "n", "total"), "cluster-sizes")
    delete(part)
    return out


def _meetings(table: pa.Table, known: pa.Table, cells: list[tuple[int, float, int]], noise_free: bool):
    """(i, j, a, b, n, na, nb, nearly): all pairs of settings i < j with the clusters that have common points in a block, their numbers, and whether one of both lies in this block alone.

    Clusters without border points are nested where a setting's sigma is smaller and its threshold higher, so that one point of each tells its other cluster.
    """
    width = len(cells)
    values = _matrix(table["labels"], width)
    idx, label, n, total = (known[c].to_numpy() for c in ("idx", "label", "n", "total"))
    by = np.lexsort((label, idx))
    idx, label, n, total = idx[by], label[by], n[by], total[by]
    edge = np.searchsorted(idx, np.arange(width + 1))
    info = [(label[edge[i] : edge[i + 1]], n[edge[i] : edge[i + 1]], total[edge[i] : edge[i + 1]]) for i in range(width)]
    code = np.full(values.shape, -1, np.int32)
    first = []
    for i in range(width):
        rows = np.flatnonzero(values[:, i] >= 0)
        code[rows, i] = np.searchsorted(info[i][0], values[rows, i])
        one = np.zeros(len(info[i][0]), np.int64)
        one[code[rows, i]] = rows
        first.append(one)
    code = np.asfortranarray(code)
    for i in range(width):
        if not len(first[i]):
            continue
        rows = np.flatnonzero(code[:, i] >= 0)
        mine = code[rows, i].astype(np.int64)
        for j in range(i + 1, width):
            if not len(first[j]):
                continue
            within = noise_free and cells[i][1] <= cells[j][1] and cells[i][2] >= cells[j][2]
            around = noise_free and cells[i][1] >= cells[j][1] and cells[i][2] <= cells[j][2]
            if within:
                a, b = np.arange(len(first[i])), code[first[i], j].astype(np.int64)
                common = info[i][1]
            elif around:
                a, b = code[first[j], i].astype(np.int64), np.arange(len(first[j]))
                common = info[j][1]
            else:
                theirs = code[rows, j]
                both = theirs >= 0
                k = len(first[j])
                keys = mine[both] * k + theirs[both]
                if len(first[i]) * k <= 8 * len(rows):
                    times = np.bincount(keys, minlength=1)
                    met = np.flatnonzero(times)
                    common = times[met]
                else:
                    met, common = np.unique(keys, return_counts=True)
                a, b = met // k, met % k
            na, nb = info[i][2][a], info[j][2][b]
            alone = (info[i][1][a] == na) | (info[j][1][b] == nb)
            yield i, j, info[i][0][a], info[j][0][b], common, na, nb, alone


def overlaps(wide: DataFrame, known: DataFrame, cells: list[tuple[int, float, int]], noise_free: bool) -> DataFrame:
    """(i, a, j, b, n, na, nb), i < j by place: clusters of different settings with common points. Pairs of which one lies in a block alone are complete there, only others are added up."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        found = [(np.full(len(a), i), a, np.full(len(a), j), b, n, na, nb, alone) for i, j, a, b, n, na, nb, alone in _meetings(table, known, cells, noise_free)] if len(table) else []
        columns = [np.concatenate(v) for v in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 7 + [np.zeros(0, bool)]
        kinds = [*(pa.int32(),) * 4, *(pa.int64(),) * 3, pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["i", "a", "j", "b", "n", "na", "nb", "alone"])

    met = wide.filter("block >= 0").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "i int, a int, j int, b int, n long, na long, nb long, alone boolean")
    met = written(met, "meetings")
    rest = met.filter("not alone").groupBy("i", "a", "j", "b", "na", "nb").agg(F.sum("n").alias("n"))
    return met.filter("alone").select("i", "a", "j", "b", "n", "na", "nb").unionByName(rest)


def alike(wide: DataFrame, known: DataFrame, cells: list[tuple[int, float, int]], noise_free: bool, share: float) -> DataFrame:
    """(i, a, js), written: for clusters, by place of their setting, the other settings in which a cluster shares more than ``share`` of both. Clusters without any are left out."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        done, rest = [], []
        for i, j, a, b, n, na, nb, alone in _meetings(table, known, cells, noise_free) if len(table) else ():
            good = np.flatnonzero(alone & (n > share * na) & (n > share * nb))
            if len(good):
                done += [(np.full(len(good), i, np.int32), a[good], np.full(len(good), j, np.int32)), (np.full(len(good), j, np.int32), b[good], np.full(len(good), i, np.int32))]
            some = np.flatnonzero(~alone)
            if len(some):
                rest.append((np.full(len(some), i), a[some], np.full(len(some), j), b[some], n[some], na[some], nb[some]))
        i, a, j = (np.concatenate(v) for v in zip(*done, strict=True)) if done else (np.zeros(0, np.int32),) * 3
        by = np.lexsort((j, a, i))
        i, a, j = i[by], a[by], j[by]
        start = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (a[1:] != a[:-1])]) if len(i) else np.zeros(0, np.int64)
        js = pa.ListArray.from_arrays(pa.array(np.r_[start, len(i)], pa.int32()), pa.array(j, pa.int32()))
        more = [np.concatenate(v) for v in zip(*rest, strict=True)] if rest else [np.zeros(0, np.int64)] * 7
        m, r = len(start), len(more[0])
        column = lambda of_done, at, kind: pa.concat_arrays([pa.nulls(m, kind) if of_done is None else pa.array(of_done, kind), pa.array(more[at], kind)])
        values = [column(i[start], 0, pa.int32()), column(a[start], 1, pa.int32()), pa.concat_arrays([js, pa.nulls(r, js.type)]), column(None, 2, pa.int32()), column(None, 3, pa.int32()), *(column(None, k, pa.int64()) for k in (4, 5, 6))]
        return pa.Table.from_arrays(values, ["i", "a", "js", "j", "b", "n", "na", "nb"])

    said = wide.filter("block >= 0").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "i int, a int, js array<int>, j int, b int, n long, na long, nb long")
    said = written(said, "meetings")
    rest = said.filter("js is null").groupBy("i", "a", "j", "b", "na", "nb").agg(F.sum("n").alias("n")).filter((F.col("n") > share * F.col("na")) & (F.col("n") > share * F.col("nb")))
    rest = rest.select(F.explode(F.array(F.struct("i", "a", "j"), F.struct(F.col("j").alias("i"), F.col("b").alias("a"), F.col("i").alias("j")))).alias("e")).select("e.i", "e.a", F.array("e.j").alias("js"))
    every = said.filter("js is not null").select("i", "a", "js").unionByName(rest)
    out = written(every.groupBy("i", "a").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js")), "similar-clusters")
    delete(said)
    return out
