"""Density clustering as joins, degree counts and connected components.

Labels are 0, 1, ... in order of the smallest point id of a cluster, and -1 for noise, so they depend on nothing but the points.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, kd, turns
from .components import connected_components
from .kd import valid
from .ranks import ranked
from .spatial import eps_pairs, knn, knn_within, nearest_within, neighbour_rows
from .storage import delete, written
from .turns import until_jump as _until_jump  # noqa: F401

NOISE = -1


def degrees(pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(pid, degree): neighbours of each point with itself, or the sum of their weights (pid, weight)."""
    if weights is None:
        return pairs.groupBy(F.col("p").alias("pid")).agg(F.count("*").alias("degree"))
    return pairs.join(weights.withColumnRenamed("pid", "q"), "q").groupBy(F.col("p").alias("pid")).agg(F.sum("weight").alias("degree"))


def core_points(pairs: DataFrame, min_samples: float, weights: DataFrame | None = None) -> DataFrame:
    return degrees(pairs, weights).filter(F.col("degree") >= min_samples).select("pid")


def _numbered(component: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., pid, label) from (by..., pid, rep): ranks of the representatives.

    Representatives are numbered within ranges of their order, which are offset by the ranges before, so that no task holds them all.
    """
    reps = component.select(*by, "rep").distinct().repartitionByRange(*by, "rep").sortWithinPartitions(*by, "rep")
    parts = reps.withColumn("part", F.spark_partition_id()).withColumn("at", F.row_number().over(Window.partitionBy("part", *by).orderBy("rep")))
    parts = written(parts, "representatives")
    before = parts.groupBy("part", *by).agg(F.max("at").alias("n"))  # one row for each range (and group)
    before = before.select("part", *by, (F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")).alias("before"))
    numbers = parts.join(before, ["part", *by]).select(*by, "rep", (F.col("before") + F.col("at") - 1).cast("int").alias("label"))
    return component.join(numbers, [*by, "rep"]).select(*by, "pid", "label")


def _components_of(core: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pid, rep) of core points."""
    inside = pairs.filter("p < q").join(core.withColumnRenamed("pid", "p"), "p", "left_semi").join(core.withColumnRenamed("pid", "q"), "q", "left_semi")
    parts = connected_components(inside, "p", "q")
    return core.join(parts.withColumnRenamed("id", "pid"), "pid", "left").select("pid", F.coalesce("component", "pid").alias("rep"))


def dbscan_from_pairs(points: DataFrame, pairs: DataFrame, min_samples: float, weights: DataFrame | None = None) -> DataFrame:
    """(pid, label, is_core). Pairs are found once and written."""
    pairs = written(pairs.select("p", "q"), "eps-pairs")
    core = written(core_points(pairs, min_samples, weights), "core-points")
    labels = written(_numbered(_components_of(core, pairs)), "core-labels")
    border = pairs.join(labels.select(F.col("pid").alias("q"), "label"), "q").groupBy(F.col("p").alias("pid")).agg(F.min("label").alias("near"))
    out = points.select("pid").join(labels, "pid", "left").join(border, "pid", "left")
    out = written(out.select("pid", F.coalesce("label", "near", F.lit(NOISE)).cast("int").alias("label"), F.col("label").isNotNull().alias("is_core")), "dbscan")
    delete(pairs, core, labels)
    return out


def _around(rows: DataFrame, axes: int, by: tuple[str, ...]) -> DataFrame:
    """Each row once for each cell that can hold a neighbour of its ``cell``'s points, named ``near``."""
    out = rows.select("*", *(F.col(f"cell.c{i}").alias(f"__n{i}") for i in range(axes)))
    for i in range(axes):
        out = out.withColumn(f"__n{i}", F.explode(F.array(*(F.col(f"__n{i}") + o for o in (-2, -1, 0, 1, 2)))))
    near = F.struct(*(F.col(f"cell.{b}").alias(b) for b in by), *(F.col(f"__n{i}").alias(f"c{i}") for i in range(axes)))
    return out.withColumn("near", near).drop(*(f"__n{i}" for i in range(axes)))


def _d2(columns: tuple[str, ...]):
    return reduce(add, ((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in columns))


def _laid(points: DataFrame, eps: float, min_samples: float, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """(pid, columns, cell, dense), written: points in cells so small that any two of a cell are neighbours; dense cells have ``min_samples`` or more."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    size = eps / math.sqrt(len(columns)) * (1 - 1e-9)
    cell = F.struct(*by, *(F.floor(F.col(c) / size).alias(f"c{i}") for i, c in enumerate(columns)))
    laid = points.filter(valid(columns)).select("pid", *columns, cell.alias("cell"))
    # Written, so that the join is one of two plain exchanges, which can be split at a crowded cell.
    full = written(laid.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select("cell", F.lit(True).alias("dense")), "dense-cells")
    out = written(laid.join(full, "cell", "left").select("pid", *columns, "cell", F.coalesce("dense", F.lit(False)).alias("dense")), "cells")
    delete(full)
    return out


def _near_cells(laid: DataFrame, eps: float, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """(owner, pid, cell, dense, n, members), written: for points of emptier cells, how many points of a cell are near, and in emptier cells which. ``owner`` is the point's own cell."""
    rows = _around(laid.filter("not dense"), len(columns), by).alias("p").join(laid.alias("q"), (F.col("p.near") == F.col("q.cell")) & (_d2(columns) <= eps * eps))
    rows = rows.groupBy(F.col("p.cell").alias("owner"), F.col("p.pid").alias("pid"), F.col("q.cell").alias("cell"), F.col("q.dense").alias("dense"))
    return written(rows.agg(F.count("*").alias("n"), F.collect_list(F.when(~F.col("q.dense"), F.col("q.pid"))).alias("members")), "near-cells")


#: Pairs of core points that are compared one by one, times the number of core points, before cells are cut finer; and how often they are, at most.
PAIRS_A_POINT, FINEST = 64, 24


def _open_links(core: DataFrame, groups: DataFrame, eps: float, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """(a, b), written: groups of cells with core points within eps of each other, of cells that lie near one another. ``groups`` has (cell, grp).

    Pairs of cells are told apart by the boxes around their points: too far apart, or all near. Pairs that neither settles are looked at in boxes a quarter as wide, and so on,
    without the groups that are found linked, until so few pairs of points are left that they can be compared.
    """
    d, reach = len(columns), eps * eps
    boxes = [f(c).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, c in enumerate(columns)]
    gap = lambda i: F.greatest(F.col(f"q.lo{i}") - F.col(f"p.hi{i}"), F.col(f"p.lo{i}") - F.col(f"q.hi{i}"), F.lit(0.0))
    span = lambda i: F.greatest(F.col(f"q.hi{i}") - F.col(f"p.lo{i}"), F.col(f"p.hi{i}") - F.col(f"q.lo{i}"))
    least, most = (reduce(add, (f(i) * f(i) for i in range(d))) for f in (gap, span))
    size = eps / math.sqrt(d)
    sides = ["p", "q"]

    # Cells that lie near one of another group, with the boxes around their core points.
    held = core.join(groups, "cell")
    whole = written(held.groupBy("cell", "grp").agg(F.count("*").alias("n"), *boxes), "cell-boxes")
    pairs = _around(whole, d, by).alias("p").join(whole.alias("q"), (F.col("p.near") == F.col("q.cell")) & (F.col("p.grp") < F.col("q.grp")) & (least <= reach))
    kept = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in sides for c in ("cell", "grp", "n")]
    pairs = written(pairs.select(*kept, F.lit("").alias("p_part"), F.lit("").alias("q_part"), (most <= reach).alias("all_near")), "cell-pairs")
    links, passed = [pairs.filter("all_near")], [whole, pairs]
    budget = PAIRS_A_POINT * core.count()
    open_pairs, level = pairs, 0
    while True:
        linked = open_pairs.filter("all_near").select("p_grp", "q_grp").distinct()
        left = open_pairs.filter("not all_near").join(linked, ["p_grp", "q_grp"], "left_anti")
        row = left.agg(F.count("*").alias("n"), F.sum(F.col("p_n") * F.col("q_n")).alias("work")).first()
        if not row["n"] or row["work"] <= budget or level == FINEST:
            break
        level += 1
        part = lambda k: F.concat_ws(",", *(F.floor(F.col(c) / (size / 4**k)).cast("string") for c in columns)) if k else F.lit("")
        wanted = left.select(F.explode(F.array("p_cell", "q_cell")).alias("cell")).distinct()
        finer = held.join(wanted, "cell", "left_semi").withColumns({"above": part(level - 1), "part": part(level)}).groupBy("cell", "grp", "above", "part")
        finer = written(finer.agg(F.count("*").alias("n"), *boxes), "part-boxes")
        both = left.select(*(f"{s}_{c}" for s in sides for c in ("cell", "part"))).alias("l")
        for s in sides:
            both = both.join(finer.alias(s), (F.col(f"l.{s}_cell") == F.col(f"{s}.cell")) & (F.col(f"l.{s}_part") == F.col(f"{s}.above")))
        both = both.filter(least <= reach).select(*kept, *(F.col(f"{s}.part").alias(f"{s}_part") for s in sides), (most <= reach).alias("all_near"))
        open_pairs = written(both, "part-pairs")
        links.append(open_pairs.filter("all_near"))
        passed += [finer, open_pairs]
    if row["n"]:
        part = F.concat_ws(",", *(F.floor(F.col(c) / (size / 4**level)).cast("string") for c in columns)) if level else F.lit("")
        points = held.select("cell", part.alias("part"), *columns)
        both = left.select(*(f"{s}_{c}" for s in sides for c in ("cell", "part", "grp"))).alias("l")
        for s in sides:
            both = both.join(points.alias(s), (F.col(f"l.{s}_cell") == F.col(f"{s}.cell")) & (F.col(f"l.{s}_part") == F.col(f"{s}.part")))
        links.append(both.filter(_d2(columns) <= reach))
    out = written(reduce(DataFrame.unionByName, (x.select(F.col("p_grp").alias("a"), F.col("q_grp").alias("b")) for x in links)).distinct(), "group-links")
    delete(*passed)
    return out


def _cell_clusters(core: DataFrame, eps: float, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """(cell, label), written: the cluster of each cell with core points. Core points of a cell are one cluster, and cells with core points within eps of each other are.

    Links are found between the outermost core points of cells first, in 8 directions of every plane; what is still apart then is settled by ``_open_links``.
    """
    sides = [*columns, *(f"({a} + {b})" for i, a in enumerate(columns) for b in columns[i + 1 :]), *(f"({a} - {b})" for i, a in enumerate(columns) for b in columns[i + 1 :])]
    whole = F.struct("pid", *columns)
    outer = core.groupBy("cell").agg(*(f(F.struct(F.expr(s).alias("s"), whole.alias("w"))).alias(f"{n}{i}") for i, s in enumerate(sides) for n, f in (("lo", F.min), ("hi", F.max))), F.min("pid").alias("rep"))
    outer = written(outer, "outer-points")
    some = outer.select("cell", F.explode(F.array_distinct(F.array(*(F.col(f"{n}{i}.w") for i in range(len(sides)) for n in ("lo", "hi"))))).alias("w")).select("cell", "w.*")
    near = (F.col("p.near") == F.col("q.cell")) & (_d2(columns) <= eps * eps) & (F.col("p.cell") < F.col("q.cell"))
    first = connected_components(_around(some, len(columns), by).alias("p").join(some.alias("q"), near).select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b")))
    groups = outer.select("cell", "rep").join(first.select(F.col("id").alias("cell"), "component"), "cell", "left")
    groups = written(groups.select("cell", "rep", F.coalesce("component", "cell").alias("grp")), "cell-groups")
    links = _open_links(core, groups.select("cell", "grp"), eps, columns, by)
    merged = connected_components(links)
    named = groups.join(merged.select(F.col("id").alias("grp"), "component"), "grp", "left").select("cell", "rep", F.coalesce("component", "grp").alias("grp"))
    # A cluster is called after its smallest pid; groups of points are numbered apart.
    named = named.join(named.groupBy("grp").agg(F.min("rep").alias("least")), "grp")
    named = named.select(*(F.col(f"cell.{b}").alias(b) for b in by), F.col("cell").alias("pid"), F.col("least").alias("rep"))
    out = written(_numbered(named, by).select(F.col("pid").alias("cell"), "label"), "cell-labels")
    delete(outer, first, groups, links, merged)
    return out


def dbscan(points: DataFrame, eps: float, min_samples: float, weights: DataFrame | None = None, columns: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., pid, label, is_core): a point is core with ``min_samples`` points, or that much weight, within eps, itself included; a border point
    takes the smallest label of a core point near it. Points of different values of ``by`` (not null) are clustered apart, all in one plan.

    Without weights, points are clustered in blocks of space, a task each, and only what leads from block to block is joined. Where points are too crowded for that, and more than a task
    should hold lie within a few eps, they are laid into cells so small that any two of a cell are neighbours. All points of a cell with ``min_samples`` points or more are core, and the core points of a cell
    are one cluster, so pairs are only made of points in emptier cells, and links only between cells. Crowded cells are told apart by boxes that get finer only where that matters. Points
    with a null, NaN or infinite coordinate are noise.
    """
    if weights is not None:
        return dbscan_from_pairs(points, eps_pairs(points, eps, columns=columns), min_samples, weights)
    if eps <= 0:
        raise ValueError("eps must be positive")
    placed = blocks.dealt(points.filter(_finite(columns)), eps, columns, by)
    if placed is None:
        return _dbscan_by_cells(points, eps, min_samples, columns, by)
    found = blocks.clustered(placed, eps, min_samples, columns, by)
    lost = points.filter(~_finite(columns)).select(*by, "pid", F.lit(NOISE).alias("label"), F.lit(False).alias("is_core"))
    out = found.unionByName(lost)
    out._punctaria_path = found._punctaria_path
    delete(placed)
    return out


def _finite(columns: tuple[str, ...]):
    return reduce(and_, (valid((c,)) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns))


def _dbscan_by_cells(points: DataFrame, eps: float, min_samples: int, columns: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """``dbscan`` where points are crowded: (by..., pid, label, is_core)."""
    points = points.filter(_finite(columns)).select(*by, "pid", *columns).unionByName(points.filter(~_finite(columns)).select(*by, "pid", *(F.lit(None).cast("double").alias(c) for c in columns)))
    laid = _laid(points, eps, min_samples, columns, by)
    sparse = _near_cells(laid, eps, columns, by)
    more = sparse.groupBy("owner", "pid").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select(F.col("owner").alias("cell"), "pid")
    core = laid.filter("dense").unionByName(laid.filter("not dense").join(more, ["cell", "pid"], "left_semi")).select("pid", *columns, "cell")
    core = written(core, "core-points")
    cell_labels = _cell_clusters(core, eps, columns, by)
    labels = written(core.select("pid", "cell").join(cell_labels, "cell").select(*(F.col(f"cell.{b}").alias(b) for b in by), "pid", "label"), "core-labels")
    # Border points: dense cells near them hold core points only, of emptier ones those that are core count.
    rim = sparse.join(more.withColumnRenamed("cell", "owner"), ["owner", "pid"], "left_anti").select(*(F.col(f"owner.{b}").alias(b) for b in by), "pid", "cell", "dense", "members")
    by_cell = rim.filter("dense").join(cell_labels, "cell").select(*by, "pid", "label")
    by_member = rim.filter("not dense").select(*by, "pid", F.explode("members").alias("q")).join(labels.withColumnRenamed("pid", "q"), [*by, "q"]).select(*by, "pid", "label")
    border = by_cell.unionByName(by_member).groupBy(*by, "pid").agg(F.min("label").alias("near"))
    out = points.select(*by, "pid").join(labels, [*by, "pid"], "left").join(border, [*by, "pid"], "left")
    out = written(out.select(*by, "pid", F.coalesce("label", "near", F.lit(NOISE)).cast("int").alias("label"), F.col("label").isNotNull().alias("is_core")), "dbscan")
    delete(laid, sparse, core, cell_labels, labels)
    return out


#: Points of emptier cells in one block of ``peeled``.
PEEL_BLOCK = 50_000


def _fallen(base: np.ndarray, of: np.ndarray, to: np.ndarray, least: float) -> np.ndarray:
    """Which points fall below ``least`` neighbours one after the other: ``base`` neighbours stay, links (of, to) go with the point ``to``, which is -1 if it lies elsewhere."""
    n = len(base)
    degree = base + np.bincount(of, minlength=n)
    inside = to >= 0
    of, to = of[inside], to[inside]
    by = np.argsort(to, kind="stable")
    of, start = of[by], np.searchsorted(to[by], np.arange(n + 1))
    gone = degree < least
    wave = np.flatnonzero(gone)
    while len(wave):
        size = start[wave + 1] - start[wave]
        at = np.repeat(start[wave] - np.cumsum(size) + size, size) + np.arange(size.sum())
        met, times = np.unique(of[at], return_counts=True)
        degree[met] -= times
        wave = met[(degree[met] < least) & ~gone[met]]
        gone[wave] = True
    return gone


def _standing(nodes: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """(block, pid, base), written: what is left of ``nodes``, written as ``links`` (block, pid, other) is, when those with fewer than ``least`` neighbours, ``base`` ones and linked ones, fall one after the other.

    A block lets its own fall until nothing moves, taking those of other blocks as they stand; then blocks tell each other what fell.
    """
    kind = nodes.schema["pid"].dataType.simpleString()

    def fall(table: pa.Table) -> pa.Table:
        is_node = table["base"].is_valid()
        nodes, links = table.filter(is_node), table.filter(pc.invert(is_node))
        own, others = nodes["pid"].to_numpy(), links["other"].to_numpy()
        by = np.argsort(own, kind="stable")
        place = lambda v: by[np.minimum(np.searchsorted(own[by], v), len(own) - 1)]
        to = place(others)
        to[own[to] != others] = -1
        gone = _fallen(nodes["base"].to_numpy(), place(links["pid"].to_numpy()), to, least)
        return nodes.select(["pid"]).filter(pa.array(gone))

    while True:
        rows = nodes.withColumn("other", F.lit(None).cast(kind)).unionByName(links.withColumn("base", F.lit(None).cast("long")))
        fallen = written(rows.groupBy("block").applyInArrow(fall, f"pid {kind}"), "fallen")
        if not fallen.take(1):
            break
        before = nodes, links
        nodes = written(nodes.join(fallen, "pid", "left_anti"), "peel-points")
        links = links.join(fallen, "pid", "left_anti").join(fallen.withColumnRenamed("pid", "other"), "other", "left_anti")
        links = written(links.select("block", "pid", "other"), "peel-links")
        delete(*before, fallen)
    delete(links, fallen)
    return nodes


def peeled(points: DataFrame, eps: float, min_samples: int, columns: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., pid, columns), written: what is left when points with fewer than ``min_samples`` neighbours, themselves included, are dropped until none is; in blocks, or by cells where points are crowded."""
    placed = blocks.dealt(points.filter(_finite(columns)), eps, columns, by, PEEL_BLOCK)
    if placed is None:
        return _peeled_by_cells(points, eps, min_samples, columns, by)
    left = blocks.stood(placed, eps, min_samples, columns, by)
    out = left.filter("__home = __block").select(*by, "pid", *columns)
    out._punctaria_path = left._punctaria_path
    delete(placed)
    return out


def _peeled_by_cells(points: DataFrame, eps: float, min_samples: int, columns: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """(pid, columns, cell), written: what is left when points with fewer than ``min_samples`` neighbours, themselves included, are dropped until none is.

    Points of a cell with that many keep each other for good, so only points of emptier cells can fall, and their neighbours in such cells are few. They are dealt to blocks by a tree
    of boxes, those of all values of ``by`` together (ids are not repeated there); a block peels its own until nothing moves, taking those of other blocks as they stand; then blocks tell each other what fell. The number of exchanges follows how
    many blocks in a row a peeling runs through, not the number of points.
    """
    laid = _laid(points, eps, min_samples, columns, by)
    near = _near_cells(laid, eps, columns, by)
    loose = laid.filter("not dense").select("pid", *columns)
    block = kd.block_of(kd.build(loose, columns, PEEL_BLOCK), columns)
    home = written(loose.select("pid", block.alias("block")), "peel-blocks")
    base = near.filter("dense").groupBy("pid").agg(F.sum("n").alias("base"))
    nodes = home.join(base, "pid", "left").select("block", "pid", (F.coalesce("base", F.lit(0)) + 1).alias("base"))
    nodes = written(nodes, "peel-points")
    links = near.filter("not dense").select("pid", F.explode("members").alias("other")).filter("other != pid").join(home, "pid")
    links = written(links.select("block", "pid", "other"), "peel-links")
    left = _standing(nodes, links, min_samples)
    out = laid.filter("dense").unionByName(laid.filter("not dense").join(left, "pid", "left_semi")).select("pid", *columns, "cell")
    out = written(out, "peeled")
    delete(laid, near, home, left)
    return out


def dbscan_loop(points: DataFrame, eps: float, min_samples: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., pid, label): clusters without border points, from which points are peeled until all that is left is core; points of different values of ``by`` apart."""
    named = points.select(*by, "pid", "x", "y")
    placed = blocks.dealt(named.filter(_finite(("x", "y"))), eps, ("x", "y"), by)
    if placed is not None:
        left = blocks.stood(placed, eps, min_samples, ("x", "y"), by)
        found = blocks.clustered(left, eps, min_samples, ("x", "y"), by, all_core=True)
        out = named.select(*by, "pid").join(found.select(*by, "pid", "label"), [*by, "pid"], "left")
        out = written(out.select(*by, "pid", F.coalesce("label", F.lit(NOISE)).cast("int").alias("label")), "dbscan-loop")
        delete(placed, left, found)
        return out
    named = named.filter(_finite(("x", "y"))).unionByName(named.filter(~_finite(("x", "y"))).select(*by, "pid", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))
    if by:  # ids that are not repeated, in the same order
        named = written(ranked(named, *by, "pid", name="__id"), "numbered")
        core = _peeled_by_cells(named.select(*by, F.col("__id").alias("pid"), "x", "y"), eps, min_samples, by=by)
    else:
        core = _peeled_by_cells(named, eps, min_samples)
    cell_labels = _cell_clusters(core, eps, ("x", "y"), by)
    labels = core.join(cell_labels, "cell").select(F.col("pid").alias("__id" if by else "pid"), "label")
    out = named.join(labels, "__id" if by else "pid", "left").select(*by, "pid", F.coalesce("label", F.lit(NOISE)).cast("int").alias("label"))
    out = written(out, "dbscan-loop")
    delete(core, cell_labels, named)
    return out


def cluster_of(points: DataFrame, eps: float, min_samples: int, pid: int | None = None) -> DataFrame:
    """(pid) of the cluster that holds a point, none if it is noise; without one, of the cluster of the smallest core point."""
    labels = dbscan(points, eps, min_samples)
    if pid is None:
        pid = labels.filter("is_core").agg(F.min("pid")).first()[0]
    own = labels.filter((F.col("pid") == pid) & (F.col("label") >= 0)).select("label")
    return labels.join(F.broadcast(own), "label", "left_semi").select("pid")


def core_by_kth_neighbour(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(pid, is_core): the neighbour of rank ``min_samples`` - 1 is nearer than eps, strictly."""
    near = knn_within(points, min_samples - 1, eps).filter(F.col("rank") == min_samples - 1)
    return points.select("pid").join(near.select("pid", "dist"), "pid", "left").select("pid", F.coalesce(F.col("dist") < eps, F.lit(False)).alias("is_core"))


def core_of_cores(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(pid, is_core, closed): core points as ``core_by_kth_neighbour`` has them, and whether all that is reached from one over the ``min_samples`` - 1 nearest neighbours of core points is core too.

    What leads to a point that is not core falls, block by block as in ``peeled``, so long chains take few exchanges. ``min_samples`` is 2 at least.
    """
    near = knn_within(points, min_samples - 1, eps)  # all those of core points lie within eps
    core = near.filter((F.col("rank") == min_samples - 1) & (F.col("dist") < eps)).select("pid")
    block = kd.block_of(kd.build(points.filter(valid(("x", "y"))), ("x", "y"), PEEL_BLOCK), ("x", "y"))
    nodes = written(points.filter(valid(("x", "y"))).join(core, "pid", "left_semi").select(block.alias("block"), "pid", F.lit(0).cast("long").alias("base")), "closure-points")
    links = near.join(nodes.select("pid", "block"), "pid").join(nodes.select(F.col("pid").alias("nn_pid")), "nn_pid", "left_semi")
    closed = _standing(nodes, written(links.select("block", "pid", F.col("nn_pid").alias("other")), "closure-links"), min_samples - 1)
    flag = lambda df, name: df.select("pid", F.lit(True).alias(name))
    out = points.select("pid").join(flag(core, "is_core"), "pid", "left").join(flag(closed, "closed"), "pid", "left")
    out = written(out.select("pid", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("closed", F.lit(False)).alias("closed")), "closure")
    delete(near, closed)
    return out


def tile_of(points: DataFrame, per_tile: int) -> DataFrame:
    """Points with their tile: about ``per_tile`` points to a tile if spread evenly, at least one tile; the last ones are closed."""
    row = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    k = max(1, int((row["n"] / per_tile) ** 0.5))
    at = lambda c, lo, hi: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((F.col(c) - lo) / max((hi - lo) / k, 1e-12)))).cast("int")
    return points.withColumn("tile", at("x", row["x0"], row["x1"]) * k + at("y", row["y0"], row["y1"]))


def tiled_dbscan(points: DataFrame, per_tile: int, eps: float, min_samples: int) -> DataFrame:
    """(tile, pid, label): each tile clustered by itself, all in one plan. Labels count within a tile."""
    tiled = written(tile_of(points, per_tile), "tiles")
    pairs = written(eps_pairs(tiled, eps, by=("tile",)).select("p", "q"), "eps-pairs")
    core = written(core_points(pairs, min_samples), "core-points")
    comp = _components_of(core, pairs).join(tiled.select("pid", "tile"), "pid")
    labels = _numbered(comp, ("tile",)).select("pid", "label")
    near = pairs.join(labels.select(F.col("pid").alias("q"), "label"), "q").groupBy(F.col("p").alias("pid")).agg(F.min("label").alias("near"))
    out = tiled.select("tile", "pid").join(labels, "pid", "left").join(near, "pid", "left")
    return out.select("tile", "pid", F.coalesce("label", "near", F.lit(NOISE)).cast("int").alias("label"))


def sampled_sizes(tiles: DataFrame, tolerance: float = 5.0, level: float = 0.05, fewest: int = 100, largest: int = 200, seed: int = 0) -> DataFrame:
    """(tile, order, n, mean, stop): cluster sizes gathered tile by tile in a seeded order until their mean is known well enough.

    Tiles of fewer than ``fewest`` points are left out, clusters of ``largest`` or more points too. With n sizes of variance v, sampling stops where
    2 (1 - Phi(tolerance * sqrt(n / v))) falls below the level, which is where tolerance * sqrt(n / v) passes a fixed quantile.
    """
    from statistics import NormalDist

    quantile = NormalDist().inv_cdf(1 - level / 2)
    counted = tiles.groupBy("tile").agg(F.count("*").alias("points")).filter(F.col("points") >= fewest)
    sizes = tiles.filter("label >= 0").join(counted, "tile", "left_semi").groupBy("tile", "label").count().filter(F.col("count") < largest)
    sums = counted.select("tile").join(sizes.groupBy("tile").agg(F.count("*").alias("k"), F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("s2")), "tile", "left").na.fill(0)
    w = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0)  # one row for each tile
    run = sums.withColumn("order", F.xxhash64("tile", F.lit(seed))).select("tile", "order", F.sum("k").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("s2").over(w).alias("s2"))
    mean = F.try_divide("s", "n")
    var = F.try_divide("s2", "n") - mean * mean
    return run.select("tile", "order", "n", mean.alias("mean"), F.coalesce(F.lit(tolerance) * F.sqrt(F.try_divide("n", var)) > quantile, F.lit(False)).alias("stop"))


def optics(points: DataFrame, min_samples: int, max_eps: float, xi: float = 0.05, by: str | None = None) -> DataFrame:
    """(pid, label): reachability order with steep-area extraction, for each group of ``by`` alone (one group without it).

    The order is sequential by definition, so a group is one task; use tiles as groups for large data.
    """
    grouped = points if by else points.withColumn("__g", F.lit(0))
    key = by or "__g"

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("pid")
        x = pdf[["x", "y"]].to_numpy(float)
        order, reach = _reachability(x, min_samples, max_eps)
        label = np.full(len(x), NOISE)
        for c, (lo, hi) in enumerate(_steep_areas(reach[order], xi, min_samples)):
            label[order[lo : hi + 1]] = c
        return pdf[["pid"]].assign(label=label.astype("int32"))

    return grouped.groupBy(key).applyInPandas(run, "pid long, label int")


def _reachability(x, min_samples: int, max_eps: float):
    import numpy as np

    n = len(x)
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for start in range(n):
        if done[start]:
            continue
        now = start
        while now >= 0:
            done[now] = True
            order.append(now)
            d = np.sqrt(((x - x[now]) ** 2).sum(1))
            near = d <= max_eps
            if near.sum() >= min_samples:
                core = np.partition(d, min_samples - 1)[min_samples - 1]
                better = near & ~done
                reach[better] = np.minimum(reach[better], np.maximum(core, d[better]))
            left = np.where(done, np.inf, reach)
            now = int(left.argmin()) if np.isfinite(left.min()) else -1
    return np.array(order), reach


def _steep_areas(reach, xi: float, min_size: int) -> list[tuple[int, int]]:
    """Disjoint valleys of a reachability plot: between a fall and a rise by a factor of 1 - xi, innermost ones of ``min_size`` points or more."""
    out, stack = [], []
    n = len(reach)
    for i in range(n):
        nxt = reach[i + 1] if i + 1 < n else float("inf")
        if nxt < reach[i] * (1 - xi):
            stack.append(i)
        elif reach[i] < nxt * (1 - xi):
            while stack and reach[stack[-1]] <= nxt:
                lo = stack.pop()
                if i - lo + 1 >= min_size and all(hi < lo for _, hi in out):
                    out.append((lo, i))
            if stack and i - stack[-1] + 1 >= min_size and all(hi < stack[-1] for _, hi in out):
                out.append((stack[-1], i))
    return sorted(out)


_ALGORITHMS: dict[str, Callable[..., DataFrame]] = {}


def register_algorithm(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make ``fn(points, **parameters) -> (pid, label)`` known under a name."""
    _ALGORITHMS[name] = fn


def cluster(points: DataFrame, algorithm: str, **parameters) -> DataFrame:
    if algorithm not in _ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}; known: {sorted(_ALGORITHMS)}")
    return _ALGORITHMS[algorithm](points, **parameters)


def timed_cluster(points: DataFrame, algorithm: str, **parameters) -> tuple[DataFrame, float]:
    """(pid, label), written, and the seconds it took."""
    began = time.monotonic()
    labels = written(cluster(points, algorithm, **parameters), "labels")
    return labels, time.monotonic() - began


def _searched(algo: str, one_two_d: str) -> Callable[..., DataFrame]:
    def run(points: DataFrame, **parameters) -> DataFrame:
        from .phase import ParameterSearch

        return ParameterSearch(algo=algo, one_two_d=one_two_d, **parameters).fit(points).labels

    return run


def staged(points: DataFrame, classify: Callable[[DataFrame, DataFrame], DataFrame], neighbours: int = 10, least: int = 3, by: str | None = None) -> DataFrame:
    """(pid, label) by stages: nearest neighbours, a classifier of points from them, clusters from those that it calls clustered.

    ``classify`` gets the points and their neighbours (pid, rank, nn_pid, dist) and returns (pid, score, label), label 1 for clustered. A classifier that finds
    nothing leaves noise.
    """
    near = knn(points, neighbours, lists=True)
    called = classify(points, neighbour_rows(near))
    called = written(called.join(points.select("pid", "x", "y", *([by] if by else [])), "pid"), "stage-called")
    formed = club(called, near, by=by, least=least, columns=("x", "y"))
    delete(near)
    return points.select("pid").join(formed, "pid", "left").select("pid", F.coalesce("cluster", F.lit(NOISE)).alias("label"))


def dense_points(cut: float) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A classifier for ``staged``: clustered are points whose neighbours are on average nearer than ``cut``; the nearer, the higher the score."""

    def run(points: DataFrame, near: DataFrame) -> DataFrame:
        mean = near.groupBy("pid").agg(F.avg("dist").alias("m"))
        return points.select("pid").join(mean, "pid", "left").select("pid", F.coalesce(1 / (1 + F.col("m")), F.lit(0.0)).alias("score"), F.coalesce((F.col("m") < cut).cast("int"), F.lit(0)).alias("label"))

    return run


register_algorithm("dbscan", lambda points, eps, min_samples: dbscan(points, eps, min_samples).select("pid", "label"))
register_algorithm("DbscanLoop", dbscan_loop)
register_algorithm("OPTICS", optics)
register_algorithm("staged", lambda points, cut, **k: staged(points, dense_points(cut), **k))
# Searches over one line or the whole grid of settings, with border points or without.
for _name, _algo, _dims in (("search_line", "dbscan", "oneD"), ("search_line_loop", "DbscanLoop", "oneD"), ("search_grid", "dbscan", "twoD"), ("search_grid_loop", "DbscanLoop", "twoD")):
    register_algorithm(_name, _searched(_algo, _dims))


#: Turns of ``club`` that one task takes; a block has about a quarter of it.
CLUB_BLOCK = 50_000


def club(points: DataFrame, neighbours: DataFrame, by: str | None = None, least: int = 3, crowded: float = 0.95, columns: tuple[str, ...] = ()) -> DataFrame:
    """(pid, cluster): clusters formed from points classified as clustered, best scores first.

    ``points`` has pid, score and label (1 clustered), ``neighbours`` pid, rank, nn_pid and, for crowded groups, dist, or pid and nn as ``knn`` has them with ``lists``. A clustered point's friends are its nearest neighbours up to the first one that is not
    clustered. In order of score, then pid, a point with fewer than ``least`` friends stops being clustered, also for those after it; any other gives itself and its friends the best
    rank that one of them holds, each clustered point holding its own at first. Where more than ``crowded`` of a group's points are clustered, friends end at the first jump in distance that stands out, if more than ``least`` do.
    Clusters are numbered by their smallest pid, within each group of ``by``.

    The result is that of going point by point, found in blocks (``turns``). With coordinates (``columns``), blocks are those of a tree of boxes; without, points that hang together through neighbours are in one block.
    """
    group = [by] if by else []
    listed = "nn" in neighbours.columns
    has_dist = listed or "dist" in neighbours.columns
    dist = F.col("dist") if has_dist else F.lit(None).cast("double")
    share = points.groupBy(*group).agg((F.count_if(F.col("label") == 1) > crowded * F.count("*")).alias("jumps"))
    queue = written(ranked(points.filter("label = 1").select("pid", "score", *group, *columns), F.desc("score"), "pid", name="r"), "club-queue")
    n = queue.count()
    tree = kd.build(queue, columns, CLUB_BLOCK // 4 or 1, n) if columns and n > CLUB_BLOCK else None
    block = kd.block_of(tree, columns) if tree is not None else F.lit(0)
    flagged = queue.join(share, by) if by else queue.crossJoin(F.broadcast(share))  # one row
    flagged = flagged.select("pid", "r", block.cast("int").alias("block"), (F.col("jumps") & F.lit(has_dist)).alias("jumps"))
    theirs = queue.select(F.col("pid").alias("nn_pid"), "r", block.cast("int").alias("block"), *(F.col(g).alias("their_group") for g in group))
    near = neighbours.select("pid", "nn") if listed else neighbours.select("pid", "rank", "nn_pid", dist.alias("dist"))
    near = near.join(queue.select("pid", *(F.col(g).alias("own_group") for g in group)), "pid")
    if listed:
        near = near.select("pid", F.explode("nn").alias("n"), *(["own_group"] if by else [])).select("*", "n.*").drop("n")
    near = near.join(theirs, "nn_pid", "left")
    ok = F.col("r").isNotNull() & (F.col("own_group").eqNullSafe(F.col("their_group")) if by else F.lit(True))
    friend = F.struct("rank", F.col("r").cast("long").alias("r"), "block", "dist")
    lists = near.groupBy("pid").agg(F.min(F.when(~ok, F.col("rank"))).alias("end"), F.sort_array(F.collect_list(F.when(ok, friend))).alias("nn"))
    friends = F.when(F.col("end").isNull(), F.col("nn")).otherwise(F.filter("nn", lambda f: f["rank"] < F.col("end")))
    none = F.array().cast(lists.schema["nn"].dataType)
    items = flagged.join(lists.select("pid", friends.alias("nn")), "pid", "left").select(F.col("pid").cast("long").alias("pid"), F.col("r").cast("long").alias("r"), "block", "jumps", F.coalesce("nn", none).alias("nn"))
    used = [queue]
    if not columns and n > CLUB_BLOCK:
        items = written(items, "club-items")
        parts = connected_components(items.select(F.col("r").alias("a"), F.explode("nn.r").alias("b")))
        some = F.pmod(F.xxhash64(F.coalesce("component", "r")), F.lit(min(kd.MOST_BLOCKS, -(-4 * n // CLUB_BLOCK)))).cast("int")
        items = items.drop("block").join(parts.withColumnRenamed("id", "r"), "r", "left").withColumn("block", some).drop("component")
        used += [items, parts]

    def pack(table: pa.Table) -> pa.Table:
        nn = table["nn"].combine_chunks()
        item = np.repeat(np.arange(len(table)), nn.value_lengths().to_numpy())
        flat = nn.flatten()
        of = [flat.field(f).to_numpy(zero_copy_only=False) for f in ("r", "block", "dist")]
        if columns == ():
            of[1] = np.full(len(item), table["block"][0].as_py())
        return turns.packed(table["block"][0].as_py(), table["r"].to_numpy(), table["pid"].to_numpy(), table["jumps"].to_numpy(), item, *of)

    if tree is not None:
        items = items.repartition(min(tree.blocks, max(24, tree.blocks // 4)), "block")  # so many tasks, however few bytes they get
    held = _settled(written(items.groupBy("block").applyInArrow(pack, turns.PACKED), "club-blocks"), least, CLUB_BLOCK)
    out = _clubs(points, held.join(queue.select(F.col("pid").cast("long").alias("pid"), *group), "pid") if by else held, tuple(group))
    delete(held, *used)
    return out


def _settled(packs: DataFrame, least: int, most: int) -> DataFrame:
    """(pid, holds), written, of the points that stay clustered, from written rows ``turns.PACKED``, which are deleted: the turn of whom each got its rank from. Blocks are taken together up to ``most`` points a task."""
    spark = packs.sparkSession

    def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.repartition(min(n, max(24, n // 4)), key).groupBy(key)  # so many tasks, however few bytes they get

    n = packs.select("block").count()
    if n == 0:
        return written(spark.createDataFrame([], "pid long, holds long"), "club-round")
    lists = packs.select("block", "r", "ends", "nn", "far")
    wanted = written(packs.select("block", F.explode("far").alias("r")), "club-wanted")
    told, asked = None, lists
    while not wanted.isEmpty():
        fallen = dealt(asked, "block", n).applyInArrow(lambda t: turns.fallen_of(t, least), "r long")
        news = fallen.distinct().join(wanted, "r").select("block", F.col("r").alias("told"))
        if told is not None:
            news = news.join(told, ["block", "told"], "left_anti").unionByName(told.withColumn("old", F.lit(True)), allowMissingColumns=True)
        old, told_now = told, written(news if told is not None else news.withColumn("old", F.lit(None).cast("boolean")), "club-told")
        fresh = told_now.filter("old is null").select("block").distinct()
        told = told_now.select("block", "told")
        told._punctaria_path = told_now._punctaria_path
        if old is not None:
            delete(old)
        if fresh.isEmpty():
            break
        asked = lists.unionByName(told, allowMissingColumns=True).join(fresh, "block", "left_semi")
    whole = packs if told is None else packs.unionByName(told, allowMissingColumns=True)
    groups = written(dealt(whole, "block", n).applyInArrow(lambda t: turns.grouped(t, least), turns.GROUPS), "club-groups")
    delete(packs, wanted, *([told] if told is not None else []))

    sizes = {r["block"]: r["n"] for r in groups.filter("n is not null").select("block", "n").collect()}  # a row a block
    tasks = turns.tasks(sizes, most, False)
    said, odd = None, False

    def swept(tasks, known, function, schema):
        of = F.broadcast(spark.createDataFrame(tasks, "block int, task int"))
        rows = groups if known is None else groups.unionByName(known, allowMissingColumns=True)
        return dealt(rows.join(of, "block"), "task", tasks[-1][1] + 1).applyInArrow(function, schema)

    def best(of_said: DataFrame) -> DataFrame:
        return of_said.join(of_said.groupBy("g").agg(F.min("val").alias("best")), "g")

    apart = tasks[-1][1] > 0 and not groups.filter("g is not null").isEmpty()
    while apart:
        known = None if said is None else best(said).select("block", "g", F.col("best").alias("val"))
        result = swept(tasks, known, turns.said, "block int, g long, val long")
        if said is not None:
            rest = said.join(F.broadcast(spark.createDataFrame(tasks, "block int, task int")), "block", "left_anti")
            result = result.unionByName(rest)
        old, said = said, written(result, "club-round")
        if old is not None:
            delete(old)
        again = {r["block"]: sizes[r["block"]] for r in best(said).filter("best < val").select("block").distinct().collect()}  # a row a block at most
        if not again:
            break
        odd = not odd
        tasks = turns.tasks(again, most, odd)
    known = None if said is None else best(said).select("block", "g", F.col("best").alias("val"))
    out = written(swept(turns.tasks(sizes, most, False), known, turns.held, "pid long, holds long"), "club-round")
    delete(groups, *([said] if said is not None else []))
    return out


def _clubs(points: DataFrame, held: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(pid, cluster) from (group..., pid, holds) of points that are clustered in the end."""
    reps = held.groupBy(*group, "holds").agg(F.min("pid").alias("rep"))
    labels = _numbered(reps.select(*group, F.col("holds").alias("pid"), "rep"), group).select(F.col("pid").alias("holds"), "label")  # a rank is of one group
    numbers = written(held.join(labels, "holds").select("pid", "label"), "club")
    kind = points.schema["pid"].dataType.simpleString()
    return points.select("pid").join(numbers, "pid", "left").select(F.col("pid").cast(kind).alias("pid"), F.coalesce("label", F.lit(NOISE)).cast("int").alias("cluster"))


def club_within(points: DataFrame, k: int, eps: float, least: int = 3, crowded: float = 0.95, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``club`` of points with coordinates and the k nearest others within eps of each.

    A block of space finds the neighbours of its own clustered points and keeps them for their turns, so that no neighbour is ever a row. Where points are too crowded for blocks, ``knn_within`` and ``club`` do it.
    """
    placed_ok = kd.valid(columns) & reduce(and_, (F.abs(F.col(c).cast("double")) < float("inf") for c in columns))
    called = F.coalesce(F.col("label") == 1, F.lit(False))
    jumps = points.agg(F.count_if(F.col("label") == 1) > crowded * F.count("*")).first()[0]
    queue = ranked(points.filter(called).select("pid", "score", *columns), F.desc("score"), "pid", name="r")
    both = queue.select("pid", *columns, F.col("r").cast("long").alias("r")).unionByName(points.filter(~called).select("pid", *columns, F.lit(None).cast("long").alias("r")))
    placed = blocks.dealt(both.filter(placed_ok), eps / 2, columns, ("r",))
    if placed is None:
        return club(points, knn_within(points, k, eps, columns), least=least, crowded=crowded, columns=columns)

    def pack(table: pa.Table) -> pa.Table:
        home, block = table["__home"].to_numpy(), table["__block"][0].as_py()
        r = table["r"].to_numpy(zero_copy_only=False)
        clustered = ~np.isnan(r.astype(float))
        q = np.flatnonzero((home == block) & clustered)
        i, nn, d2 = nearest_within(table, q, k, eps, columns)
        # Friends end before the first that is not clustered.
        size = np.bincount(i, minlength=len(q))
        end = np.cumsum(np.r_[0, ~clustered[nn]])
        keep = end[1:] == end[(np.cumsum(size) - size)[i]]
        i, nn, d2 = i[keep], nn[keep], d2[keep]
        return turns.packed(block, r[q].astype(np.int64), table["pid"].to_numpy()[q], np.full(len(q), jumps), i, r[nn].astype(np.int64), home[nn], np.sqrt(d2))

    held = _settled(written(placed.groupBy("__block").applyInArrow(pack, turns.PACKED), "club-blocks"), least, CLUB_BLOCK)
    delete(placed)
    if least < 1:  # then those without a place are clusters of their own
        held = held.unionByName(queue.filter(~placed_ok).select(F.col("pid").cast("long").alias("pid"), F.col("r").cast("long").alias("holds")))
    out = _clubs(points, held)
    delete(held)
    return out


def shaped(assignment: DataFrame, neighbours: DataFrame, eroded: bool = True, least: int = 3) -> DataFrame:
    """(pid, label, piece): points of clusters (pid, label, x, y) by the piece of their cluster's outline that holds them; noise is left out.

    A cluster's outline is the union of discs about its points whose radius is 1.2 times the mean distance to the nearest neighbour, twice that and taken back by once if ``eroded``. Two
    points are in one piece if their discs meet (for eroded outlines, if the neck between them is left). Clusters of fewer than ``least`` points and pieces of ``least`` points or fewer, where a cluster falls
    apart, have piece null: their points are demoted.
    """
    near = neighbours.filter("rank = 1").select("pid", "dist")
    rows = assignment.filter("label >= 0").join(near, "pid", "left")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), (1.2 * F.avg("dist")).alias("buffer"))
    # In units of its own buffer every cluster has the same reach.
    reach = 2 * math.sqrt(3) if eroded else 2.0
    unit = F.greatest(F.col("buffer"), F.lit(1e-12))
    own = written(rows.join(sizes.filter(F.col("n") >= least), "label").select("pid", "label", "n", (F.col("x") / unit).alias("x"), (F.col("y") / unit).alias("y")), "outline-points")
    links = eps_pairs(own, reach, by=("label",)).filter("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    parts = connected_components(links)
    pieces = own.select("pid", "label", "n").join(parts.select(F.col("id").alias("pid"), "component"), "pid", "left").withColumn("piece", F.coalesce("component", "pid"))
    held = pieces.groupBy("label", "piece").agg(F.count("*").alias("held"))
    pieces = pieces.join(held, ["label", "piece"])
    keep = (F.col("held") == F.col("n")) | (F.col("held") > least)
    demoted = assignment.filter("label >= 0").select("pid", "label")
    return demoted.join(pieces.select("pid", F.when(keep, F.col("piece")).alias("piece")), "pid", "left").select("pid", "label", "piece")


def cleaned(pieces: DataFrame) -> DataFrame:
    """(pid, label, refined): pieces numbered from 1 in order of their smallest pid, 0 and refined 0 for demoted points."""
    kept = pieces.filter("piece is not null").select("pid", F.col("piece").alias("rep"))
    numbers = _numbered(kept).select("pid", (F.col("label") + 1).alias("new"))
    out = pieces.select("pid").join(numbers, "pid", "left")
    return out.select("pid", F.coalesce("new", F.lit(0)).alias("label"), F.col("new").isNotNull().cast("int").alias("refined"))


def hulls(assignment: DataFrame, fewest: int = 3) -> DataFrame:
    """(label, ring, area, population, cx, cy) of clusters with (label, x, y): convex outlines.

    The outline has every corner of the convex hull, counter-clockwise.
    """
    from .spatial import convex_hulls, ring_area

    wanted = assignment.filter("label >= 0")
    sizes = wanted.groupBy("label").agg(F.count("*").alias("population"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).filter(F.col("population") >= fewest)
    return sizes.join(convex_hulls(wanted, "label"), "label").select("label", "ring", ring_area(F.col("ring")).alias("area"), "population", "cx", "cy")
