"""Grids of clustering parameters, their phase space, and the choice of parameters from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grids
from .clustering import NOISE, _numbered
from .components import connected_components
from .spatial import eps_pairs, knn
from .storage import delete, written


def log_grid(low: float, high: float, n: int) -> list[float]:
    """Distinct values from low to high, evenly spaced in logarithms."""
    if n == 1 or low == high:
        return [low]
    a, b = math.log(low), math.log(high)
    return sorted({math.exp(a + (b - a) * k / (n - 1)) for k in range(n)})


def sigma_bounds(points: DataFrame, k: int, low: float = 0.1, high: float = 0.9) -> tuple[float, float]:
    """Quantiles of the distance to the k-th neighbour."""
    d = knn(points, k).filter(F.col("rank") == k).agg(F.percentile("dist", F.lit([low, high])).alias("q")).first()["q"]
    return float(d[0]), float(d[1])


def grid(spark: SparkSession, sigmas: list[float], thresholds: list[int]) -> DataFrame:
    """(idx, sigma, threshold), sigma-major."""
    rows = [(i * len(thresholds) + j, float(s), int(t)) for i, s in enumerate(sigmas) for j, t in enumerate(thresholds)]
    return spark.createDataFrame(rows, "idx int, sigma double, threshold int")


#: A block of the local part of ``_assignment_by_pairs`` is this many times the largest sigma wide.
BLOCK_SIGMAS = 8


class Clusterings:
    """Labels of all cells of a grid, a row a point (see ``grids.labels``); what is counted from them is counted once."""

    def __init__(self, wide: DataFrame, cells: list[tuple[int, float, int]], noise_free: bool) -> None:
        self.wide, self.cells, self.noise_free, self._sizes = wide, cells, noise_free, None

    def idx(self, place: Column) -> Column:
        return F.get(F.array(*(F.lit(i) for i, _, _ in self.cells)), place)

    def assignment(self) -> DataFrame:
        rows = self.wide.select("pid", F.posexplode("labels").alias("place", "label"))
        out = rows.select(self.idx(F.col("place")).alias("idx"), "pid", "label")
        out._clusterings = self
        return out

    def sizes(self) -> DataFrame:
        if self._sizes is None:
            self._sizes = grids.sizes(self.wide, len(self.cells))
        return self._sizes

    def clusters(self) -> DataFrame:
        """(idx, label, n)."""
        return self.sizes().groupBy("idx", "label").agg(F.sum("n").alias("n")).select(self.idx(F.col("idx")).alias("idx"), "label", "n")

    def overlaps(self) -> DataFrame:
        met = grids.overlaps(self.wide, self.sizes(), self.cells, self.noise_free)
        return met.withColumns({c: self.idx(F.col(c)) for c in ("i", "j")})

    def alike(self, share: float) -> DataFrame:
        """(i, a, js): other clusterings with a similar cluster."""
        found = grids.alike(self.wide, self.sizes(), self.cells, self.noise_free, share)
        return found.select(self.idx(F.col("i")).alias("i"), "a", F.transform("js", self.idx).alias("js"))


def phase_assignment(points: DataFrame, cells: list[tuple[int, float, int]], noise_free: bool = False) -> DataFrame:
    """(idx, pid, label) of all cells (idx, sigma, threshold) of a grid: in blocks of space, or over pairs where points are crowded."""
    cells = [(int(i), float(s), int(t)) for i, s, t in cells]
    wide = grids.labels(points, cells, noise_free)
    return _assignment_by_pairs(points, cells, noise_free) if wide is None else Clusterings(wide, cells, noise_free).assignment()


def _assignment_by_pairs(points: DataFrame, cells: list[tuple[int, float, int]], noise_free: bool = False) -> DataFrame:
    """``phase_assignment`` where points are crowded.

    Pairs are found once, at the largest sigma, and kept with the first sigma that holds them. A point has one level for each sigma: the number of thresholds that it is core at, which are
    always the smallest ones; counting neighbours gives it, and for the noise-free variant repeating that over neighbours of at least the same level, all cells in the same rounds. The
    clusters of all thresholds of a sigma are then found in one go from high levels to low: within blocks of space first, in a task each, then over the pairs between blocks, whose
    ends are block clusters by then.
    """
    spark = points.sparkSession
    sigmas, thresholds = sorted({s for _, s, _ in cells}), sorted({t for _, _, t in cells})
    at = {(s, t): i for i, s, t in cells}
    side = F.lit(float(max(sigmas)) * BLOCK_SIGMAS)
    block = F.struct(F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))
    first = sum(((F.col("d2") > s * s).cast("int") for s in sigmas), F.lit(0)).cast("byte")
    pairs = written(eps_pairs(points, max(sigmas)).filter("p < q").select("p", "q", "d2", first.alias("s0")), "pairs")
    both = pairs.select("p", "q", "s0").unionAll(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"), "s0"))
    counts = both.groupBy(F.col("p").alias("pid")).agg(F.array(*(F.count_if(F.col("s0") <= i) + 1 for i in range(len(sigmas)))).alias("n"))
    level = lambda n: sum(((n >= t).cast("int") for t in thresholds), F.lit(0)).cast("byte")
    alone = F.array(*(F.lit(1) for _ in sigmas))
    levels = points.select("pid", block.alias("block")).join(counts, "pid", "left").select("pid", "block", F.transform(F.coalesce("n", alone), level).alias("v"))
    levels = written(levels, "levels")
    if noise_free:
        levels = _settled_levels(levels, both, sigmas, thresholds)
    vp = levels.select(F.col("pid").alias("p"), F.col("block").alias("bp"), F.col("v").alias("vp"))
    vq = levels.select(F.col("pid").alias("q"), F.col("block").alias("bq"), F.col("v").alias("vq"))
    ends = written(pairs.select("p", "q", "s0").join(vp, "p").join(vq, "q"), "pair-levels")
    itself = levels.select(F.col("pid").alias("p"), F.col("pid").alias("q"), F.lit(0).cast("byte").alias("s0"), F.col("v").alias("vp"), F.col("v").alias("vq"), "block").filter(F.exists("v", lambda x: x > 0))
    inner = ends.filter("bp = bq").select("p", "q", "s0", "vp", "vq", F.col("bp").alias("block")).unionAll(itself)
    held = spark.sparkContext.broadcast((len(sigmas), thresholds, {(si, ti): at[s, t] for si, s in enumerate(sigmas) for ti, t in enumerate(thresholds) if (s, t) in at}))
    local = written(inner.groupBy("block").applyInPandas(lambda pdf: _block_clusters(pdf, *held.value), "idx int, pid long, rep long"), "block-clusters")
    # Between blocks: each cell in which both ends are core.
    table = [F.struct(F.lit(i).alias("idx"), F.lit(sigmas.index(s)).alias("s"), F.lit(thresholds.index(t) + 1).alias("t")) for i, s, t in cells]
    shared = F.filter(F.array(*table), lambda c: (c["s"] >= F.col("s0")) & (F.get("vp", c["s"]) >= c["t"]) & (F.get("vq", c["s"]) >= c["t"]))
    across = ends.filter("bp != bq").select("p", "q", F.explode(F.transform(shared, lambda c: c["idx"])).alias("idx"))
    across = across.join(local.select("idx", F.col("pid").alias("p"), F.col("rep").alias("rp")), ["idx", "p"]).join(local.select("idx", F.col("pid").alias("q"), F.col("rep").alias("rq")), ["idx", "q"])
    across = across.select(F.struct("idx", F.col("rp").alias("rep")).alias("a"), F.struct("idx", F.col("rq").alias("rep")).alias("b")).distinct()
    joined = connected_components(across).select(F.col("id.idx").alias("idx"), F.col("id.rep").alias("rep"), F.col("component.rep").alias("least"))
    reps = local.join(joined, ["idx", "rep"], "left").select("idx", "pid", F.coalesce("least", "rep").alias("rep"))
    labels = _numbered(reps, ("idx",))
    everyone = points.select("pid").join(F.broadcast(_cells(spark, cells).select("idx")))
    out = everyone.join(labels, ["idx", "pid"], "left")
    if not noise_free:
        labels = written(labels, "core-labels")
        near = F.filter(F.array(*table), lambda c: (c["s"] >= F.col("s0")) & (F.get("vp", c["s"]) < c["t"]) & (F.get("vq", c["s"]) >= c["t"]))
        ways = ends.select("p", "q", "s0", "vp", "vq").unionAll(ends.select(F.col("q").alias("p"), F.col("p").alias("q"), "s0", F.col("vq").alias("vp"), F.col("vp").alias("vq")))
        rim = ways.select("p", "q", F.explode(F.transform(near, lambda c: c["idx"])).alias("idx"))
        border = rim.join(labels.select("idx", F.col("pid").alias("q"), "label"), ["idx", "q"]).groupBy("idx", F.col("p").alias("pid")).agg(F.min("label").alias("near"))
        out = everyone.join(labels, ["idx", "pid"], "left").join(border, ["idx", "pid"], "left").withColumn("label", F.coalesce("label", "near"))
    out = written(out.select("idx", "pid", F.coalesce("label", F.lit(NOISE)).cast("int").alias("label")), "assignment")
    delete(pairs, levels, ends, local, labels)
    return out


def _settled_levels(levels: DataFrame, both: DataFrame, sigmas: list[float], thresholds: list[int]) -> DataFrame:
    """Levels at which points stay core among the points of at least their level: what is left of each cell when points that are not core are dropped until all are.

    Each round a point takes the highest level that enough of its neighbours have too; levels only fall, and where none does they are those of the peeled graphs.
    """
    import numpy as np
    import pyarrow as pa

    need, kind = np.array(thresholds), levels.schema["block"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            pids, blocks, own, lists = batch.columns
            n = len(pids)
            v = own.flatten().to_numpy().reshape(n, len(sigmas))
            members = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            new = np.zeros_like(v)
            if len(members):
                s0, theirs = (members.field(k) for k in ("s0", "v"))
                theirs = theirs.flatten().to_numpy().reshape(len(members), len(sigmas))
                theirs = np.where(s0.to_numpy()[:, None] <= np.arange(len(sigmas))[None], theirs, 0)
                some = np.flatnonzero(size)
                begin = (np.cumsum(size) - size)[some]
            for j, t in enumerate(need):
                count = np.ones(v.shape, np.int64)
                if len(members):
                    count[some] += np.add.reduceat((theirs > j).astype(np.int64), begin, axis=0)
                new += ((count >= t) & (v > j)).astype(new.dtype)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(sigmas), pa.int32()), pa.array(new.ravel(), pa.int8()))
            yield pa.RecordBatch.from_arrays([pids, blocks, flat, pa.array((new != v).any(1))], ["pid", "block", "v", "changed"])

    now = levels
    while True:
        told = both.join(now.select(F.col("pid").alias("q"), "v"), "q").groupBy(F.col("p").alias("pid")).agg(F.collect_list(F.struct("s0", "v")).alias("near"))
        empty = F.array().cast(told.schema["near"].dataType)
        rows = now.select("pid", "block", "v").join(told, "pid", "left").select("pid", "block", "v", F.coalesce("near", empty).alias("near"))
        new = written(rows.mapInArrow(run, f"pid long, block {kind}, v array<tinyint>, changed boolean"), "levels")
        delete(now)
        now = new
        if not now.filter("changed").take(1):
            return now


def _block_clusters(pdf, n_sigmas: int, thresholds: list[int], idx_of: dict):
    """(idx, pid, rep) of the core points of a block in each cell: the smallest pid that they reach within the block."""
    import numpy as np
    import pandas as pd

    ids, codes = np.unique(np.concatenate([pdf["p"].to_numpy(), pdf["q"].to_numpy()]), return_inverse=True)
    p, q = np.split(codes, 2)
    vp, vq = (np.array(pdf[c].tolist(), np.int8).reshape(len(pdf), n_sigmas) for c in ("vp", "vq"))
    s0, own = pdf["s0"].to_numpy(), p == q
    out = []
    for s in range(n_sigmas):
        level = np.zeros(len(ids), np.int8)
        level[p[own]] = vp[own, s]
        weight = np.where((s0 <= s) & ~own, np.minimum(vp[:, s], vq[:, s]), 0)
        rep = np.arange(len(ids))
        for j in range(len(thresholds), 0, -1):  # edges of high levels hold at all lower ones
            here = weight == j
            a, b = p[here], q[here]
            while len(a):
                x, y = rep[a], rep[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                if not len(a):
                    break
                np.minimum.at(rep, np.maximum(x, y), np.minimum(x, y))
                while (rep[rep] != rep).any():
                    rep = rep[rep]
            core = np.flatnonzero(level >= j)
            if (s, j - 1) in idx_of and len(core):
                out.append(pd.DataFrame({"idx": np.full(len(core), idx_of[s, j - 1], np.int32), "pid": ids[core], "rep": ids[rep[core]]}))
    return pd.concat(out) if out else pd.DataFrame({"idx": np.empty(0, np.int32), "pid": np.empty(0, np.int64), "rep": np.empty(0, np.int64)})


def _cells(spark: SparkSession, cells: list[tuple[int, float, int]]) -> DataFrame:
    """The grid, as many rows as the caller listed."""
    return F.broadcast(spark.createDataFrame([(int(i), float(s), int(t)) for i, s, t in cells], "idx int, sigma double, threshold int"))


def _clusters(assignment: DataFrame) -> DataFrame:
    """(idx, label, n): clusters and their sizes."""
    whole = getattr(assignment, "_clusterings", None)
    return assignment.filter("label >= 0").groupBy("idx", "label").agg(F.count("*").alias("n")) if whole is None else whole.clusters()


def phase_space(cells: DataFrame, assignment: DataFrame) -> DataFrame:
    """(idx, sigma, threshold, no_clusters, no_points_clustered)."""
    counts = _clusters(assignment).groupBy("idx").agg(F.count("*").alias("no_clusters"), F.sum("n").alias("no_points_clustered"))
    return cells.join(counts, "idx", "left").na.fill(0, ["no_clusters", "no_points_clustered"])


def cluster_info(cells: DataFrame, assignment: DataFrame, kind: str) -> DataFrame:
    """(index, labels, clusterSize, threshold, sigma, type)."""
    sizes = _clusters(assignment).withColumnRenamed("n", "clusterSize")
    return sizes.join(cells, "idx").select(F.col("idx").alias("index"), F.col("label").alias("labels"), "clusterSize", "threshold", "sigma", F.lit(kind).alias("type"))


def overlaps(assignment: DataFrame) -> DataFrame:
    """(i, a, j, b, n, na, nb): clusters of different clusterings with common points.

    A point's labels meet as one array; blocks or batches of points count all pairs of clusterings together, so only counts are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    whole = getattr(assignment, "_clusterings", None)
    if whole is not None:
        return _both_ways(whole.overlaps())

    named = assignment.filter("label >= 0")
    sizes = written(named.groupBy("idx", "label").agg(F.count("*").alias("n")), "cluster-sizes")
    lists = named.groupBy("pid").agg(F.collect_list(F.struct("idx", "label")).alias("l")).select("l")

    def run(batches):
        for batch in batches:
            cells = batch.column(0)
            size, flat = np.diff(cells.offsets.to_numpy()), cells.flatten()
            idx, label = (flat.field(k).to_numpy() for k in ("idx", "label"))
            known, column = np.unique(idx, return_inverse=True)
            table = np.full((len(size), len(known)), -1, np.int64)
            table[np.repeat(np.arange(len(size)), size), column] = label
            table, times = np.unique(table, axis=0, return_counts=True)  # points that agree everywhere count together
            most = int(table.max(initial=0)) + 1
            for i in range(len(known)):
                rows = np.flatnonzero(table[:, i] >= 0)
                parts = []
                for j in range(i + 1, len(known)):
                    both = rows[table[rows, j] >= 0]
                    keys, place = np.unique(table[both, i] * most + table[both, j], return_inverse=True)
                    if len(keys):
                        parts.append((keys // most, np.full(len(keys), known[j]), keys % most, np.bincount(place, times[both])))
                if parts:
                    a, j, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), known[i]), pa.int32()), pa.array(a, pa.int32()), pa.array(j, pa.int32()), pa.array(b, pa.int32()), pa.array(n.astype(np.int64))], ["i", "a", "j", "b", "n"])

    met = lists.mapInArrow(run, "i int, a int, j int, b int, n long").groupBy("i", "a", "j", "b").agg(F.sum("n").alias("n"))
    na = sizes.select(F.col("idx").alias("i"), F.col("label").alias("a"), F.col("n").alias("na"))
    nb = sizes.select(F.col("idx").alias("j"), F.col("label").alias("b"), F.col("n").alias("nb"))
    return _both_ways(met.join(na, ["i", "a"]).join(nb, ["j", "b"]).select("i", "a", "j", "b", "n", "na", "nb"))


def _both_ways(met: DataFrame) -> DataFrame:
    return met.unionAll(met.select(F.col("j").alias("i"), F.col("b").alias("a"), F.col("i").alias("j"), F.col("a").alias("b"), "n", F.col("nb").alias("na"), F.col("na").alias("nb")))


def half_of_both(share: float = 0.5) -> Column:
    """Default similarity: the common points are more than a share of either cluster. A choice of this library."""
    return (F.col("n") > share * F.col("na")) & (F.col("n") > share * F.col("nb"))


def _alike(assignment: DataFrame, predicate: Column | float) -> DataFrame:
    """(i, a, js): clusters with the other clusterings that have a similar cluster, by a share of both or a predicate of ``overlaps``; those without any are left out."""
    whole = getattr(assignment, "_clusterings", None)
    if whole is not None and not isinstance(predicate, Column):
        return whole.alike(float(predicate))
    similar = overlaps(assignment).filter(predicate if isinstance(predicate, Column) else half_of_both(predicate))
    return similar.groupBy("i", "a").agg(F.collect_set("j").alias("js"))


def _scores(assignment: DataFrame, alike: DataFrame) -> DataFrame:
    """(idx, label, similarityScore) from similar clusters (i, a, js)."""
    per = alike.select(F.col("i").alias("idx"), F.col("a").alias("label"), F.size("js").cast("long").alias("similarityScore"))
    return _clusters(assignment).select("idx", "label").join(per, ["idx", "label"], "left").na.fill(0, ["similarityScore"])


def similarity(assignment: DataFrame, predicate: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of clusters (idx, label, similarityScore) and of clusterings (idx, similarityScore).

    A cluster scores one for each other clustering that has a similar cluster; a clustering the sum of its clusters'.
    """
    scores = _scores(assignment, _alike(assignment, 0.5 if predicate is None else predicate))
    return scores, scores.groupBy("idx").agg(F.sum("similarityScore").alias("similarityScore"))


def _matrix(alike: DataFrame) -> DataFrame:
    return alike.select("i", F.explode("js").alias("j")).groupBy("i", "j").agg(F.count("*").alias("score"))


def similarity_matrix(assignment: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(i, j, score): number of clusters of i that have a similar one in j."""
    return _matrix(_alike(assignment, 0.5 if predicate is None else predicate))


def line_of_optima(df: DataFrame, x: str, y: str, idx: str = "idx", bins: int = 0) -> DataFrame:
    """For each value of x, or for each of equal-width bins closed on the right, the row with the largest y, the first of equal ones."""
    if bins:
        row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        lo, hi = 0.99 * row["lo"], 1.01 * row["hi"]
        step = (hi - lo) / bins
        group = F.ceil((F.col(x) - lo) / step)
        df = df.filter((group >= 1) & (group <= bins)).withColumn("__bin", group)
    else:
        df = df.withColumn("__bin", F.col(x))
    w = Window.partitionBy("__bin").orderBy(F.desc(y), idx)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__bin")


def best_row(df: DataFrame, y: str, idx: str = "idx", condition: Column | None = None) -> DataFrame:
    """The row with the largest y among those that meet a condition."""
    return (df if condition is None else df.filter(condition)).orderBy(F.desc(y), idx).limit(1)


def select_threshold(optima: DataFrame, score: str = "similarityScore", cut: float = 0.5) -> DataFrame:
    """The first threshold whose rescaled score along the line of optima is below the cut, else the last. One row for each threshold."""
    w = Window.partitionBy()
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    scaled = optima.withColumn("scaled", F.try_divide(F.col(score) - lo, hi - lo))
    below = F.coalesce(F.col("scaled") < cut, F.lit(False))
    return scaled.orderBy(F.desc(below.cast("int")), F.when(below, F.col("threshold")).otherwise(-F.col("threshold"))).limit(1)


class ParameterSearch:
    """Clusters with parameters chosen by how well clusters persist over a grid of parameters.

    ``algo`` is ``dbscan`` or ``DbscanLoop`` (noise-free). The grid has ``points_per_dimension`` sigmas and as many thresholds within ``minmax_threshold``, which are whole numbers; sigmas lie between quantiles of the
    distance to the neighbour of rank ``neighbour`` (``adaptive_sigma_boundaries``), or between given ``sigma_boundaries``. ``similarity_score_computation`` is ``threshold``: clusters are similar that share more than
    ``threshold`` of both, or a column of its own over ``overlaps``. ``one_two_d`` is ``oneD``: selection along the line of optima, or ``twoD``: the most similar clustering of the whole grid.
    """

    def __init__(self, algo: str = "DbscanLoop", one_two_d: str = "oneD", similarity_score_computation: str | Column = "threshold", threshold: float = 0.5, points_per_dimension: int = 15, minmax_threshold: tuple[int, int] = (5, 20), log_sigmas: bool = True, log_thresholds: bool = False, adaptive_sigma_boundaries: bool = True, sigma_boundaries: tuple[float, float] | None = None, neighbour: int = 10, quantiles: tuple[float, float] = (0.1, 0.9)) -> None:
        if algo not in ("dbscan", "DbscanLoop"):
            raise ValueError(f"unknown algorithm {algo}")
        if one_two_d not in ("oneD", "twoD"):
            raise ValueError(f"one_two_d is oneD or twoD, not {one_two_d}")
        if isinstance(similarity_score_computation, str) and similarity_score_computation != "threshold":
            raise ValueError(f"unknown similarity {similarity_score_computation}")
        if not adaptive_sigma_boundaries and sigma_boundaries is None:
            raise ValueError("sigma_boundaries are needed where they are not adaptive")
        self.algo, self.n, self.minmax_threshold, self.one_two_d = algo, points_per_dimension, minmax_threshold, one_two_d
        self.log_sigmas, self.log_thresholds, self.neighbour, self.quantiles = log_sigmas, log_thresholds, neighbour, quantiles
        self.sigma_boundaries = None if adaptive_sigma_boundaries else sigma_boundaries
        self.predicate = threshold if isinstance(similarity_score_computation, str) else similarity_score_computation

    def settings(self, points: DataFrame) -> list[tuple[int, float, int]]:
        """(idx, sigma, threshold), sigma-major."""
        lo, hi = self.sigma_boundaries or sigma_bounds(points, self.neighbour, *self.quantiles)
        lo = max(lo, 1e-9)
        even = lambda a, b: [a + (b - a) * k / max(1, self.n - 1) for k in range(self.n)]
        sigmas = log_grid(lo, hi, self.n) if self.log_sigmas else sorted(set(even(lo, hi)))
        thresholds = sorted({round(t) for t in (log_grid if self.log_thresholds else lambda a, b, n: even(a, b))(*self.minmax_threshold, self.n)})
        return [(i * len(thresholds) + j, s, t) for i, s in enumerate(sigmas) for j, t in enumerate(thresholds)]

    def fit(self, points: DataFrame, grid_from: DataFrame | None = None, skip_similarity: bool = False, kind: str = "incell") -> ParameterSearch:
        """Cluster over the whole grid, whose sigmas come from ``grid_from`` if given. Without similarity nothing is selected."""
        spark = points.sparkSession
        self.points, self.cells = points, self.settings(points if grid_from is None else grid_from)
        table = spark.createDataFrame(self.cells, "idx int, sigma double, threshold int")
        self.assignment = phase_assignment(points, self.cells, noise_free=self.algo == "DbscanLoop")
        self.phasespace = phase_space(table, self.assignment)
        info = cluster_info(table, self.assignment, kind)
        if skip_similarity:
            self.cluster_info = info
            return self
        self.similar = written(_alike(self.assignment, self.predicate), "similar-clusters")
        scores = _scores(self.assignment, self.similar)
        total = scores.groupBy("idx").agg(F.sum("similarityScore").alias("similarityScore"))
        self.cluster_info = info.join(scores.select(F.col("idx").alias("index"), F.col("label").alias("labels"), "similarityScore"), ["index", "labels"])
        self.phasespace = written(self.phasespace.join(total, "idx", "left").na.fill(0, ["similarityScore"]), "phase-space")
        self.optima = line_of_optima(self.phasespace, "threshold", "similarityScore")
        self.selected = select_threshold(self.optima) if self.one_two_d == "oneD" else best_row(self.phasespace, "similarityScore")
        self.labels = self.assignment.join(F.broadcast(self.selected.select("idx")), "idx", "left_semi").select("pid", "label")
        return self

    def selected_parameters(self) -> dict:
        row = self.selected.first()
        return {"sigma": row["sigma"], "threshold": row["threshold"]}

    def compute_clusters(self, sigma: float, threshold: int, points: DataFrame | None = None) -> DataFrame:
        """(pid, label) at one setting, of the fitted points or of others."""
        points = self.points if points is None else points
        return phase_assignment(points, [(0, float(sigma), int(threshold))], noise_free=self.algo == "DbscanLoop").select("pid", "label")

    def similarity_matrix(self) -> DataFrame:
        """(i, j, score): number of clusters of i that have a similar one in j."""
        return _matrix(self.similar)

    def score_distribution(self, idx: int) -> DataFrame:
        """(pid, label, similarityScore) of the points of one clustering: how often a point's cluster is found elsewhere; 0 for noise."""
        scores = self.cluster_info.filter(F.col("index") == idx).select(F.col("labels").alias("label"), "similarityScore")
        return self.assignment.filter(F.col("idx") == idx).join(F.broadcast(scores), "label", "left").select("pid", "label", F.coalesce("similarityScore", F.lit(0)).alias("similarityScore"))


def in_and_out_cell(inside: DataFrame, outside: DataFrame, search: ParameterSearch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phase spaces of a region and of a reference region on the same grid, that of the region, joined by setting.

    Returns (idx, sigma, threshold, no_clusters, no_points_clustered, similarityScore, no_clusters_ref, no_points_clustered_ref), the cluster infos of both with their
    type, and the assignments of both (idx, pid, label, type).
    """
    search.fit(inside)
    ref = ParameterSearch.__new__(ParameterSearch)
    ref.__dict__.update({k: v for k, v in search.__dict__.items() if k in ("algo", "predicate", "one_two_d")})
    ref.settings = lambda points: search.cells
    ref.fit(outside, skip_similarity=True, kind="outcell")
    other = ref.phasespace.select("sigma", "threshold", F.col("no_clusters").alias("no_clusters_ref"), F.col("no_points_clustered").alias("no_points_clustered_ref"))
    joined = search.phasespace.join(other, ["sigma", "threshold"]).select("idx", "sigma", "threshold", "no_clusters", "no_points_clustered", "similarityScore", "no_clusters_ref", "no_points_clustered_ref")
    info = search.cluster_info.unionByName(ref.cluster_info, allowMissingColumns=True)
    labels = search.assignment.withColumn("type", F.lit("incell")).unionByName(ref.assignment.withColumn("type", F.lit("outcell")))
    return joined, info, labels


def optimal_t(info: DataFrame, criterion: str, fewest: int = 10, rate: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., T, score, n_in, n_out): the value of in-cell clusters above which they stand out most against out-cell ones.

    Each distinct in-cell value t is a candidate if more than ``fewest`` clusters of both types lie above it; its score is
    p_in / (p_in + p_out) with the shares above t. The first with the largest score capped at ``rate`` wins. Without a candidate T is 0.
    """
    v = F.col(criterion).cast("double")
    kinds = [F.count_if(F.col("type") == k).alias(f"n{i}") for i, k in enumerate(("incell", "outcell"))]
    values = info.groupBy(*by, v.alias("t")).agg(*kinds)
    total = info.groupBy(*by).agg(F.count_if(F.col("type") == "incell").alias("all_in"), F.count_if(F.col("type") == "outcell").alias("all_out"))
    w = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)  # distinct values only
    above = values.withColumn("above_in", F.coalesce(F.sum("n0").over(w), F.lit(0))).withColumn("above_out", F.coalesce(F.sum("n1").over(w), F.lit(0)))
    joined = above.join(total, list(by)) if by else above.join(F.broadcast(total))
    p_in, p_out = F.try_divide("above_in", "all_in"), F.coalesce(F.try_divide("above_out", "all_out"), F.lit(0.0))
    scored = joined.filter((F.col("n0") > 0) & (F.col("above_in") + F.col("above_out") > fewest)).withColumn("score", F.try_divide(p_in, p_in + p_out))
    order = Window.partitionBy(*by).orderBy(F.desc(F.least("score", F.lit(rate))), "t")
    best = scored.withColumn("r", F.row_number().over(order)).filter("r = 1").select(*by, F.col("t").alias("T"), "score", F.col("above_in").alias("n_in"), F.col("above_out").alias("n_out"))
    out = total.join(best, list(by), "left") if by else total.join(F.broadcast(best), how="left")
    return out.select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("T", "score", "n_in", "n_out")))


def cleaned_labels(info: DataFrame, criterion: str, limits: DataFrame, by: tuple[str, ...] = ("index",)) -> DataFrame:
    """(index, T, no_clusters, no_clusters_ref, no_clusters_s_vs_n): clusters above each row's T and how far in-cell ones stand out.

    Null where a type has no cluster, 0 where none lies above T.
    """
    joined = info.join(limits.select(*by, "T"), list(by))
    over = F.col(criterion) > F.col("T")
    inside, outside = F.col("type") == "incell", F.col("type") == "outcell"
    n = joined.groupBy(*by, "T").agg(F.count_if(inside & over).alias("no_clusters"), F.count_if(outside & over).alias("no_clusters_ref"), F.count_if(inside).alias("a"), F.count_if(outside).alias("b"))
    p1, p2 = F.try_divide("no_clusters", "a"), F.try_divide("no_clusters_ref", "b")
    value = F.when(F.col("no_clusters") + F.col("no_clusters_ref") == 0, F.lit(0.0)).when((F.col("a") == 0) | (F.col("b") == 0), F.lit(None)).otherwise(F.try_divide(p1, p1 + p2))
    return n.select(*by, "T", "no_clusters", "no_clusters_ref", value.alias("no_clusters_s_vs_n"))


def share_kept(assignment: DataFrame, info: DataFrame, criterion: str, limits: DataFrame) -> DataFrame:
    """(idx, percent_locsIncluded): share of points in clusters of at least T, the rest having become noise."""
    keep = info.join(limits.select("index", "T"), "index").filter(F.col(criterion) >= F.col("T")).select(F.col("index").alias("idx"), F.col("labels").alias("label"), F.lit(1).alias("k"))
    return assignment.join(keep, ["idx", "label"], "left").groupBy("idx").agg((F.count("k") / F.count("*")).alias("percent_locsIncluded"))
