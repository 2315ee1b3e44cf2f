"""Neighbour-distance features, targets and training pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import hashed_rank

# Names of the normalisations.
NORMALISATIONS = ["Raw-Distances", "Norm-Distances-Only", "Raw-Differences", "Diff-Norm", "Norm-Diff", "Norm-Diffs-Only-NoRescale", "Norm-Self", "Norm-FirstDiff", "Norm-MinDiff", "Norm-MaxDiff", "CoordsOnly"]
SCALE = 100_000


def distance_arrays(neighbours: DataFrame) -> DataFrame:
    """(pid, d, nn): distances and neighbours in order of rank."""
    g = neighbours.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "nn_pid"))).alias("a"))
    return g.select("pid", F.col("a.dist").alias("d"), F.col("a.nn_pid").alias("nn"))


def differences(a: Column) -> Column:
    return F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def _unit(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def _scaled(a: Column) -> Column:
    return F.transform(a, lambda x: (x * SCALE).cast("int").cast("double"))


def normalise(arrays: DataFrame, kind: str, column: str = "d") -> DataFrame:
    """``arrays`` with a column f of normalised features."""
    d = F.col(column)
    if kind == "Raw-Distances":
        f = d
    elif kind == "Norm-Distances-Only":
        f = _unit(d)
    elif kind == "Raw-Differences":
        f = differences(d)
    elif kind == "Diff-Norm":
        f = _scaled(_unit(differences(d)))
    elif kind == "Norm-Diff":
        f = _scaled(differences(_unit(d)))
    elif kind == "Norm-Diffs-Only-NoRescale":
        f = _unit(differences(d))
    elif kind == "Norm-Self":
        f = F.transform(d, lambda x: F.try_divide(x - F.array_min(d), F.array_max(d) - F.array_min(d)))
    elif kind == "Norm-FirstDiff":
        diff = differences(d)
        f = F.transform(diff, lambda x: F.try_divide(x, diff[0]))
    elif kind == "Norm-MinDiff":
        diff = arrays.select(F.explode(differences(d)).alias("x")).filter("x != 0").agg(F.min("x").alias("__least"))
        return arrays.join(F.broadcast(diff)).withColumn("f", F.transform(differences(d), lambda x: F.try_divide(x, F.col("__least")))).drop("__least")
    elif kind == "Norm-MaxDiff":
        # One row: the largest difference of each rank.
        tops = arrays.select(F.posexplode(differences(d)).alias("i", "x")).groupBy("i").agg(F.max("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("__top"))
        return arrays.join(F.broadcast(tops)).withColumn("f", F.zip_with(differences(d), F.col("__top"), lambda x, m: F.try_divide(x, m))).drop("__top")
    elif kind == "CoordsOnly":
        f = F.array().cast("array<double>")
    else:
        raise ValueError(f"unknown normalisation {kind}; known: {NORMALISATIONS}")
    return arrays.withColumn("f", f)


def run_length(classes: Column, own: Column) -> Column:
    """Number of leading neighbours of the point's own class, at most one less than there are (``run_len_capped``)."""
    n = F.size(classes)
    other = F.filter(F.transform(classes, lambda c, i: F.when(c != own, i)), lambda i: i.isNotNull())
    return F.least(F.coalesce(F.try_element_at(other, F.lit(1)), n), n - 1).cast("int")


def relative_coordinates(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(pid, f): coordinates of a point's neighbours about it, rescaled to 0..1 with the point's own, then about the point again; x, y (and z) by neighbour."""
    dims = [c for c in ("x", "y", "z") if c in points.columns]
    q = points.select(F.col("pid").alias("nn_pid"), *(F.col(c).alias(f"q{c}") for c in dims))
    rel = neighbours.join(points, "pid").join(q, "nn_pid").select("pid", "rank", *((F.col(f"q{c}") - F.col(c)).alias(c) for c in dims))
    rows = rel.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", *dims))).alias("a"))
    flat = F.flatten(F.transform("a", lambda s: F.array(*(s[c] for c in dims))))
    lo, hi = F.least(F.array_min(flat), F.lit(0.0)), F.greatest(F.array_max(flat), F.lit(0.0))
    return rows.select("pid", F.transform(flat, lambda v: F.coalesce(F.try_divide(v, hi - lo), F.lit(0.0))).alias("f"))


def outlier_cut(a: Column) -> Column:
    """Index of the first jump whose deviation from the median, in median absolute deviations, exceeds five of these; null without one."""
    jumps = F.sort_array(a)
    middle = lambda s: F.try_divide(s[F.floor((F.size(s) - 1) / 2).cast("int")] + s[F.floor(F.size(s) / 2).cast("int")], F.lit(2.0))
    m = middle(jumps)
    deviations = F.transform(a, lambda x: F.abs(x - m))
    mad = middle(F.sort_array(deviations))
    hit = F.filter(F.transform(deviations, lambda d, i: F.when(F.try_divide(d, mad) > 5 * mad, i)), lambda i: i.isNotNull())
    return F.try_element_at(hit, F.lit(1))


def pool(rows: DataFrame, label: str, quotas: dict[str, int], seed: int = 0, key: str = "pid", order: Column | None = None) -> DataFrame:
    """``rows`` with a column part: exact quotas of train, validation and test rows, the same number from each class, the last class absorbing what rounding leaves.

    Order within a class is by a seeded hash, or by another number of 64 bits, so it is the same on any cluster. Raises if a class is too small.
    """
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]  # class labels, few by nature
    have = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    share = {c: {p: q // len(classes) for p, q in quotas.items()} for c in classes}
    for p, q in quotas.items():
        share[classes[-1]][p] += q - sum(s[p] for s in share.values())
    for c in classes:
        if sum(share[c].values()) > have[c]:
            raise ValueError(f"class {c} has {have[c]} rows where {sum(share[c].values())} are wanted")
    part = F.lit(None).cast("string")
    for c in classes:
        upto = 0
        for p in quotas:
            lo, upto = upto, upto + share[c][p]
            part = F.when((F.col(label) == c) & (F.col("__r") > lo) & (F.col("__r") <= upto), F.lit(p)).otherwise(part)
    return hashed_rank(rows, (label,), key, seed, order=order).withColumn("part", part).filter("part is not null").select(*rows.columns, "part")


def stratified_folds(rows: DataFrame, label: str, k: int = 10, seed: int = 270879, key: str = "pid", order: Column | None = None) -> DataFrame:
    """``rows`` with a fold 0..k-1 such that each class is spread evenly."""
    return hashed_rank(rows, (label,), key, seed, order=order).withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).select(*rows.columns, "fold")


def sample_rows(rows: DataFrame, most: int | None = None, fraction: float | None = None, seed: int = 0, key: str = "pid", order: Column | None = None) -> DataFrame:
    """A random subset without replacement; all rows if there are few enough."""
    if most is None:
        most = int(rows.count() * fraction)
    return hashed_rank(rows, (), key, seed, order=order).filter(F.col("__r") <= most).select(*rows.columns)


def leading_class(neighbours: DataFrame, classes: DataFrame) -> DataFrame:
    """(pid, run_len_capped) for kNN rows and classes (pid, class)."""
    own = classes.select("pid", F.col("class").alias("own"))
    other = classes.select(F.col("pid").alias("nn_pid"), "class")
    rows = neighbours.join(other, "nn_pid").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "class"))).alias("a"))
    return rows.join(own, "pid").select("pid", run_length(F.col("a.class"), F.col("own")).alias("run_len_capped"))


def label_from_score(score: Column, threshold: float = 0.5) -> Column:
    """0 or 1, a score at the threshold giving 0."""
    return F.bround(score - (threshold - 0.5)).cast("int")


def argmax_label(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
