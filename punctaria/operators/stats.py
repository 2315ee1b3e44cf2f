"""Statistics of clusters, grids and regions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_sizes(assignment: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, clusterSize) without noise."""
    return assignment.filter("label >= 0").groupBy(*by, "label").agg(F.count("*").alias("clusterSize"))


def sizes_along(assignment: DataFrame, optima: DataFrame) -> DataFrame:
    """Cluster sizes of the clusterings on a line of optima (idx, threshold), with the threshold."""
    return assignment.filter("label >= 0").join(F.broadcast(optima.select("idx", "threshold")), "idx").groupBy("idx", "threshold", "label").agg(F.count("*").alias("clusterSize"))


def size_statistics(sizes: DataFrame, by: str = "threshold", size: str = "clusterSize") -> DataFrame:
    """n, mean, median, q90, q10, cv, fano, skewness, kurtosis and the number of sizes below threshold + 1."""
    v = F.col(size).cast("double")
    return sizes.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("q90"), F.percentile(v, F.lit(0.1)).alias("q10"),
        F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv"), F.try_divide(F.var_pop(v), F.avg(v)).alias("fano"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.count_if(v < F.col(by) + 1).alias("firstBin"),
    )


def type_statistics(info: DataFrame, by: tuple[str, ...] = ("threshold", "type"), value: str = "clusterSize") -> DataFrame:
    """median, count, min, max, std (sample), cv, skewness, kurtosis, fano of each group."""
    v = F.col(value).cast("double")
    return info.groupBy(*by).agg(F.median(v).alias("median"), F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"), F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.try_divide(F.var_pop(v), F.avg(v)).alias("fano"))


def heat_map(df: DataFrame, index: str, columns: str, value: str, names: list, agg: str = "avg") -> DataFrame:
    """Pivot of an aggregate; the column values are given, so the plan has no pass to find them."""
    return df.groupBy(index).pivot(columns, names).agg(getattr(F, agg)(value))


def normalised(df: DataFrame, column: str) -> DataFrame:
    """A column over its global maximum."""
    top = df.agg(F.max(column).alias("__m"))
    return df.join(F.broadcast(top)).withColumn(column, F.try_divide(column, "__m")).drop("__m")


def density(points: DataFrame) -> DataFrame:
    """Points over the area of their bounding box."""
    return points.agg(F.try_divide(F.count("*"), (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("density"))


def diameters(clusters: DataFrame, by: str = "tid") -> DataFrame:
    """Largest distance within each cluster: between two corners of its convex hull."""
    from .spatial import convex_hulls

    far = F.array_max(F.transform("ring", lambda p: F.array_max(F.transform("ring", lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))))
    return convex_hulls(clusters, by).select(by, F.sqrt(far).alias("diameter"))


def noise_shares(assignment: DataFrame, large: int) -> DataFrame:
    """One row: share of noise and of points in clusters of more than ``large`` points."""
    sizes = assignment.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.try_divide(F.sum(F.when(F.col("label") < 0, F.col("n")).otherwise(0)), F.sum("n")).alias("noise_share"), F.try_divide(F.sum(F.when((F.col("label") >= 0) & (F.col("n") > large), F.col("n")).otherwise(0)), F.sum("n")).alias("large_share"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, weight: Column | None = None) -> DataFrame:
    """(bin, share) over equal bins, the last closed."""
    step = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("int")
    w = F.lit(1.0) if weight is None else weight
    sums = df.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.sum(w).alias("w"))
    return sums.select("bin", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("share"))


def log_histogram(df: DataFrame, value: str, per_decade: int) -> DataFrame:
    return df.filter(F.col(value) > 0).groupBy(F.floor(F.log10(F.col(value)) * per_decade).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def modal_bin(sizes: DataFrame, by: str = "threshold", size: str = "clusterSize", most: float = 40.5) -> DataFrame:
    """The most frequent size, rounded, of each group, the smallest of equally frequent ones."""
    binned = sizes.filter((F.col(size) >= 0.5) & (F.col(size) < most)).groupBy(by, F.floor(F.col(size) + 0.5).cast("int").alias("centre")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "centre")
    return binned.withColumn("r", F.row_number().over(w)).filter("r = 1").select(by, "centre", "n")


def negative_binomial(sizes: DataFrame, size: str = "clusterSize", most: float = 100) -> DataFrame:
    """Moment estimates r = E^2 / (V - E), p = 1 - E / V of sizes below a limit."""
    v = F.col(size).cast("double")
    m = sizes.filter(v < most).agg(F.avg(v).alias("e"), F.var_pop(v).alias("v"))
    return m.select(F.try_divide(F.col("e") * F.col("e"), F.col("v") - F.col("e")).alias("r"), (1 - F.try_divide("e", "v")).alias("p"))


def _least_squares(share: np.ndarray, k: np.ndarray, pmf: Callable, start: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Parameters (on a scale without bounds) of least squared error, by damped Gauss steps: damping falls when a step helps and grows when it does not."""
    x, damp = start, 1e-3
    error = share - pmf(k, x)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(x), 1e-3)
        slope = np.stack([(pmf(k, x + d) - pmf(k, x - d)) / (2 * d[i]) for i, d in enumerate(np.diag(step))], 1)
        normal, pull = slope.T @ slope, slope.T @ error
        change = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), pull)
        new = share - pmf(k, x + change)
        if np.isfinite(new).all() and new @ new <= error @ error:
            done = error @ error - new @ new <= 1e-15 * (error @ error) and np.abs(change).max() < 1e-10
            x, error, damp = x + change, new, max(damp / 10, 1e-12)
            if done:
                break
        elif (damp := damp * 10) > 1e12:
            break
    return x, float(error @ error)


def _poisson(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    mean = np.exp(x[0])
    return np.exp(k * x[0] - mean - _log_factorial(k))


def _negative_binomial(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    r, q = np.exp(np.clip(x[0], -50, 20)), 1 / (1 + np.exp(-x[1]))
    rising = np.concatenate([[0.0], np.cumsum(np.log(r + np.arange(len(k) - 1)))])  # k runs from 0
    return np.exp(rising - _log_factorial(k) + r * np.log1p(-q) + k * np.log(q))


def _log_factorial(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(k))))])


def fitted_counts(sizes: DataFrame, size: str = "clusterSize", by: tuple[str, ...] = (), most: int = 100) -> DataFrame:
    """(by..., n, mean, poisson_error, r, p, nb_error): Poisson and negative binomial distributions fitted to the shares of the counts 0 to ``most`` by least squares, for each group.

    Only the histogram of a group, of ``most`` + 1 rows, reaches the task that fits it. ``p`` is the probability of the mean's growth, so the mean is r p / (1 - p). Other sizes and nulls are left out; sizes
    are rounded down. Starts from the moments, the negative binomial from its limit where the variance is not above the mean.
    """
    value = F.floor(F.col(size)).cast("long")
    counts = sizes.select(*by, value.alias("k")).filter((F.col("k") >= 0) & (F.col("k") <= most)).groupBy(*by, "k").agg(F.count("*").alias("n"))
    counts = counts if by else counts.withColumn("__g", F.lit(0))
    keys = list(by) or ["__g"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(pdf["k"], pdf["n"], most + 1)
        k, share = np.arange(most + 1), n / n.sum()
        mean = max(float(k @ share), 1e-6)
        spread = float(((k - mean) ** 2) @ share)
        a, a_error = _least_squares(share, k, _poisson, np.array([np.log(mean)]))
        r = mean * mean / (spread - mean) if spread > mean * 1.001 else 1000.0 * mean
        b, b_error = _least_squares(share, k, _negative_binomial, np.array([np.log(r), np.log(mean / r)]))
        row = (*(pdf[c].iloc[0] for c in keys), int(n.sum()), float(np.exp(a[0])), a_error, float(np.exp(b[0])), float(1 / (1 + np.exp(-b[1]))), b_error)
        return pd.DataFrame([row], columns=[*keys, "n", "mean", "poisson_error", "r", "p", "nb_error"])

    schema = ", ".join([*(f"{c} {counts.schema[c].dataType.simpleString()}" for c in keys), "n long, mean double, poisson_error double, r double, p double, nb_error double"])
    out = counts.groupBy(*keys).applyInPandas(fit, schema)
    return out if by else out.drop("__g")


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Sum of p log2(p / q) over bins (bin, share); null if p has a bin that q lacks."""
    j = p.select("bin", F.col("share").alias("p")).join(q.select("bin", F.col("share").alias("q")), "bin", "left").filter("p > 0")
    bad = F.count_if(F.col("q").isNull() | (F.col("q") == 0))
    return j.agg(F.when(bad == 0, F.sum(F.col("p") * F.log2(F.try_divide("p", "q")))).alias("kl"))


def midpoint_derivative(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(x_mid, slope) between neighbours in x."""
    w = Window.partitionBy(*by).orderBy(x)
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    return df.select(*by, ((F.col(x) + nx) / 2).alias("x_mid"), F.try_divide(ny - F.col(y), nx - F.col(x)).alias("slope")).filter("x_mid is not null")


def rescaled_series(df: DataFrame, x: str, y: str, cut: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, scaled, first_above): y rescaled to 0..1 and turned to rise, and the first x where it exceeds the cut."""
    w = Window.partitionBy(*by)
    o = w.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = F.min(y).over(w), F.max(y).over(w)
    s = F.try_divide(F.col(y) - lo, hi - lo)
    falls = F.first(y).over(o) > F.last(y).over(o)
    out = df.withColumn("scaled", F.when(falls, 1 - s).otherwise(s))
    return out.withColumn("first_above", F.min(F.when(F.col("scaled") > cut, F.col(x))).over(w)).select(*by, x, "scaled", "first_above")


def series_ratios(results: DataFrame) -> DataFrame:
    """True and false positives over the number of clusters, for rows (var_1, var_2, algo, true_positives, false_positives, N_clusters)."""
    return results.select("var_1", "var_2", "algo", F.try_divide("true_positives", "N_clusters").alias("true_positives_ratio"), F.try_divide("false_positives", "N_clusters").alias("false_positives_ratio"))


def roi_statistics(points: DataFrame, membership: DataFrame, areas: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """For each ROI (roi, area): points, clustered points, their share, clusters, densities, median cluster population. ``membership`` is (pid, roi).

    With ``shapes`` (label, area, population) of clusters also the medians of the area and the density of the clusters that have points in it.
    """
    inside = membership.join(points, "pid")
    sizes = inside.filter("label >= 0").groupBy("roi", "label").agg(F.count("*").alias("n"))
    clusters = sizes.groupBy("roi").agg(F.count("*").alias("clusters"), F.median("n").alias("median_points"))
    counts = inside.groupBy("roi").agg(F.count("*").alias("points"), F.count_if(F.col("label") >= 0).alias("clustered"))
    out = areas.join(counts, "roi", "left").join(clusters, "roi", "left").na.fill(0, ["points", "clustered", "clusters"])
    more = []
    if shapes is not None:
        known = sizes.join(with_shapes(shapes), "label").groupBy("roi").agg(F.median("cluster_area").alias("median_area"), F.median("cluster_density").alias("median_density"))
        out, more = out.join(known, "roi", "left"), ["median_area", "median_density"]
    return out.select("roi", "area", "points", "clustered", F.try_divide("clustered", "points").alias("clustered_share"), "clusters", F.try_divide("points", "area").alias("points_per_area"), F.try_divide("clusters", "area").alias("clusters_per_area"), "median_points", *more)


def with_shapes(shapes: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """(label, cluster_area, cluster_population, cluster_density), joined to the points of an assignment by label if given."""
    known = shapes.select("label", F.col("area").alias("cluster_area"), F.col("population").alias("cluster_population"), F.try_divide("population", F.nullif(F.col("area"), F.lit(0.0))).alias("cluster_density"))
    return known if assignment is None else assignment.join(known, "label", "left")
