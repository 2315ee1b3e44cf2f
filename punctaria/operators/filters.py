"""Filters and projections on point, label and parameter tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOISE = -1


def open_box(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    return points.filter((F.col("x") > xmin) & (F.col("x") < xmax) & (F.col("y") > ymin) & (F.col("y") < ymax))


def half_open_box(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    return points.filter((F.col("x") >= xmin) & (F.col("x") < xmax) & (F.col("y") >= ymin) & (F.col("y") < ymax))


def crop(table: DataFrame, bounds: list[tuple[float, float]], columns: list[str]) -> DataFrame:
    """Open intervals in one to three columns."""
    if not 1 <= len(columns) <= 3 or len(bounds) != len(columns):
        raise ValueError("one pair of bounds for each of one to three columns")
    return table.filter(reduce(and_, ((F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in zip(columns, bounds, strict=True))))


def centre_crop(points: DataFrame, width: float, height: float, to_origin: bool = True) -> DataFrame:
    """Closed box of a size around the centre of the bounding box, moved to the origin if asked for."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    joined = points.join(F.broadcast(b))  # one row
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    kept = joined.filter(F.col("x").between(cx - width / 2, cx + width / 2) & F.col("y").between(cy - height / 2, cy + height / 2))
    if to_origin:
        kept = kept.withColumn("x", F.col("x") - (cx - width / 2)).withColumn("y", F.col("y") - (cy - height / 2))
    return kept.select(*points.columns)


def clip_top(column: str, most: float) -> Column:
    return F.least(F.col(column), F.lit(most)).alias(column)


def remove_small_labels(assignment: DataFrame, info: DataFrame, criterion: str, limit: float) -> DataFrame:
    """Labels of clusters whose criterion is below the limit become noise."""
    small = info.filter(F.col(criterion) < limit).select("label", F.lit(True).alias("__small"))
    return assignment.join(small, "label", "left").withColumn("label", F.when(F.col("__small"), NOISE).otherwise(F.col("label"))).select(*assignment.columns)


def keep_labels(assignment: DataFrame, labels: list[int]) -> DataFrame:
    return assignment.withColumn("label", F.when(F.col("label").isin(*labels), F.col("label")).otherwise(NOISE))


def noise_below_population(assignment: DataFrame, edge: int) -> DataFrame:
    """Labels of ``edge`` points or fewer become noise."""
    sizes = assignment.groupBy("label").agg(F.count("*").alias("__n"))
    return assignment.join(sizes, "label").withColumn("label", F.when(F.col("__n") > edge, F.col("label")).otherwise(NOISE)).select(*assignment.columns)


def check_points(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> dict:
    """Raise for missing values or extreme aspect ratios; else the axis limits."""
    row = points.agg(*(F.min(c).alias(f"{c}_min") for c in columns), *(F.max(c).alias(f"{c}_max") for c in columns), *(F.count_if(F.isnan(c) | F.col(c).isNull()).alias(f"{c}_bad") for c in columns)).first()
    bad = {c: row[f"{c}_bad"] for c in columns if row[f"{c}_bad"]}
    if bad:
        raise ValueError(f"missing values: {bad}")
    spans = [row[f"{c}_max"] - row[f"{c}_min"] for c in columns]
    if spans[1] == 0 or not 0.1 <= spans[0] / spans[1] <= 10:
        raise ValueError(f"aspect ratio out of range: {spans}")
    if len(spans) > 2 and spans[2] > 2 * max(spans[:2]):
        raise ValueError("z spans more than twice x and y")
    return row.asDict()


def nearest_setting(phase: DataFrame, sigma: float, threshold: float) -> DataFrame:
    """The row nearest to a setting by the sum of absolute differences, the first of equally near ones."""
    l1 = F.abs(F.col("threshold") - threshold) + F.abs(F.col("sigma") - sigma)
    return phase.orderBy(l1, "idx").limit(1)


def setting_by_ordinal(phase: DataFrame, sigma_ordinal: int, threshold_ordinal: int) -> DataFrame:
    """Rows whose sigma and threshold are the given ones, from 0, among the sorted distinct values. Grids are small: two ranks over them."""
    s = phase.select("sigma").distinct().withColumn("i", F.row_number().over(Window.orderBy("sigma")) - 1).filter(F.col("i") == sigma_ordinal)
    t = phase.select("threshold").distinct().withColumn("j", F.row_number().over(Window.orderBy("threshold")) - 1).filter(F.col("j") == threshold_ordinal)
    return phase.join(F.broadcast(s.select("sigma")), "sigma", "left_semi").join(F.broadcast(t.select("threshold")), "threshold", "left_semi")


def ordinals(phase: DataFrame) -> DataFrame:
    """Each row with the ordinals of its sigma and threshold."""
    s = phase.select("sigma").distinct().withColumn("sigma_ordinal", F.row_number().over(Window.orderBy("sigma")) - 1)
    t = phase.select("threshold").distinct().withColumn("threshold_ordinal", F.row_number().over(Window.orderBy("threshold")) - 1)
    return phase.join(s, "sigma").join(t, "threshold")


def centred(points: DataFrame, by: str, factor: float = 1.0) -> DataFrame:
    """Each group's points about their mean, times a factor."""
    m = points.groupBy(by).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    return points.join(m, by).withColumn("x", (F.col("x") - F.col("__mx")) * factor).withColumn("y", (F.col("y") - F.col("__my")) * factor).select(*points.columns)


def rounded_axes(points: DataFrame, step: float, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Axis limits: minimum down and maximum up to a multiple of the step."""
    return points.agg(*(e for c in columns for e in ((F.floor(F.min(c) / step) * step).alias(f"{c}_min"), (F.ceil(F.max(c) / step) * step).alias(f"{c}_max"))))


def n_nearest(points: DataFrame, x0: float, y0: float, n: int) -> DataFrame:
    """Points closer to a centre than the one of ordinal n (from 0), or than the farthest if there are no more than n.

    That is n points without ties; with n or fewer in all, the farthest is left out.
    """
    d = F.sqrt((F.col("x") - x0) * (F.col("x") - x0) + (F.col("y") - y0) * (F.col("y") - y0))
    far = points.select(d.alias("d")).orderBy("d").limit(n + 1).agg(F.max("d").alias("r"))
    return points.withColumn("d", d).join(F.broadcast(far)).filter(F.col("d") < F.col("r")).drop("r")


def define_window(inside: DataFrame, outside: DataFrame, centres: tuple[tuple[float, float], tuple[float, float]], n: int) -> tuple[DataFrame, str]:
    """About ``n`` points around a centre of each of two sets: (pid, x, y, type), and the settings as JSON."""
    import json

    parts = [n_nearest(p, *c, n).select("pid", "x", "y", F.lit(k).alias("type")) for p, c, k in zip((inside, outside), centres, ("incell", "outcell"), strict=True)]
    return parts[0].unionByName(parts[1]), json.dumps({"n": n, "incell": list(centres[0]), "outcell": list(centres[1])}, sort_keys=True)


def large_clusters(info: DataFrame, criterion: str, least: float, strictly: bool = False) -> DataFrame:
    """Clusters whose criterion is at least, or more than, a limit."""
    return info.filter(F.col(criterion) > least if strictly else F.col(criterion) >= least)


def first_occurrence(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Without later copies of a point; the smallest pid stays."""
    first = points.groupBy(*columns).agg(F.min("pid").alias("pid")).select("pid")
    return points.join(first, "pid", "left_semi")
