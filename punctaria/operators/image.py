"""Pixel tables (ix, iy, v): histograms, thresholds, filters, components and masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import _numbered
from .components import connected_components

#: Side of a tile of a dense image; a task works on one tile at a time.
TILE = 1024


def histogram2d(points: DataFrame, bounds: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """(ix, iy, v) of occupied pixels; the last bins are closed. Counts are combined before the shuffle."""
    x0, x1, y0, y1 = bounds
    at = lambda c, lo, hi, n: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    inside = points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.groupBy(at("x", x0, x1, nx).alias("ix"), at("y", y0, y1, ny).alias("iy")).agg(F.count("*").cast("double").alias("v"))


def histogram2d_by_label(points: DataFrame, bounds: tuple[float, float, float, float], n: int) -> DataFrame:
    """(ix, iy, n_all, n_clustered)."""
    x0, x1, y0, y1 = bounds
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    inside = points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.groupBy(at("x", x0, x1).alias("ix"), at("y", y0, y1).alias("iy")).agg(F.count("*").alias("n_all"), F.count_if(F.col("label") >= 0).alias("n_clustered"))


def clip_at_quantile(image: DataFrame, quantile: float, nonzero_only: bool = True, n_pixels: int | None = None) -> DataFrame:
    """Values above a quantile, of the occupied pixels or of all ``n_pixels``, lowered to it."""
    if nonzero_only:
        cut = image.filter("v != 0").agg(F.percentile("v", F.lit(quantile)).alias("cut"))
    else:
        # Zeros by their number: the quantile's place among the sorted occupied pixels, between zero and the first of them, or zero.
        n = image.count()
        at = quantile * (n_pixels - 1) - (n_pixels - n)
        value = F.percentile("v", F.lit(min(1.0, at / max(1, n - 1)))) if at >= 0 else F.min("v") * max(0.0, at + 1)
        cut = image.agg(F.coalesce(value, F.lit(0.0)).alias("cut"))
    return image.join(F.broadcast(cut)).select("ix", "iy", F.least("v", "cut").alias("v"))


def dense(image: DataFrame, nx: int, ny: int) -> DataFrame:
    """All pixels, zeros included."""
    spark = image.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") / ny).cast("int").alias("ix"), (F.col("id") % ny).cast("int").alias("iy"))
    return grid.join(image, ["ix", "iy"], "left").na.fill(0.0, ["v"])


def _kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(image: DataFrame, nx: int, ny: int, sigma: float) -> DataFrame:
    """Gaussian filter with mirrored borders over all nx x ny pixels of a sparse image.

    The image is cut into tiles; occupied pixels also go to the tiles whose margin, as wide as the kernel reaches, they lie in. A tile is filtered with one separable pass for each axis, which gives the same
    as for the whole image, and no task holds more than a tile and its margin.
    """
    kernel = _kernel(sigma)
    r = len(kernel) // 2
    side = max(TILE, 2 * r)
    tiles = [-(-n // side) for n in (nx, ny)]

    def around(c: str, k: int):
        """The tiles along an axis that a pixel, or its margin, touches."""
        first, last = F.greatest(F.floor((F.col(c) - r) / side), F.lit(0)), F.least(F.floor((F.col(c) + r) / side), F.lit(tiles[k] - 1))
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    inside = image.select(F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("v").cast("double").alias("v")).filter(F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1))
    held = inside.withColumn("tx", around("ix", 0)).withColumn("ty", around("iy", 1))
    every = image.sparkSession.range(tiles[0] * tiles[1]).select(F.lit(None).cast("int").alias("ix"), F.lit(None).cast("int").alias("iy"), F.lit(None).cast("double").alias("v"), F.floor(F.col("id") / tiles[1]).cast("int").alias("tx"), (F.col("id") % tiles[1]).cast("int").alias("ty"))

    def run(pdf):
        lo = [int(pdf["tx"].iloc[0]) * side, int(pdf["ty"].iloc[0]) * side]
        hi = [min(lo[0] + side, nx), min(lo[1] + side, ny)]
        first, last = [max(0, v - r) for v in lo], [min(n, v + r) for n, v in zip((nx, ny), hi, strict=True)]
        px = pdf.dropna(subset=["v"])
        a = np.zeros((last[0] - first[0], last[1] - first[1]))
        a[px["ix"].to_numpy(int) - first[0], px["iy"].to_numpy(int) - first[1]] = px["v"]
        for axis, n in ((0, nx), (1, ny)):
            # Margins that lie outside the image mirror it.
            margin = [(r - (lo[k] - first[k]), r - (last[k] - hi[k])) if k == axis else (0, 0) for k in (0, 1)]
            padded = np.pad(a, margin, mode="symmetric")
            a = sum(w * np.take(padded, np.arange(i, i + hi[axis] - lo[axis]), axis=axis) for i, w in enumerate(kernel))
        ix, iy = np.indices(a.shape)
        return pd.DataFrame({"ix": (ix.ravel() + lo[0]).astype("int32"), "iy": (iy.ravel() + lo[1]).astype("int32"), "v": a.ravel()})

    return held.select("ix", "iy", "v", "tx", "ty").unionByName(every).groupBy("tx", "ty").applyInPandas(run, "ix int, iy int, v double")


def autocorrelation(image: DataFrame, nx: int, ny: int) -> DataFrame:
    """(dx, dy, v): circular autocorrelation of all nx x ny pixels of a sparse image by its Fourier transform, 1 for the image's square of the mean.

    Rows are transformed first, then columns, which are squared and transformed back, then rows again; between these steps the values change place in a shuffle, so a task holds one row or column at a time.
    """
    total = image.agg(F.sum("v")).first()[0] or 0.0
    level = total * total / (nx * ny) or 1.0

    def rows(pdf):
        a = np.zeros(ny)
        a[pdf["iy"]] = pdf["v"]
        f = np.fft.fft(a)
        return pd.DataFrame({"ix": np.full(ny, pdf["ix"].iloc[0], "int32"), "k": np.arange(ny, dtype="int32"), "re": f.real, "im": f.imag})

    def columns(pdf):
        a = np.zeros(nx, complex)
        a[pdf["ix"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        f = np.fft.ifft(np.abs(np.fft.fft(a)) ** 2)
        return pd.DataFrame({"ix": np.arange(nx, dtype="int32"), "k": np.full(nx, pdf["k"].iloc[0], "int32"), "re": f.real, "im": f.imag})

    def back(pdf):
        a = np.zeros(ny, complex)
        a[pdf["k"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return pd.DataFrame({"dx": np.full(ny, pdf["ix"].iloc[0], "int32"), "dy": np.arange(ny, dtype="int32"), "v": np.fft.ifft(a).real / level})

    part = "ix int, k int, re double, im double"
    return image.groupBy("ix").applyInPandas(rows, part).groupBy("k").applyInPandas(columns, part).groupBy("ix").applyInPandas(back, "dx int, dy int, v double")


def otsu_threshold(image: DataFrame, bins: int = 256) -> float:
    """Threshold that separates a dense image's values best into two classes: largest between-class variance over histogram cuts."""
    row = image.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None or lo == hi:
        return lo or 0.0
    step = (hi - lo) / bins
    counts = image.groupBy(F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)).cast("int").alias("b")).count()
    rows = {r["b"]: r["count"] for r in counts.collect()}  # at most ``bins`` rows
    n = np.array([rows.get(b, 0) for b in range(bins)], float)
    centre = lo + (np.arange(bins) + 0.5) * step
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1, m2 = np.cumsum(n * centre) / np.maximum(w1, 1), (np.cumsum((n * centre)[::-1]) / np.maximum(w2[::-1], 1))[::-1]
    return float(centre[int(np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2))])


def components(mask: DataFrame) -> DataFrame:
    """(ix, iy, label) of pixels, 8-connected, numbered from 1 in order of their first pixel."""
    key = F.shiftleft(F.col("ix").cast("long"), 32) + F.col("iy").cast("long")
    px = mask.select("ix", "iy", key.alias("k"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = px.select("k", "ix", "iy", F.explode(steps).alias("s")).select("k", (F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iy") + F.col("s.b")).alias("iy"))
    edges = near.join(px.select("ix", "iy", F.col("k").alias("q")), ["ix", "iy"]).select(F.col("k").alias("a"), F.col("q").alias("b"))
    parts = connected_components(edges)
    rep = px.join(parts.withColumnRenamed("id", "k"), "k", "left").select("ix", "iy", F.coalesce("component", "k").alias("rep"))
    numbers = _numbered(rep.select(F.struct("ix", "iy").alias("pid"), "rep"))
    return numbers.select("pid.ix", "pid.iy", (F.col("label") + 1).alias("label"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Pixels of the most frequent label, the smallest of equally frequent ones."""
    top = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label")
    return labels.join(F.broadcast(top), "label", "left_semi").select("ix", "iy")


def dilate(mask: DataFrame, nx: int, ny: int, times: int) -> DataFrame:
    """4-neighbour dilation; pixels on the border of the image are never added."""
    out = mask.select("ix", "iy").distinct()
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))))
    for _ in range(times):
        grown = out.select("ix", "iy", F.explode(steps).alias("s")).select((F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iy") + F.col("s.b")).alias("iy"), ((F.col("s.a") == 0) & (F.col("s.b") == 0)).alias("own"))
        out = grown.filter(F.col("own") | ((F.col("ix") > 0) & (F.col("ix") < nx - 1) & (F.col("iy") > 0) & (F.col("iy") < ny - 1))).select("ix", "iy").distinct()
    return out


def occupancy(image: DataFrame, n_pixels: int) -> DataFrame:
    """Occupied over empty pixels."""
    return image.agg(F.try_divide(F.count_if(F.col("v") > 0), F.lit(n_pixels) - F.count_if(F.col("v") > 0)).alias("ratio"))


def to_8bit(image: DataFrame) -> DataFrame:
    top = image.agg(F.max("v").alias("m"))
    return image.join(F.broadcast(top)).select("ix", "iy", F.coalesce(F.try_divide(F.col("v") * 255, F.col("m")), F.lit(0.0)).cast("int").alias("v"))


def segment(points: DataFrame, nx: int = 500, quantile: float = 0.95, sigma: float = 5, pad: int = 20, nonzero_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(in-cell, out-cell) points: histogram, clip, blur, Otsu, components; the largest component is the cell, its dilation's outside the rest."""
    row = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, x1, y0, y1 = row
    step = (x1 - x0) / nx
    ny = max(1, int(np.ceil((y1 - y0) / step)))
    y1 = y0 + ny * step
    h = clip_at_quantile(histogram2d(points, (x0, x1, y0, y1), nx, ny), quantile, nonzero_only, nx * ny)
    blurred = gaussian(h, nx, ny, sigma)
    cut = otsu_threshold(blurred)
    inside = largest_component(components(blurred.filter(F.col("v") > cut)))
    padded = dilate(inside, nx, ny, pad)
    at = lambda c, lo, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - lo) / step).cast("int")))
    placed = points.withColumn("ix", at("x", x0, nx)).withColumn("iy", at("y", y0, ny))
    return placed.join(inside, ["ix", "iy"], "left_semi").select(*points.columns), placed.join(padded, ["ix", "iy"], "left_anti").select(*points.columns)
