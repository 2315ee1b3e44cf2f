"""Scalar helpers that match numerical conventions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.bround(value).cast("long")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def distance(*differences: Column) -> Column:
    return F.sqrt(sum((d * d for d in differences[1:]), differences[0] * differences[0]))


def truncated(value: Column, scale: int = 100_000) -> Column:
    """Times a scale, as an integer cut towards zero."""
    return (value * scale).cast("int")


def linspace(low: float | Column, high: float | Column, n: int) -> Column:
    """Array of n even steps between two numbers or columns."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * ((high - low) / max(1, n - 1)))


def logspace(low: float | Column, high: float | Column, n: int) -> Column:
    low, high = (F.log(v if isinstance(v, Column) else F.lit(float(v))) for v in (low, high))
    return F.transform(linspace(low, high, n), F.exp)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def log_gamma(value: Column) -> Column:
    """Logarithm of the gamma function for positive values: a series about eight more, then back by the product."""
    z = value + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = F.lit(0.0)
    for k in range(8):
        product = product + F.log(value + k)
    return series - product


def poisson_column(k: Column, mean: Column) -> Column:
    """Poisson probability of k."""
    return F.exp(k * F.log(mean) - mean - log_gamma(k + 1.0))


def negative_binomial_column(k: Column, r: Column, p: Column) -> Column:
    """Probability of k by the negative binomial distribution whose mean is r * p / (1 - p)."""
    return F.exp(log_gamma(k + r) - log_gamma(k + 1.0) - log_gamma(r) + r * F.log(1 - p) + k * F.log(p))


def poisson_pmf(k: int, mean: float) -> float:
    return math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))


def negative_binomial_pmf(k: int, r: float, p: float) -> float:
    return math.exp(math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log(1 - p) + k * math.log(p))


def readable_bytes(value: Column) -> Column:
    """A number of bytes with one decimal and its unit."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.1f TB", value / 1024.0**4)
    for k in range(3, -1, -1):
        out = F.when(value < 1024.0 ** (k + 1), F.format_string(f"%.1f {units[k]}", value / 1024.0**k)).otherwise(out)
    return out


def date_label(moment: Column) -> Column:
    """A time as a name for files: 20240131_235959."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def estimated_seconds(points: Column, square: float, linear: float, constant: float = 0.0) -> Column:
    """A run-time model: a parabola in the number of points, not below zero."""
    return F.greatest(F.lit(0.0), points * points * square + points * linear + constant)


def padded_id(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


# What stands between numbers of a line, and a number.
NUMBER_GAP, NUMBER = r"[ \t\r\n,;]+", r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def numbers_in(text):
    """The numbers among a text's pieces, in order; empty for null."""
    pieces = F.split(F.coalesce(text, F.lit("")), NUMBER_GAP)
    return F.transform(F.filter(pieces, lambda p: p.rlike(f"^{NUMBER}$")), lambda p: p.cast("double"))


def data_lines(text):
    """Lines of a text that hold numbers and nothing else."""
    gap = NUMBER_GAP.replace(r"\n", "")
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"^({gap})?{NUMBER}({gap}{NUMBER})*({gap})?$"))
