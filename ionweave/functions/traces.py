"""Chromatogram traces (array<double>) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionweave.functions.binding import let

EPS = 1e-5


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_similarity(x: Column, y: Column, x_max: Column | None = None, y_max: Column | None = None) -> Column:
    """Cosine of two traces, each first divided by its maximum plus 1e-5; 1e-5 is added to the product of the norms.

    x_max and y_max: the maxima to divide by, where they are those of a whole matrix of traces."""
    scaled = lambda z, top: let(F.array_max(z) if top is None else top, lambda t: F.transform(z, lambda v: v / (t + EPS)))
    return let(scaled(x, x_max), lambda a: let(scaled(y, y_max), lambda b: dot(a, b) / (norm(a) * norm(b) + EPS)))


def angle_of(cosine: Column) -> Column:
    """1 - 2 acos(c) / pi; 1 for parallel traces."""
    return 1 - 2 * F.acos(cosine) / F.lit(math.pi)


def spectral_angle(x: Column, y: Column, x_max: Column | None = None, y_max: Column | None = None) -> Column:
    return angle_of(cosine_similarity(x, y, x_max, y_max))


def rolling_max(x: Column, window: int) -> Column:
    """Maximum of each full window; n - window + 1 values, none if the trace is shorter."""

    def maxima(held):
        starts = F.sequence(F.lit(1), F.size(held) - window + 1)
        return F.transform(starts, lambda i: F.array_max(F.slice(held, i, window)))

    return let(x, lambda held: F.when(F.size(held) >= window, maxima(held)).otherwise(F.array().cast("array<double>")))


def smoothed_unit(x: Column) -> Column:
    """Rolling maximum of three, signed square root, divided by the norm of that plus 1e-5."""
    root = F.transform(rolling_max(x, 3), lambda v: F.sqrt(F.abs(v)) * F.signum(v))
    length = lambda r: norm(F.transform(r, lambda v: v + EPS))
    return let(root, lambda r: let(length(r), lambda n: F.transform(r, lambda v: v / n)))


def points_over_half(x: Column) -> Column:
    """How many points reach half of the height over the minimum."""
    return let(F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("top")), lambda e: F.size(F.filter(x, lambda v: v - e["low"] >= (e["top"] - e["low"]) / 2)))
