"""Neighbourhoods of the most intense peaks in m/z and ion mobility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.band_join import band_join
from ionweave.operators.ranking import share_or_count


def seed_neighbours(peaks: DataFrame, top_n: int = 500, share: float = 0.1, ims_tol: float = 0.02, mz_tol: float = 0.02, unit: str = "da", spectrum: str = "spec_id") -> DataFrame:
    """(spec_id, left, right): every peak with itself, and each seed with its neighbours, in both directions.

    peaks: spec_id, peak_id, mz, mobility, intensity. Seeds are the max(top_n, share of the peaks) most intense of a
    spectrum (smaller peak_id first among equals). Neighbours are within both tolerances, bounds included."""
    seeds = share_or_count(peaks.select(spectrum, "peak_id", "mz", "mobility", "intensity"), [spectrum], [F.desc("intensity"), F.asc("peak_id")], top_n, share)
    a = seeds.select(F.col(spectrum).alias("_s"), F.col("peak_id").alias("left"), F.col("mz").alias("_a"), F.col("mobility").alias("_u"))
    b = peaks.select(spectrum, F.col("peak_id").alias("right"), F.col("mz").alias("_b"), F.col("mobility").alias("_w"))
    near = band_join(a, b, "_a", "_b", mz_tol, unit, F.abs(F.col("_w") - F.col("_u")) <= ims_tol, equal=[("_s", spectrum)]).select(spectrum, "left", "right")
    own = peaks.select(spectrum, F.col("peak_id").alias("left"), F.col("peak_id").alias("right"))
    return own.union(near).union(near.select(spectrum, F.col("right"), F.col("left"))).distinct()
