"""Mass tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ppm_to_da(mz, ppm):
    """Width in Da of `ppm` parts per million of mz; columns or numbers."""
    return ppm * mz / 1e6


def tolerance(mz: Column, tol: float, unit: str) -> Column:
    """Half width of the match window around mz."""
    if unit == "da":
        return F.lit(float(tol))
    if unit == "ppm":
        return ppm_to_da(mz, F.lit(float(tol)))
    raise ValueError(f"unit is da or ppm, not {unit}")
