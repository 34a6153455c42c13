"""Peak lists as column expressions: filters inside the arrays, without exploding and regrouping rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionweave.functions.binding import let


def zipped(mz: Column, intensity: Column, mobility: Column | None = None) -> Column:
    """array<struct<mz,intensity[,mobility]>>; arrays of unequal length raise an error."""
    parts = [mz.alias("mz"), intensity.alias("intensity")] + ([] if mobility is None else [mobility.alias("mobility")])
    equal = F.size(mz) == F.size(intensity)
    if mobility is not None:
        equal = equal & (F.size(mz) == F.size(mobility))
    return F.when(equal, F.arrays_zip(*parts)).otherwise(F.raise_error(F.lit("peak arrays have different lengths")))


def keep_between(peaks: Column, low, high) -> Column:
    return F.filter(peaks, lambda p: p["mz"].between(low, high))


def keep_outside(peaks: Column, low, high) -> Column:
    return F.filter(peaks, lambda p: (p["mz"] < low) | (p["mz"] > high))


def keep_ratio(peaks: Column, ratio: float) -> Column:
    """Peaks of at least `ratio` times the highest."""
    top = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    return let(top * ratio, lambda least: F.filter(peaks, lambda p: p["intensity"] >= least))


def keep_floor(peaks: Column, floor: float) -> Column:
    return F.filter(peaks, lambda p: p["intensity"] >= floor)


def keep_mobility(peaks: Column, centre, tol: float) -> Column:
    return F.filter(peaks, lambda p: F.abs(p["mobility"] - centre) <= tol)


def sort_by_mz(peaks: Column) -> Column:
    """All parallel arrays in the order of m/z."""
    return F.array_sort(peaks)


def top_peaks(peaks: Column, n: int) -> Column:
    """The n most intense peaks, most intense first, smaller m/z first among equals."""
    order = F.array_sort(peaks, lambda a, b: F.when(a["intensity"] > b["intensity"], -1).when(a["intensity"] < b["intensity"], 1).when(a["mz"] < b["mz"], -1).when(a["mz"] > b["mz"], 1).otherwise(0))
    return F.slice(order, 1, n)


def base_peak(peaks: Column) -> Column:
    """struct<intensity,mz> of the highest peak, the first of equals; null without peaks."""
    held = F.transform(peaks, lambda p, i: F.struct(p["intensity"].alias("intensity"), (-i).alias("_order"), p["mz"].alias("mz")))
    return let(F.array_max(held), lambda best: F.when(best.isNotNull(), F.struct(best["intensity"].alias("intensity"), best["mz"].alias("mz"))))


def is_sorted(values: Column) -> Column:
    pairs = lambda v: F.forall(F.sequence(F.lit(2), F.greatest(F.size(v), F.lit(2))), lambda i: F.coalesce(F.get(v, i - 2) <= F.get(v, i - 1), F.lit(True)))
    return let(values, pairs)


def slice_between(values: Column, low, high, slack: bool = False) -> Column:
    """Values of a sorted array in [low, high]; with slack, the last one below low as well."""
    inside = F.filter(values, lambda v: v.between(low, high))
    below = F.filter(values, lambda v: v < low)
    return let(below, lambda b: F.concat(F.slice(b, F.greatest(F.size(b), F.lit(1)), 1), inside)) if slack else inside


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def valid_spectrum(mz: Column, intensity: Column, mobility: Column | None = None) -> Column:
    """Arrays of one length, m/z ascending."""
    ok = (F.size(mz) == F.size(intensity)) & is_sorted(mz)
    return ok if mobility is None else ok & (F.size(mz) == F.size(mobility))


def file_stem(path: Column) -> Column:
    """Last part of a path without its suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def summary(values: str) -> list[Column]:
    """Smallest, largest and number of a column's values."""
    return [F.min(values).alias("low"), F.max(values).alias("high"), F.count(values).alias("n")]
