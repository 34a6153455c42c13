"""Tolerance joins as equi-joins over bins.

Catalyst plans an inequality join as a nested loop. Here one side is put into bins and the other is expanded to the
few bins its window touches; a row pair meets in exactly one bin, the exact predicate follows, and the join shuffles
on the bin. Widths follow the tolerance (for ppm on the logarithm of the value), so each probe meets two or three."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.functions.mass import tolerance
from ionweave.operators.numbering import order_bucket


def _bins(tol: float, unit: str) -> tuple[Callable[[Column], Column], float]:
    if unit == "da":
        width = 2.0 * tol or 1.0
        return lambda v: F.floor(v / width), width
    width = 2 * math.log1p(tol / 1e6) or 1.0
    return lambda v: F.floor(F.ln(v) / width), width


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tol: float, unit: str = "da", condition: Column | None = None, equal: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with abs(right - left) <= tol, the tolerance taken at the left value; nulls match nothing.

    The two sides have different column names (rename them for a self join). equal: pairs of (left, right) columns that must be equal as well. Values must be positive for ppm."""
    bin_of, _ = _bins(tol, unit)
    half = tolerance(F.col(left_on), tol, unit)
    safe = half * (1 + 1e-9) + F.abs(F.col(left_on)) * 1e-12  # rounding must not move a match out of its bins
    low = F.col(left_on) - safe
    usable = F.col(left_on).isNotNull() & ((low > 0) if unit == "ppm" else F.lit(True))
    probe = left.where(usable).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(F.col(left_on) + safe))))
    build = right.where((F.col(right_on) > 0) if unit == "ppm" else F.col(right_on).isNotNull()).withColumn("_rbin", bin_of(F.col(right_on)))
    on = [F.col("_bin") == F.col("_rbin"), *(F.col(a) == F.col(b) for a, b in equal)]
    matched = F.abs(F.col(right_on) - F.col(left_on)) <= half
    joined = probe.join(build, on=[*on, matched])
    return (joined if condition is None else joined.where(condition)).drop("_bin", "_rbin")


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, closed: bool = True) -> DataFrame:
    """Pairs with low <= value <= high (value < high unless closed). left has the ranges, right the values; width: of a bin."""
    probe = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    build = right.withColumn("_rbin", F.floor(F.col(value) / width))
    upper = (F.col(value) <= F.col(high)) if closed else (F.col(value) < F.col(high))
    return probe.join(build, on=[F.col("_bin") == F.col("_rbin"), F.col(value) >= F.col(low), upper]).drop("_bin", "_rbin")


def band_join_multi(left: DataFrame, right: DataFrame, dims: list[tuple[str, str, float, float]], units: list[str] | None = None) -> DataFrame:
    """Pairs near in several dimensions. dims: (left column, right column, low, high) of right - left; the first
    dimension is half open [low, high), the others closed. units: `da` for absolute differences (default) or `ppm` of
    the left value, per dimension."""
    units = units or ["da"] * len(dims)
    a, b, low, high = dims[0]
    scale = lambda col, unit: F.lit(1.0) if unit == "da" else F.abs(col) / 1e6
    own = scale(F.col(a), units[0])
    spread = max(high - low, 1e-9)
    width = spread if units[0] == "da" else math.log1p(spread / 1e6)
    place = (lambda v: F.floor(v / width)) if units[0] == "da" else (lambda v: F.floor(F.ln(v) / width))
    slack = F.abs(F.col(a)) * 1e-12 + 1e-12
    ready = left.where(F.col(a) > 0) if units[0] == "ppm" else left.where(F.col(a).isNotNull())
    probe = ready.withColumn("_bin", F.explode(F.sequence(place(F.col(a) + low * own - slack), place(F.col(a) + high * own + slack))))
    build = (right.where(F.col(b) > 0) if units[0] == "ppm" else right.where(F.col(b).isNotNull())).withColumn("_rbin", place(F.col(b)))
    gap = lambda i: F.col(dims[i][1]) - F.col(dims[i][0])
    edge = lambda i, e: F.lit(float(e)) * scale(F.col(dims[i][0]), units[i])
    on = [F.col("_bin") == F.col("_rbin"), gap(0) >= edge(0, low), gap(0) < edge(0, high)]
    on += [gap(i).between(edge(i, dims[i][2]), edge(i, dims[i][3])) for i in range(1, len(dims))]
    return probe.join(build, on=on).drop("_bin", "_rbin")


def extracted_chromatogram(peaks: DataFrame, centres: DataFrame, tol: float, unit: str = "da", group: str = "window", scan: str = "scan", mz: str = "mz", intensity: str = "intensity", index: str = "peak_index", centre: str = "centre_mz", centre_id: str = "centre_id") -> DataFrame:
    """(group, scan, centre_id, intensity, indices): for each scan and centre of a group, the summed intensity of the
    scan's peaks within the tolerance of the centre and their indices; zero and none where there are no such peaks.

    Scans and centres have the group column in common; only within a group do they meet."""
    own = centres.select(F.col(group).alias("_g"), centre_id, centre)
    hits = band_join(own, peaks.select(group, scan, mz, intensity, index), centre, mz, tol, unit, equal=[("_g", group)])
    sums = hits.groupBy(group, scan, centre_id).agg(F.sum(intensity).alias("_sum"), F.sort_array(F.collect_list(index)).alias("_at"))
    grid = peaks.select(group, scan).distinct().join(centres.select(group, centre_id), group)
    out = grid.join(sums, [group, scan, centre_id], "left")
    return out.select(group, scan, centre_id, F.coalesce("_sum", F.lit(0.0)).alias("intensity"), F.coalesce("_at", F.array().cast("array<long>")).alias("indices"))


def nearest_after(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keep: list[str], equal: str | None = None) -> DataFrame:
    """left with the `keep` columns of the first right row at or after its value (of the same `equal` key); null if none.

    One sort of the union and a running look ahead; no pair is formed. Equal values of right: its smallest `keep` first.
    Without a key, numbers are cut into buckets of values, each looked through by its own task; a row that finds nothing
    in its bucket takes the first of the next bucket that has one."""
    keys = [equal] if equal else []
    a = left.select(F.col(left_on).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(0).alias("_side"), *(F.col(k).alias("_k") for k in keys))
    b = right.select(F.col(right_on).alias("_at"), F.struct(*keep).alias("_r"), F.lit(1).alias("_side"), *(F.col(k).alias("_k") for k in keys))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both if equal else both.withColumn("_k", order_bucket(both, "_at"))
    ahead = Window.partitionBy("_k").orderBy(F.desc("_at"), F.desc("_side"), F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)  # backwards: a frame to the end is summed anew for every row
    found = both.withColumn("_next", F.last("_r", ignorenulls=True).over(ahead)).where("_side = 0")
    if not equal:
        firsts = both.groupBy("_k").agg(F.min(F.when(F.col("_side") == 1, F.struct("_at", "_r"))).alias("_first"))  # one row per bucket
        later = Window.orderBy(F.desc("_k")).rowsBetween(1, Window.unboundedFollowing)
        beyond = firsts.select("_k", F.first("_first", ignorenulls=True).over(later)["_r"].alias("_beyond"))
        found = found.join(F.broadcast(beyond), "_k").withColumn("_next", F.when(F.col("_at").isNotNull(), F.coalesce("_next", "_beyond")))
    return found.select("_l.*", *(F.col(f"_next.{k}").alias(k) for k in keep))
