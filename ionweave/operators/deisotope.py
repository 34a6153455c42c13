"""Deisotoping of peak lists: each isotope peak's intensity moves to its monoisotopic peak."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.functions.mass import ppm_to_da
from ionweave.functions.peptide import NEUTRON
from ionweave.operators.band_join import band_join_multi


def absorb(mz: np.ndarray, intensity: np.ndarray, max_charge: int, tol: float, mobility: np.ndarray | None = None, ims_tol: float = 0.01):
    """(kept positions in m/z order, their intensity, members of each): the greedy pass over one spectrum.

    Charges go from max_charge + 1 down to 1, and within a charge peaks from heavy to light. A later peak at one
    neutron over the charge joins an earlier one if it has not joined any and half of it is below the earlier peak."""
    order = np.argsort(mz, kind="stable")
    m, raw = mz[order], intensity[order].astype(float)
    ims = None if mobility is None else mobility[order]
    now, member = raw.copy(), np.zeros(len(m), dtype=bool)
    held = [[i] for i in range(len(m))]
    for charge in range(max_charge + 1, 0, -1):
        step = NEUTRON / charge
        first, stop = np.searchsorted(m, m + step - tol, "left"), np.searchsorted(m, m + step + tol, "left")
        for i in np.flatnonzero(stop > first)[::-1].tolist():
            for j in range(first[i], stop[i]):
                if j == i or member[j] or not 0.5 * raw[j] < raw[i] or ims is not None and abs(ims[j] - ims[i]) > ims_tol:
                    continue
                now[i] += now[j]
                member[j] = True
                held[i] += held[j]
    kept = np.flatnonzero(~member)
    return order[kept], now[kept], [held[i] for i in kept]


def mz_tolerance(mz: np.ndarray, diff: float, unit: str) -> float:
    """Absolute tolerance; that of ppm is taken at the heaviest peak."""
    if unit.lower() == "da":
        return diff
    if unit.lower() == "ppm":
        return ppm_to_da(float(mz.max()), diff) if len(mz) else 0.0
    raise NotImplementedError("masses are in da or ppm")


def deisotope(spectra: DataFrame, max_charge: int, diff: float, unit: str, ims_tol: float | None = None, mz: str = "mz", intensity: str = "intensity", mobility: str = "mobility") -> DataFrame:
    """spectra with deisotoped arrays and `indices` (positions, in m/z order, of the peaks in each). With ims_tol, peaks
    join only within that mobility, whose array is deisotoped as well. Null or empty arrays stay empty."""
    if unit.lower() not in ("da", "ppm"):
        raise NotImplementedError("masses are in da or ppm")
    arrays = [mz, intensity] + ([mobility] if ims_tol is not None else [])
    schema = T.StructType([f if f.name not in arrays else T.StructField(f.name, T.ArrayType(T.DoubleType())) for f in spectra.schema] + [T.StructField("indices", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(frames):
        for pdf in frames:
            out = {c: [] for c in [*arrays, "indices"]}
            for values in zip(*(pdf[c] for c in arrays)):
                m, i, *extra = (np.array(v if v is not None else [], dtype=float) for v in values)
                keep, now, held = absorb(m, i, max_charge, mz_tolerance(m, diff, unit), extra[0] if extra else None, ims_tol or 0.0)
                for c, v in zip(arrays, [m[keep], now, *(e[keep] for e in extra)]):
                    out[c].append(v)
                out["indices"].append(held)
            yield pdf.assign(**out)

    return spectra.mapInPandas(run, schema)


def isotope_edges(peaks: DataFrame, max_charge: int, tol: float, spectrum: str = "spec_id") -> DataFrame:
    """(spec_id, left, right, charge): which peaks of a spectrum are one neutron over a charge apart; half open above."""
    a = peaks.select(F.col(spectrum).alias("_s"), F.col("peak_id").alias("left"), F.col("mz").alias("_a"))
    b = peaks.select(F.col(spectrum).alias(spectrum), F.col("peak_id").alias("right"), F.col("mz").alias("_b"))
    parts = [band_join_multi(a, b, [("_a", "_b", NEUTRON / z - tol, NEUTRON / z + tol)]).where(F.col("_s") == F.col(spectrum)).select(spectrum, "left", "right", F.lit(z).alias("charge")) for z in range(max_charge + 1, 0, -1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
