"""Data-dependent search: every spectrum against its precursor's candidates, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.operators.peptide_index import PeptideIndex
from ionweave.operators.scoring import hyperscore, precursor_bounds


def explode_peaks(spectra: DataFrame, config: SearchConfig) -> DataFrame:
    """Peaks of spectra (spec_id, prec_mz or prec_low and prec_high, peaks): peak_id counts from 0 in the spectrum."""
    if "prec_mz" in spectra.columns:
        low, high = precursor_bounds(F.col("prec_mz"), config.g_tolerances[0], config.g_tolerance_units[0])
        spectra = spectra.withColumn("prec_low", low).withColumn("prec_high", high)
    rows = spectra.select("spec_id", "prec_low", "prec_high", F.posexplode("peaks").alias("peak_id", "p"))
    return rows.select("spec_id", "peak_id", F.col("p.mz").alias("spec_mz"), F.col("p.intensity").alias("spec_int"), "prec_low", "prec_high")


def spectrum_search(spectra: DataFrame, index: PeptideIndex, config: SearchConfig, top_n: int = 10) -> DataFrame:
    """The top_n candidates of each spectrum with ScanID, by fragments of three residues or more; empty where nothing matches."""
    found = hyperscore(explode_peaks(spectra, config), index.from_position(), config.g_tolerances[1], config.g_tolerance_units[1], top_n)
    return found.withColumnRenamed("spec_id", "ScanID").withColumnRenamed("seq_id", "id")
