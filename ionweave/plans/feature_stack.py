"""The feature around each window's apex, set-at-a-time: frame, extracted chromatograms, correlations, filter.

One step of the greedy search for all windows at once, without changing any spectrum; no kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.config import SearchConfig
from ionweave.functions import peaks as pk
from ionweave.functions import traces as tr
from ionweave.operators.band_join import extracted_chromatogram
from ionweave.operators.ranking import at_least_kth, centred_frame


def apex_scans(groups: DataFrame) -> DataFrame:
    """(window, apex, n_scans): the scan with the highest peak of each window, the first of equals."""
    order = F.struct(F.col("base_peak.intensity"), -F.col("scan"))
    return groups.groupBy("window").agg(F.max_by("scan", order).alias("apex"), F.count(F.lit(1)).alias("n_scans"))


def stack_features(groups: DataFrame, config: SearchConfig) -> DataFrame:
    """(window, apex, centre_id, centre_mz, trace, is_ref, correlation) of the peaks that co-elute with the apex.

    groups: rows of scan_groups. Windows with fewer than three scans in the frame have no correlations and no rows."""
    apex = apex_scans(groups)
    first, stop = centred_frame(F.col("apex"), F.col("n_scans"), config.run_window_size)
    framed = groups.join(apex.withColumn("first", first).withColumn("stop", stop), "window").where("scan >= first and scan < stop")
    strong = framed.where("scan = apex").select("window", F.posexplode(pk.keep_ratio(F.col("peaks"), config.run_min_intensity_ratio)).alias("centre_id", "p"))
    centres = strong.select("window", "centre_id", F.col("p.mz").alias("centre_mz"))
    rows = framed.select("window", "scan", F.posexplode("peaks").alias("peak_index", "p")).select("window", "scan", F.col("peak_index").cast("long").alias("peak_index"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    points = extracted_chromatogram(rows, centres, config.g_tolerances[1], config.g_tolerance_units[1])
    ordered = F.array_sort(F.collect_list(F.struct("scan", "intensity")))  # at most the frame's scans
    traces = points.groupBy("window", "centre_id").agg(F.transform(ordered, lambda s: s["intensity"]).alias("trace"), ordered.alias("_points"))
    traces = traces.join(apex.select("window", "apex"), "window").join(centres, ["window", "centre_id"])
    height = F.element_at(F.filter("_points", lambda s: s["scan"] == F.col("apex")), 1)["intensity"]
    unit = traces.withColumn("_height", height).withColumn("_unit", tr.smoothed_unit(F.col("trace"))).where(F.size("_unit") > 0)
    ref = unit.groupBy("window").agg(F.max_by(F.struct("centre_id", "_unit"), F.struct("_height", -F.col("centre_id"))).alias("_ref"), F.max(F.array_max("_unit")).alias("_top"))
    scored = unit.join(ref, "window").withColumn("correlation", tr.spectral_angle(F.col("_unit"), F.col("_ref._unit"), x_max=F.col("_top")))
    kept = at_least_kth(scored, ["window"], "correlation", config.run_max_peaks_per_window, config.run_min_correlation_score)
    return kept.select("window", "apex", "centre_id", "centre_mz", "trace", (F.col("centre_id") == F.col("_ref.centre_id")).alias("is_ref"), "correlation")
