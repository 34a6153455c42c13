"""More of the engine's operators over the driver's tables, each with the SQL that says the same: sources and written
tables, peak lists, scan groups, search by spectrum, runs together, neighbour graphs."""

from __future__ import annotations

import base64
import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.functions import peaks as pk
from ionweave.operators import band_join as bj
from ionweave.operators import confidence as conf
from ionweave.operators import deisotope as iso
from ionweave.operators import graph, impute, ranking
from ionweave.operators.peptide_index import PeptideIndex, cached_index
from ionweave.operators.scoring import best_candidates
from ionweave.plans.aggregate_runs import run_cells, union_runs
from ionweave.plans.feature_stack import apex_scans
from ionweave.plans.spectrum_search import spectrum_search
from ionweave.queries import _FRAGS, _INDEX, _LABELLED, _PROT, HYPERSCORE_SQL, PSEUDO, _labelled, _proteins, _vectors, pseudo_peaks, query
from ionweave.schema import TableInterface
from ionweave.sources import spectra as sp
from ionweave.sources.fasta import read_fasta
from ionweave.sources.mzml import dda_spectra, read_mzml
from ionweave.sources.sinks import write_search
from ionweave.sources.tables import new_folder, table

# ---- an index on disk, FASTA files ----------------------------------------------------------------------------------


def _written_index(spark, sf) -> str:
    path = new_folder(spark, "index")
    PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO).write(path)
    return path


@query("WITH " + _FRAGS + " SELECT ion AS ion_series, count(DISTINCT seq_id) AS sequences, count(*) AS fragments, round(sum(mz), 3) AS total FROM frags WHERE seq_mz >= 512.5 AND seq_mz < 580 GROUP BY ion")
def index_read_range(spark, sf):
    """Writes the index, then reads the files of a half-open precursor range only."""
    part = PeptideIndex.read_range(spark, _written_index(spark, sf), 512.5, 580.0, PSEUDO)
    own = part.frags.groupBy("seq_id", "ion_series").agg(F.count(F.lit(1)).alias("n"), F.sum("mz").alias("mz"))  # mostly within the task that made them
    return own.groupBy("ion_series").agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("fragments"), F.round(F.sum("mz"), 3).alias("total"))


@query("WITH " + _FRAGS + " SELECT ion AS ion_series, count(*) AS fragments, round(sum(mz), 3) AS total FROM frags WHERE mz > 300 AND mz < 900 GROUP BY ion")
def index_read_ions(spark, sf):
    """Reads a written index within the (open) ion range of the configuration."""
    config = dataclasses.replace(PSEUDO, ion_mz_range=(300.0, 900.0))
    index = PeptideIndex.read(spark, _written_index(spark, sf), config)
    return index.frags.groupBy("ion_series").agg(F.count(F.lit(1)).alias("fragments"), F.round(F.sum("mz"), 3).alias("total"))


@query("WITH " + _FRAGS + " SELECT floor(seq_mz / 50)::BIGINT AS bin, count(*) AS fragments FROM frags WHERE seq_mz BETWEEN 450 AND 700 AND mz BETWEEN 200 AND 400 GROUP BY 1")
def index_prefilter(spark, sf):
    """Closed precursor range, then closed fragment range."""
    part = PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO).between(450.0, 700.0)
    return part.fragments_between(200.0, 400.0).groupBy(F.floor(F.col("precursor_mz") / 50).alias("bin")).agg(F.count(F.lit(1)).alias("fragments"))


def _fasta(spark, sf) -> str:
    """The stand-in proteins as FASTA files."""
    path = new_folder(spark, "proteins") + ".fasta"
    proteins = _proteins(spark, sf).where("sequence <> ''")
    proteins.select(F.concat(F.lit(">sp|D"), "accession", F.lit("|DOC Stand-in a->b OS=X\n"), "sequence")).write.text(path)  # a file a task, as large sets of proteins come
    return path


@query("WITH " + _PROT + " SELECT 'D' || doc_id AS accession, length(s) AS residues, md5(s) AS digest FROM prot WHERE s <> ''")
def fasta_scan(spark, sf):
    rows = read_fasta(spark, _fasta(spark, sf))
    return rows.select("accession", F.length("sequence").cast("long").alias("residues"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query("WITH " + _INDEX + " SELECT decoy, count(*) AS sequences, round(sum(seq_mz), 3) AS total FROM seqs GROUP BY decoy")
def index_cached(spark, sf):
    """An index from a FASTA file, built on the first call and found by the file's md5 on the second."""
    fasta, root = _fasta(spark, sf), new_folder(spark, "cache")
    cached_index(spark, fasta, PSEUDO, root)
    index = cached_index(spark, fasta, PSEUDO, root)
    return index.seqs.groupBy("decoy").agg(F.count(F.lit(1)).alias("sequences"), F.round(F.sum("seq_mz"), 3).alias("total"))


@query("WITH " + _FRAGS + ", w AS (SELECT DISTINCT l_suppkey % 40 AS w FROM lineitem) SELECT w::BIGINT AS \"window\", count(*) AS fragments, round(min(mz), 6) AS low, round(max(mz), 6) AS high FROM w JOIN frags ON seq_mz >= 400 + 13 * w AND seq_mz < 416.5 + 13 * w GROUP BY w")
def window_fragments(spark, sf):
    """Overlapping isolation windows against the fragment table by precursor range."""
    w = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).cast("long").alias("window")).distinct()
    ranges = w.select("window", (400.0 + 13 * F.col("window")).alias("low_mz"), (416.5 + 13 * F.col("window")).alias("high_mz"))
    met = PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO).in_ranges(ranges, "low_mz", "high_mz")
    return met.groupBy("window").agg(F.count(F.lit(1)).alias("fragments"), F.round(F.min("mz"), 6).alias("low"), F.round(F.max("mz"), 6).alias("high"))


# ---- peak lists -----------------------------------------------------------------------------------------------------

_X = "(SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


@query(f"SELECT vec_id, len(k) AS n, round(coalesce(list_sum(k), 0), 6) AS total FROM (SELECT vec_id, list_filter(x, lambda v: v >= 0.05::DOUBLE) AS k FROM {_X})")
def peak_floor(spark, sf):
    held = pk.keep_floor(F.transform("x", lambda v: F.struct(v.alias("mz"), v.alias("intensity"))), 0.05)
    return _vectors(spark, sf).select("vec_id", F.size(held).cast("long").alias("n"), F.round(F.aggregate(held, F.lit(0.0), lambda a, p: a + p["mz"]), 6).alias("total"))


@query(f"SELECT vec_id, len(list_filter(range(1, 33), lambda i: abs(x[32 + i] - x[1]) <= 0.08::DOUBLE)) AS n FROM {_X}")
def peak_mobility(spark, sf):
    peaks = pk.zipped(F.slice("x", 1, 32), F.slice("x", 1, 32), F.slice("x", 33, 32))
    return _vectors(spark, sf).select("vec_id", F.size(pk.keep_mobility(peaks, F.get("x", 0), 0.08)).cast("long").alias("n"))


@query(f"SELECT vec_id, array_to_string(list_transform(k, lambda v: floor(v * 1000)::BIGINT), ',') AS inside, len(k) + least(1, len(list_filter(x, lambda v: v < -0.02::DOUBLE))) AS with_slack FROM (SELECT vec_id, x, list_filter(list_sort(x), lambda v: v >= -0.02::DOUBLE AND v <= 0.07::DOUBLE) AS k FROM {_X})")
def sorted_slice(spark, sf):
    ordered = F.array_sort("x")
    held = pk.slice_between(ordered, -0.02, 0.07)
    slack = F.size(pk.slice_between(ordered, -0.02, 0.07, slack=True)).cast("long")
    return _vectors(spark, sf).select("vec_id", F.array_join(F.transform(held, lambda v: F.floor(v * 1000).cast("string")), ",").alias("inside"), slack.alias("with_slack"))


@query(f"SELECT vec_id, len(list_filter(range(1, 8), lambda i: x[i] > x[i + 1])) = 0 AS ascending FROM {_X}")
def spectrum_valid(spark, sf):
    mz = F.slice("x", 1, 8)
    return _vectors(spark, sf).select("vec_id", pk.valid_spectrum(mz, F.transform(mz, lambda v: v + 1)).alias("ascending"))


@query("SELECT event_type, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY event_type")
def column_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*pk.summary("value"))


@query("SELECT p_partkey, p_brand AS stem FROM part")
def path_stem(spark, sf):
    path = F.concat(F.lit("/data/run.d/"), "p_brand", F.lit(".parquet/"))
    return table(spark, sf, "part").select("p_partkey", pk.file_stem(path).alias("stem"))


@query("SELECT event_id, user_id, value FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value < p")
def order_violations(spark, sf):
    return ranking.sorted_violations(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")


@query("SELECT event_id, user_id, value FROM (SELECT event_id, user_id, value, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) WHERE r <= 8 AND value >= 40")
def at_least_kth(spark, sf):
    return ranking.at_least_kth(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "value", 8, 40.0)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def interface_columns(spark, sf):
    """A table held to required columns; any width of a type will do."""

    class Orders(TableInterface):
        required_columns = [("o_orderkey", T.IntegerType()), ("o_totalprice", T.FloatType())]

    return Orders.from_parquet(spark, f"{sf}/orders.parquet").data.select("o_orderkey", "o_custkey", "o_totalprice")


# ---- spectra and scan groups ----------------------------------------------------------------------------------------


def _raw(spark, sf):
    """lineitem as flattened spectra: 20 windows of 30 Th with 12 scans each, and the MS1 scans of every window's times."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("w"), (F.col("l_orderkey") % 12).cast("double").alias("rt"), (F.col("l_extendedprice") / 50).alias("mz"), (F.col("l_quantity") * 100).alias("i"))
    low = (F.lit(400) + 30 * F.col("w")).cast("double")
    listed = F.array_sort(F.collect_list(F.struct("mz", "i"))).alias("p")
    ms2 = rows.groupBy("w", "rt").agg(listed).select("rt", low.alias("low"), (low + 30).alias("high"), "p")
    ms1 = rows.groupBy("rt").agg(listed).select("rt", F.lit(-1.0).alias("low"), F.lit(-1.0).alias("high"), "p")
    both = ms2.union(ms1)
    return both.select(F.col("rt").alias("rt_values"), F.col("low").alias("quad_low_mz_values"), F.col("high").alias("quad_high_mz_values"), F.col("p.mz").alias("mz_values"), F.col("p.i").alias("corrected_intensity_values"), F.lit(None).cast("array<double>").alias("mobility_values"))


_PEAKS = "k AS (SELECT l_suppkey % 20 AS w, (l_orderkey % 12)::DOUBLE AS rt, l_extendedprice / 50 AS mz, l_quantity * 100 AS i FROM lineitem)"
_OUT = _PEAKS + ", o AS (SELECT * FROM k WHERE mz < 400 + 30 * w OR mz > 430 + 30 * w)"
_NAME = "printf('%.4f', (400 + 30 * w)::DOUBLE) || '_' || printf('%.4f', (430 + 30 * w)::DOUBLE)"


@query(f"WITH {_PEAKS} SELECT DISTINCT (400 + 30 * w)::DOUBLE AS quad_low_mz_values, (430 + 30 * w)::DOUBLE AS quad_high_mz_values FROM k WHERE w BETWEEN 3 AND 8")
def window_subset(spark, sf):
    return sp.isolation_windows(_raw(spark, sf), (3, 9))


@query(f"WITH {_OUT} SELECT {_NAME} AS \"window\", rt, (row_number() OVER (PARTITION BY w ORDER BY rt) - 1)::INT AS scan, count(*) AS n_peaks, round(sum(i), 3) AS total, max(i) AS base_intensity FROM o GROUP BY w, rt")
def scan_groups(spark, sf):
    """Flattened spectra are written, read by their suffix, and grouped by window; the groups go to disk and come back."""
    path = new_folder(spark, "flat") + ".parquet"
    sp.write_flat(_raw(spark, sf), path, 1)
    groups = new_folder(spark, "groups")
    sp.write_groups(sp.scan_groups(sp.read_raw_data(spark, path)), groups)
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    return sp.read_groups(spark, groups).select("window", "rt", "scan", F.size("peaks").cast("long").alias("n_peaks"), F.round(total, 3).alias("total"), F.col("base_peak.intensity").alias("base_intensity"))


@query(f"WITH {_OUT}, s AS (SELECT w, rt, max(i) AS top, row_number() OVER (PARTITION BY w ORDER BY rt) - 1 AS scan FROM o GROUP BY w, rt) SELECT {_NAME} AS \"window\", arg_max(scan, (top, -scan))::INT AS apex, count(*) AS n_scans FROM s GROUP BY w")
def apex_scan(spark, sf):
    return apex_scans(sp.scan_groups(_raw(spark, sf)))


@query(f"WITH {_PEAKS}, w AS (SELECT DISTINCT w FROM k) SELECT {_NAME.replace('w)', 'w.w)')} AS \"window\", rt, count(*) AS n_peaks, max(i) AS base_intensity FROM w JOIN k ON mz >= 400 + 30 * w.w AND mz <= 430 + 30 * w.w GROUP BY w.w, rt")
def precursor_scans(spark, sf):
    """MS1 spectra restricted to each window."""
    raw = _raw(spark, sf)
    rows = sp.precursor_groups(raw, sp.isolation_windows(raw))
    return rows.select("window", "rt", F.size("peaks").cast("long").alias("n_peaks"), F.col("base_peak.intensity").alias("base_intensity"))


@query(f"""
WITH {_PEAKS}, w AS (SELECT DISTINCT w FROM k), m AS (SELECT w.w AS w, rt, mz, i FROM w JOIN k ON mz >= 400 + 30 * w.w AND mz <= 430 + 30 * w.w),
 s AS (SELECT w, rt, row_number() OVER (PARTITION BY w ORDER BY rt) AS scan FROM (SELECT DISTINCT w, rt FROM m)),
 q AS (SELECT c_custkey AS psm_id, c_custkey % 20 AS w, (c_custkey % 13)::DOUBLE AS rt, 400 + 30 * (c_custkey % 20) + (c_custkey % 29) + 0.5::DOUBLE AS mz FROM customer WHERE c_custkey % 20 IN (SELECT w FROM s)),
 a AS (SELECT q.*, coalesce((SELECT min(scan) FROM s WHERE s.w = q.w AND s.rt >= q.rt), (SELECT max(scan) FROM s WHERE s.w = q.w)) AS at FROM q)
SELECT psm_id, round(coalesce(sum(i), 0), 3) AS evidence FROM a LEFT JOIN (SELECT m.*, scan FROM m JOIN s USING (w, rt)) p ON p.w = a.w AND abs(p.scan - a.at) <= 2 AND abs(p.mz - a.mz) <= 0.75::DOUBLE GROUP BY psm_id""")
def ms1_evidence(spark, sf):
    raw = _raw(spark, sf)
    windows = sp.isolation_windows(raw)
    ms1 = sp.precursor_groups(raw, windows)
    w = F.col("c_custkey") % 20
    low = (F.lit(400) + 30 * w).cast("double")
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("psm_id"), low.alias("quad_low_mz_values"), (low + 30).alias("quad_high_mz_values"), (F.col("c_custkey") % 13).cast("double").alias("rt"), (low + F.col("c_custkey") % 29 + 0.5).alias("mz"))
    psms = asked.select("psm_id", sp.window_name().alias("window"), "rt", "mz").join(ms1.select("window").distinct(), "window", "left_semi")
    return sp.precursor_evidence(psms, ms1, 0.75, "da", 2).select("psm_id", F.round("evidence", 3).alias("evidence"))


@query("SELECT l_suppkey AS spec_id, count(*) AS n, round(sum(i), 3) AS total FROM (SELECT l_suppkey, l_quantity AS i, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice / 50) AS r, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) WHERE r <= 150 AND c >= 15 GROUP BY 1")
def dda_top_peaks(spark, sf):
    """Spectra by supplier, their 150 most intense peaks; spectra of fewer than 15 peaks go."""
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.struct((F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("i"))).alias("p"))
    spectra = rows.select(F.lit(2).alias("ms_level"), F.col("l_suppkey").alias("spectrum_index"), F.col("p.mz").alias("mz_values"), F.col("p.i").alias("corrected_intensity_values"), F.lit(400.0).alias("quad_low_mz_values"), F.lit(410.0).alias("quad_high_mz_values"))
    out = dda_spectra(spectra)
    return out.select("spec_id", F.size("peaks").cast("long").alias("n"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"]), 3).alias("total"))


def _mzml(spark, sf) -> str:
    """Supplier spectra as mzML files, one a task."""
    head = '<?xml version="1.0" encoding="utf-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><run id="run"><spectrumList>'
    term = lambda accession, value="", unit="": f'<cvParam accession="{accession}" value="{value}" {unit}/>'

    @F.pandas_udf("string")
    def element(index: pd.Series, mz: pd.Series, intensity: pd.Series) -> pd.Series:
        coded = lambda x: base64.b64encode(np.asarray(x, dtype="<f8").tobytes()).decode()
        array = lambda kind, x: f"<binaryDataArray>{term('MS:1000523')}{term(kind)}<binary>{coded(x)}</binary></binaryDataArray>"
        scan = term("MS:1000511", 2) + "<scanList><scan>" + term("MS:1000016", 0.5, 'unitName="minute"') + "</scan></scanList>"
        return pd.Series([f'<spectrum index="{i}" id="scan={i}">{scan}<binaryDataArrayList>{array("MS:1000514", m)}{array("MS:1000515", v)}</binaryDataArrayList></spectrum>' for i, m, v in zip(index, mz, intensity)])

    peaks = F.array_sort(F.collect_list(F.struct((F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("i"))))
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(peaks.alias("p")).select(element("l_suppkey", "p.mz", "p.i").alias("value"))

    def documents(batches):
        first = True
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": [head] * first + batch.column(0).to_pylist()})
            first = False
        if not first:
            yield pa.RecordBatch.from_pydict({"value": ["</spectrumList></run></mzML>"]})

    path = new_folder(spark, "run") + ".mzML"
    rows.mapInArrow(documents, "value string").write.text(path)
    return path


@query("SELECT l_suppkey::INT AS spectrum_index, 2 AS ms_level, 30.0::DOUBLE AS rt, count(*) AS n, round(sum(l_extendedprice / 50), 3) AS mz, round(sum(l_quantity), 3) AS intensity FROM lineitem WHERE l_suppkey % 3 <> 1 GROUP BY l_suppkey HAVING count(*) >= 15")
def mzml_scan(spark, sf):
    """Spectra of an mzML file through a hook that keeps some of them."""
    rows = read_mzml(spark, _mzml(spark, sf), hook=lambda spectra: spectra.where("spectrum_index % 3 <> 1"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 3)
    return rows.select("spectrum_index", "ms_level", F.col("rt_values").alias("rt"), F.size("mz_values").cast("long").alias("n"), total("mz_values").alias("mz"), total("corrected_intensity_values").alias("intensity"))


@query("SELECT DISTINCT upper(translate(p_brand, '#', '_')) AS stem FROM (SELECT replace(p_brand, '#', '_') AS p_brand FROM part)")
def window_stem(spark, sf):
    return table(spark, sf, "part").select(F.upper(sp.cache_stem(F.col("p_brand"))).alias("stem")).distinct()


@query("""
WITH a AS (SELECT event_id, value FROM events WHERE event_type = 'click'), b AS (SELECT value, min(event_id) AS nearest FROM events WHERE event_type = 'error' GROUP BY value)
SELECT a.event_id AS event_id, b.nearest AS nearest FROM a ASOF LEFT JOIN b ON a.value <= b.value""")
def next_value(spark, sf):
    """The next larger value of another kind, over the whole table."""
    events = table(spark, sf, "events")
    errors = events.where("event_type = 'error'").select("value", F.col("event_id").alias("nearest"))
    return bj.nearest_after(events.where("event_type = 'click'").select("event_id", "value"), errors, "value", "value", ["nearest"]).select("event_id", "nearest")


# ---- search by spectrum ---------------------------------------------------------------------------------------------


@query(HYPERSCORE_SQL.replace("SELECT spec AS spec_id,", "SELECT spec AS \"ScanID\",").replace("AS fw FROM frags)", "AS fw FROM frags WHERE i >= 3)"))
def dda_search(spark, sf):
    """Supplier spectra with one precursor each, written and read as result files on the way."""
    config = dataclasses.replace(PSEUDO, g_tolerances=(5.0, 0.2), g_tolerance_units=("da", "da"))
    own = pseudo_peaks(spark, sf).groupBy("spec_id").agg(F.first("prec_low").alias("low"), F.array_sort(F.collect_list(F.struct(F.col("spec_mz").alias("mz"), F.col("spec_int").alias("intensity")))).alias("peaks"))
    index = PeptideIndex.from_proteins(_proteins(spark, sf), config)
    found = spectrum_search(own.select("spec_id", (F.col("low") + 5).alias("prec_mz"), "peaks"), index, config)
    parquet, _ = write_search(found, new_folder(spark, "run"), "dda")
    top = spark.read.parquet(parquet)
    return top.select("ScanID", "peptide", "decoy", "b_npeaks", "y_npeaks", F.round("Score", 6).alias("Score"), F.round("ScoreZ", 6).alias("ScoreZ"), F.col("rank").cast("long").alias("rank"), F.round("PrecursorMZ", 6).alias("PrecursorMZ"))


@query(HYPERSCORE_SQL[: HYPERSCORE_SQL.index(" cand AS")].replace("SELECT spec, seq_id, ion, inten FROM binned", "SELECT spec, seq_id, abs(f.mz - p.mz) AS error FROM binned").rstrip().rstrip(",") + """
SELECT spec AS spec_id, seq_id, round(avg(error), 9) AS avg_abs_dm, round(median(error), 9) AS med_abs_dm FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY n DESC, seq_id) AS r FROM (SELECT spec, seq_id, count(*) AS n FROM hits GROUP BY 1, 2 HAVING count(*) > 3)) JOIN hits USING (spec, seq_id) WHERE r <= 200 GROUP BY 1, 2""")
def mass_errors(spark, sf):
    """Mean and median distance of the fragments that each candidate matched."""
    index = PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO)
    scored = best_candidates(pseudo_peaks(spark, sf), index, 0.2, "da")
    return scored.select("spec_id", "seq_id", F.round("avg_abs_dm", 9).alias("avg_abs_dm"), F.round("med_abs_dm", 9).alias("med_abs_dm"))


# ---- runs together --------------------------------------------------------------------------------------------------


def _runs(spark, sf):
    """Labelled documents as the matches of two runs: those with an even id lack a retention time."""
    rows = _labelled(spark, sf).select(F.concat("lang", F.col("doc_id") % 40).alias("peptide"), "is_target", "Score", "doc_id")
    rows = rows.withColumn("target_pair", F.col("peptide")).withColumn("Score", F.col("Score") + F.col("doc_id") * 1e-6)  # no ties
    even = F.col("doc_id") % 2 == 0
    return {"one": rows.where(even).drop("doc_id"), "two": rows.where(~even).withColumn("RetentionTime", F.col("doc_id").cast("double")).drop("doc_id")}


@query(f"""
WITH {_LABELLED}, m AS (SELECT lang || (doc_id % 40) AS peptide, score + doc_id * 1e-6::DOUBLE AS score, t, CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'two' END AS run, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id::DOUBLE END AS rt FROM l),
 b AS (SELECT peptide, max(score) AS score, arg_max(t, (score, t::INT)) AS t FROM m GROUP BY peptide),
 c AS (SELECT *, count(*) FILTER (WHERE t) OVER w AS nt, count(*) FILTER (WHERE NOT t) OVER w AS nd FROM b WINDOW w AS (ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
 f AS (SELECT *, CASE WHEN nt > 0 THEN least(1.0::DOUBLE, (nd + 1)::DOUBLE / nt) ELSE 1.0::DOUBLE END AS fdr FROM c),
 q AS (SELECT peptide, t, min(fdr) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING) AS q FROM f)
SELECT a.peptide AS peptide, r.run AS run, round(q, 9) AS q_value, max(rt) FILTER (WHERE NOT rt IS NULL AND m.score = s) AS "RetentionTime"
FROM q a, (SELECT DISTINCT run FROM m) r LEFT JOIN (SELECT *, max(score) OVER (PARTITION BY peptide, run) AS s FROM m) m ON m.peptide = a.peptide AND m.run = r.run
WHERE a.t AND q <= 0.75 GROUP BY ALL""")
def cross_run_confidence(spark, sf):
    """Joint q-values of two runs, and each accepted peptide's best retention time in either; null where a run has none."""
    together = union_runs(_runs(spark, sf))
    peptides = conf.peptide_confidence(together)
    accepted = peptides.where(F.col("is_target") & (F.col("q_value") <= 0.75)).select("peptide", F.round("q_value", 9).alias("q_value"))
    cells = run_cells(together, accepted.select("peptide"), "RetentionTime", "Score", ["one", "two"])
    return cells.join(accepted, "peptide").select("peptide", "run", "q_value", "RetentionTime")


@query(f"""
WITH {_LABELLED}, b AS (SELECT lang || source AS proteins, max(score) AS score, arg_max(t, (score, t::INT)) AS t FROM l GROUP BY 1),
 c AS (SELECT *, count(*) FILTER (WHERE t) OVER w AS nt, count(*) FILTER (WHERE NOT t) OVER w AS nd FROM b WINDOW w AS (ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
 f AS (SELECT *, CASE WHEN nt > 0 THEN least(1.0::DOUBLE, (nd + 1)::DOUBLE / nt) ELSE 1.0::DOUBLE END AS fdr FROM c)
SELECT proteins, t AS is_target, round(min(fdr) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING), 9) AS q_value FROM f""")
def protein_fdr(spark, sf):
    rows = _labelled(spark, sf).select(F.concat("lang", "source").alias("proteins"), "is_target", "Score")
    return conf.protein_confidence(rows).select("proteins", "is_target", F.round("q_value", 9).alias("q_value"))


@query("WITH e AS (SELECT vec_id, unnest(range(1, 17)) AS k, embedding FROM embeddings), a AS (SELECT vec_id, k, embedding[k]::DOUBLE AS w FROM e WHERE vec_id % 25 = 0), b AS (SELECT vec_id, k, embedding[k]::DOUBLE AS w FROM e WHERE vec_id % 40 = 1) SELECT a.vec_id AS \"row\", b.vec_id AS run, round(sum(a.w * b.w), 6) AS value FROM a JOIN b USING (k) GROUP BY 1, 2")
def factor_product(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(F.slice("x", 1, 16)).alias("factor", "weight"))
    left = rows.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "row")
    right = rows.where("vec_id % 40 = 1").withColumnRenamed("vec_id", "run")
    return impute.factor_product(left, right).select("row", "run", F.round("value", 6).alias("value"))


# ---- neighbour graphs -----------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT event_id, value, epoch_us(ts) / 1e6 AS s FROM events WHERE event_type = 'click') SELECT a.event_id AS \"left\", b.event_id AS \"right\" FROM c a JOIN c b ON b.value - a.value >= -0.1::DOUBLE AND b.value - a.value < 0.1::DOUBLE AND b.s - a.s BETWEEN -43200 AND 43200")
def self_neighbours(spark, sf):
    """A table's rows near one another in two dimensions; every row is its own neighbour."""
    rows = table(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"), "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"))
    return graph.NeighborFinder({"value": (-0.1, 0.1), "sec": (-43200.0, 43200.0)}, ("value", "sec")).find(rows)


@query("WITH c AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'view') SELECT a.event_id AS \"left\", b.event_id AS \"right\" FROM c a JOIN c b ON b.value - a.value >= -0.05::DOUBLE AND b.value - a.value < 0.2::DOUBLE AND abs(a.user_id - b.user_id) + a.user_id % 3 BETWEEN 1 AND 40")
def own_distance(spark, sf):
    """Neighbours by a difference in one dimension and by a distance of one's own in another."""
    rows = table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), "value", "user_id")
    finder = graph.NeighborFinder({"value": (-0.05, 0.2), "user_id": (1, 40)}, distances={"user_id": lambda a, b: F.abs(a - b) + a % 3})
    return finder.find(rows)


@query("WITH " + _FRAGS + " SELECT ion AS ion_series, min(i)::INT AS least, count(*) AS fragments FROM frags WHERE i >= 3 GROUP BY ion")
def minimum_position(spark, sf):
    """Fragments that are searched: three residues or more."""
    index = PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO).from_position()
    return index.frags.groupBy("ion_series").agg(F.min("ion_position").alias("least"), F.count(F.lit(1)).alias("fragments"))


@query("WITH e AS (SELECT embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT floor(x[i] * 20)::BIGINT AS \"left\", floor(x[i + 8] * 20)::BIGINT AS \"right\" FROM (SELECT x, unnest(range(1, 9)) AS i FROM e)) SELECT \"left\", \"right\" FROM p UNION SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey < 5")
def edges_added(spark, sf):
    """Edges of parallel arrays, and more edges; repeats count once."""
    bins = lambda a: F.transform(a, lambda v: F.floor(v * 20))
    first = graph.edges_from_arrays(_vectors(spark, sf).select(bins(F.slice("x", 1, 8)).alias("a"), bins(F.slice("x", 9, 8)).alias("b")), "a", "b")
    more = table(spark, sf, "lineitem").where("l_suppkey < 5").select(F.col("l_suppkey").cast("long").alias("left"), F.col("l_linenumber").cast("long").alias("right"))
    return graph.add_edges(first, more)


@query("WITH p AS (SELECT user_id AS spec_id, event_id, value * 10 AS mz FROM events) " + " UNION ALL ".join(f"SELECT a.spec_id AS spec_id, a.event_id AS \"left\", b.event_id AS \"right\", {z} AS charge FROM p a JOIN p b USING (spec_id) WHERE b.mz - a.mz >= {{n}}::DOUBLE / {z} - 0.05::DOUBLE AND b.mz - a.mz < {{n}}::DOUBLE / {z} + 0.05::DOUBLE".format(n=iso.NEUTRON) for z in (3, 2, 1)))
def isotope_pairs(spark, sf):
    """Peaks of a spectrum that lie one neutron over a charge apart."""
    peaks = table(spark, sf, "events").select(F.col("user_id").alias("spec_id"), F.col("event_id").alias("peak_id"), (F.col("value") * 10).alias("mz"))
    return iso.isotope_edges(peaks, 2, 0.05)
