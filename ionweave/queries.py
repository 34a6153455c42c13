"""The engine's operators over the driver's tables, each with the SQL that says the same.

Stand-ins: documents as proteins (letters of the text that name amino acids), lineitem as peaks (supplier = spectrum),
events as scans (user = window), embeddings as traces (label = feature), labels as target and decoy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.config import SearchConfig
from ionweave.functions import peaks as pk
from ionweave.functions import peptide as pep
from ionweave.functions import traces as tr
from ionweave.operators import band_join as bj
from ionweave.operators import confidence as conf
from ionweave.operators import deisotope as iso
from ionweave.operators import graph, impute, ngram, ranking
from ionweave.operators.peptide_index import PeptideIndex, peptides, precursors
from ionweave.operators.scoring import hyperscore, with_names
from ionweave.operators.seeds import seed_neighbours
from ionweave.plans.aggregate_runs import union_runs
from ionweave.plans.window_search import window_search
from ionweave.sources.spectra import isolation_windows
from ionweave.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- scans, filters, peak lists -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 20000 AND l_extendedprice < 30000")
def scan_filter_halfopen(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").where((price >= 20000) & (price < 30000)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE user_id > 0 AND event_type = 'view'")
def window_key_distinct(spark, sf):
    views = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("quad_low_mz_values"), F.col("event_type").alias("quad_high_mz_values"))
    return isolation_windows(views).toDF("user_id", "event_type")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _as_peaks(x):
    return F.transform(x, lambda v, i: F.struct(v.alias("mz"), i.cast("double").alias("intensity")))


_LIST_SQL = "SELECT vec_id, len(k) AS n, round(coalesce(list_sum(k), 0), 6) AS total FROM (SELECT vec_id, list_filter(embedding::DOUBLE[], lambda v: {}) AS k FROM embeddings)"


def _listed(rows, kept):
    total = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + p["mz"])
    return rows.select("vec_id", F.size(kept).cast("long").alias("n"), F.round(total, 6).alias("total"))


@query(_LIST_SQL.format("v >= -0.1 AND v <= 0.1"))
def peak_hof_between(spark, sf):
    return _listed(_vectors(spark, sf), pk.keep_between(_as_peaks(F.col("x")), -0.1, 0.1))


@query(_LIST_SQL.format("v < -0.1 OR v > 0.1"))
def peak_hof_outside(spark, sf):
    return _listed(_vectors(spark, sf), pk.keep_outside(_as_peaks(F.col("x")), -0.1, 0.1))


@query("SELECT vec_id, len(k) AS n, round(coalesce(list_sum(k), 0), 6) AS total FROM (SELECT vec_id, list_filter(x, lambda v: v >= list_max(x) * 0.5::DOUBLE) AS k FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))")
def peak_ratio_filter(spark, sf):
    swapped = F.transform("x", lambda v: F.struct(v.alias("mz"), v.alias("intensity")))
    return _listed(_vectors(spark, sf), pk.keep_ratio(swapped, 0.5))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 20")
def peak_topk_per_spectrum(spark, sf):
    return ranking.top_rows(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 20)


@query("SELECT user_id, value AS base_value, event_id AS base_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def base_peak(spark, sf):
    best = ranking.best_row(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], F.struct("value", -F.col("event_id")))
    return best.select("user_id", F.col("value").alias("base_value"), F.col("event_id").alias("base_event"))


@query("SELECT user_id, round(b * 0.3::DOUBLE, 6) AS mz, round(s, 4) AS value FROM (SELECT user_id, round_even(value / 0.3::DOUBLE, 0) AS b, sum(value) AS s FROM events GROUP BY 1, 2)")
def mz_bin_sum(spark, sf):
    made = ranking.mz_bins(table(spark, sf, "events").select("user_id", F.col("value").alias("mz"), "value"), ["user_id"], "mz", "value", 0.3)
    return made.select("user_id", F.round("mz", 6).alias("mz"), F.round("value", 4).alias("value"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(1, 65), lambda i: {'v': embedding[i], 'i': i - 1}))[1:5], lambda s: s.i), ',') AS lowest FROM embeddings")
def array_cosort(spark, sf):
    order = pk.sort_by_mz(F.arrays_zip(F.col("x").alias("mz"), F.sequence(F.lit(0), F.size("x") - 1).alias("i")))
    return _vectors(spark, sf).select("vec_id", F.array_join(F.transform(F.slice(order, 1, 5), lambda s: s["i"].cast("string")), ",").alias("lowest"))


@query("SELECT vec_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(x[1:32], lambda v: floor(v * 10)::INT), list_transform(x[33:64], lambda v: floor(v * 10)::INT)))), ',') AS bins FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def array_union_sorted(spark, sf):
    bins = lambda a: F.transform(a, lambda v: F.floor(v * 10).cast("int"))
    both = pk.sorted_union(bins(F.slice("x", 1, 32)), bins(F.slice("x", 33, 32)))
    return _vectors(spark, sf).select("vec_id", F.array_join(both.cast("array<string>"), ",").alias("bins"))


# ---- joins ----------------------------------------------------------------------------------------------------------


def _of_type(spark, sf, kind, prefix):
    rows = table(spark, sf, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("event_id").alias(f"{prefix}_id"), F.col("value").alias(f"{prefix}_value"), F.col("user_id").alias(f"{prefix}_user"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias(f"{prefix}_sec"))


_PAIRS = "SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.event_type = 'view' AND c.event_type = 'click' AND {}"


@query(_PAIRS.format("abs(c.value - v.value) <= 0.005::DOUBLE"))
def band_join_da(spark, sf):
    return bj.band_join(_of_type(spark, sf, "view", "view"), _of_type(spark, sf, "click", "click"), "view_value", "click_value", 0.005).select("view_id", "click_id")


@query(_PAIRS.format("v.value > 0 AND c.value > 0 AND abs(c.value - v.value) <= 333::DOUBLE * v.value / 1e6::DOUBLE"))
def band_join_ppm(spark, sf):
    return bj.band_join(_of_type(spark, sf, "view", "view"), _of_type(spark, sf, "click", "click"), "view_value", "click_value", 333.0, "ppm").select("view_id", "click_id")


@query(_PAIRS.format("c.value - v.value >= -0.025::DOUBLE AND c.value - v.value < 0.035::DOUBLE AND epoch_us(c.ts) / 1e6 - epoch_us(v.ts) / 1e6 BETWEEN -86400 AND 86400"))
def band_join_2d(spark, sf):
    dims = [("view_value", "click_value", -0.025, 0.035), ("view_sec", "click_sec", -86400.0, 86400.0)]
    return bj.band_join_multi(_of_type(spark, sf, "view", "view"), _of_type(spark, sf, "click", "click"), dims).select("view_id", "click_id")


@query("""
WITH c AS (SELECT user_id, event_id AS centre_id, value AS m FROM events WHERE event_type = 'signup'),
     p AS (SELECT user_id, event_type AS scan, event_id, value FROM events WHERE event_type <> 'signup'),
     g AS (SELECT user_id, scan, centre_id, m FROM (SELECT DISTINCT user_id, scan FROM p) JOIN c USING (user_id))
SELECT g.user_id AS user_id, g.scan AS scan, g.centre_id AS centre_id, round(coalesce(sum(p.value), 0), 4) AS intensity, count(p.value) AS n
FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.scan = g.scan AND abs(p.value - g.m) <= 1.505::DOUBLE GROUP BY ALL""")
def xic_sum(spark, sf):
    events = table(spark, sf, "events")
    centres = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("centre_id"), F.col("value").alias("centre_mz"))
    peaks = events.where("event_type <> 'signup'").select("user_id", F.col("event_type").alias("scan"), F.col("event_id").alias("peak_index"), F.col("value").alias("mz"), F.col("value").alias("intensity"))
    out = bj.extracted_chromatogram(peaks, centres, 1.505, group="user_id")
    return out.select("user_id", "scan", "centre_id", F.round("intensity", 4).alias("intensity"), F.size("indices").cast("long").alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def lookup_join_seq(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    best = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("seq_id"))
    seqs = customers.select(F.col("c_custkey").alias("seq_id"), F.col("c_name").alias("seq_proforma"), F.col("c_acctbal").alias("seq_mz"), F.lit(False).alias("decoy"))
    return with_names(best, seqs).select("o_orderkey", F.col("peptide").alias("c_name"))


@query("SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS decoy FROM customer")
def decoy_antijoin(spark, sf):
    from ionweave.operators.scoring import label_decoys

    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return label_decoys(table(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey")


@query("SELECT p.user_id AS user_id, r.n AS n_clicks FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 30) p LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1) r ON p.user_id = r.user_id")
def left_join_runs(spark, sf):
    events = table(spark, sf, "events")
    accepted = events.where("event_type = 'purchase' and value > 30").select("user_id").distinct()
    run = events.where("event_type = 'click' and value > 60").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_clicks"))
    return accepted.join(run, "user_id", "left")


@query("SELECT event_id, user_id, NULL::DOUBLE AS value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL::BIGINT, value FROM events WHERE event_type = 'error'")
def union_diagonal(spark, sf):
    events = table(spark, sf, "events")
    return union_runs({"one": events.where("event_type = 'view'").select("event_id", "user_id"), "two": events.where("event_type = 'error'").select("event_id", "value")}).drop("run")


@query("SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS click, min(value) FILTER (WHERE event_type = 'view') AS \"view\" FROM events GROUP BY user_id")
def pivot_runs(spark, sf):
    return impute.collection_matrix(table(spark, sf, "events"), "value", ["click", "view"], row="user_id", run="event_type")


@query("""
WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, event_id AS next_error FROM events WHERE event_type = 'error')
SELECT a.event_id AS event_id, b.next_error AS next_error FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts <= b.ts""")
def asof_next_scan(spark, sf):
    events = table(spark, sf, "events")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("next_error"))
    return bj.nearest_after(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), errors, "ts", "ts", ["next_error"], "user_id").select("event_id", "next_error")


@query("""
WITH p AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
     e AS (SELECT a.user_id AS user_id, a.event_id AS x, b.event_id AS y FROM p a JOIN p b ON a.user_id = b.user_id AND a.r <= greatest(5, floor(a.n * 0.2::DOUBLE)) AND abs(b.value - a.value) <= 1.005::DOUBLE AND abs(b.sec - a.sec) <= 259200)
SELECT user_id, x AS "left", y AS "right" FROM e UNION SELECT user_id, y, x FROM e UNION SELECT user_id, event_id, event_id FROM p""")
def seed_neighbourhoods(spark, sf):
    peaks = table(spark, sf, "events").select("user_id", F.col("event_id").alias("peak_id"), F.col("value").alias("mz"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("mobility"), F.col("value").alias("intensity"))
    return seed_neighbours(peaks, 5, 0.2, 259200.0, 1.005, spectrum="user_id")


# ---- windows, ranks, segments ---------------------------------------------------------------------------------------


@query("SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def score_zscore(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(ranking.z_score("value", ["user_id"]), 6).alias("z"))


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r <= 3")
def nlargest_keep_all(spark, sf):
    return ranking.top_with_ties(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", 3)


@query("SELECT event_id, m AS rolling_max FROM (SELECT event_id, max(value) OVER w AS m, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE c = 3")
def rolling_max3(spark, sf):
    return ranking.rolling_max_rows(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", "rolling_max")


@query("SELECT event_id, greatest(0, least(i - 10, n - 21)) AS first, least(greatest(0, least(i - 10, n - 21)) + 21, n) AS stop FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def centered_window(spark, sf):
    w = Window.partitionBy("user_id")
    rows = table(spark, sf, "events").select("event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    first, stop = ranking.centred_frame(F.col("i"), F.col("n"), 21)
    return rows.select("event_id", first.alias("first"), stop.alias("stop"))


@query("""
SELECT event_id, sum(j) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (
  SELECT event_id, user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 86400 THEN 1 ELSE 0 END AS j FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s FROM events))""")
def gap_sessions(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return ranking.gap_segments(rows, ["user_id"], "s", 86400.0).select("event_id", "segment")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 128 AS chunk FROM lineitem")
def fixed_chunks(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return ranking.chunks(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 128).drop("l_suppkey")


# ---- traces ---------------------------------------------------------------------------------------------------------


def _with_reference(rows):
    ref = rows.groupBy("label").agg(F.min_by("x", "vec_id").alias("r"))
    return rows.join(ref, "label")


_REF = "r AS (SELECT label, arg_min(x, vec_id) AS r FROM v GROUP BY label)"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
_COS = "list_dot_product(list_transform(x, lambda a: a / ({xm} + 1e-5::DOUBLE)), list_transform(r, lambda a: a / ({rm} + 1e-5::DOUBLE))) / (sqrt(list_sum(list_transform(x, lambda a: (a / ({xm} + 1e-5::DOUBLE)) ** 2))) * sqrt(list_sum(list_transform(r, lambda a: (a / ({rm} + 1e-5::DOUBLE)) ** 2))) + 1e-5::DOUBLE)"


@query(f"WITH {_V}, {_REF} SELECT vec_id, round({_COS.format(xm='list_max(x)', rm='list_max(r)')}, 6) AS cosine FROM v JOIN r USING (label)")
def cosine_sim(spark, sf):
    return _with_reference(_vectors(spark, sf)).select("vec_id", F.round(tr.cosine_similarity(F.col("x"), F.col("r")), 6).alias("cosine"))


@query(f"WITH {_V}, {_REF} SELECT vec_id, round(1 - 2 * acos({_COS.format(xm='list_max(x)', rm='list_max(r)')}) / pi(), 6) AS angle FROM v JOIN r USING (label)")
def spectral_angle(spark, sf):
    return _with_reference(_vectors(spark, sf)).select("vec_id", F.round(tr.spectral_angle(F.col("x"), F.col("r")), 6).alias("angle"))


def _correlations(spark, sf):
    unit = _vectors(spark, sf).select("vec_id", "label", tr.smoothed_unit(F.col("x")).alias("x"))
    top = unit.groupBy("label").agg(F.max(F.array_max("x")).alias("top"))
    both = _with_reference(unit).join(top, "label")
    return both.select("vec_id", "label", F.round(tr.spectral_angle(F.col("x"), F.col("r"), x_max=F.col("top")), 6).alias("correlation"))


_CORR = f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
     m AS (SELECT vec_id, label, list_transform(range(1, 63), lambda i: greatest(x[i], x[i + 1], x[i + 2])) AS x FROM e),
     q AS (SELECT vec_id, label, list_transform(x, lambda a: sqrt(abs(a)) * sign(a)) AS x FROM m),
     v AS (SELECT vec_id, label, list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: (b + 1e-5::DOUBLE) ** 2)))) AS x FROM q),
     {_REF}, t AS (SELECT label, max(list_max(x)) AS top FROM v GROUP BY label),
     c AS (SELECT vec_id, label, round(1 - 2 * acos({_COS.format(xm='top', rm='list_max(r)')}) / pi(), 6) AS correlation FROM v JOIN r USING (label) JOIN t USING (label))
"""


@query(_CORR + "SELECT vec_id, correlation FROM c")
def ref_trace_corr(spark, sf):
    return _correlations(spark, sf).select("vec_id", "correlation")


@query(_CORR + "SELECT vec_id, round(ln(1 + (row_number() OVER (PARTITION BY label ORDER BY correlation DESC, vec_id) - 1)) + 1, 6) AS weight FROM c")
def corr_rank_weight(spark, sf):
    return _correlations(spark, sf).select("vec_id", F.round(ranking.correlation_weight("correlation", ["label"], "vec_id"), 6).alias("weight"))


@query(_CORR + "SELECT label, round(quantile_cont(correlation, 0.75), 6) AS q75 FROM c GROUP BY label")
def q75_corr(spark, sf):
    return _correlations(spark, sf).groupBy("label").agg(F.round(F.percentile("correlation", F.lit(0.75)), 6).alias("q75"))


@query("SELECT vec_id, len(list_filter(x, lambda a: a - list_min(x) >= (list_max(x) - list_min(x)) / 2)) AS points FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def fwhm_points(spark, sf):
    return _vectors(spark, sf).select("vec_id", tr.points_over_half(F.col("x")).cast("long").alias("points"))


# ---- peptides -------------------------------------------------------------------------------------------------------

#: Peptides of the stand-in proteins: fully cut, one precursor charge, singly charged fragments.
PSEUDO = SearchConfig(db_max_missed_cleavages=0, precursor_charges=(2,), ion_charges=(1,))


def _proteins(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("accession"), "doc_id", pep.clean_protein(F.coalesce("text", F.lit(""))).alias("sequence"))


_LETTERS = "".join(pep.RESIDUES)
_MASS = "[" + ", ".join(f"{m!r}::DOUBLE" for m in pep.residue_masses().values()) + f"][strpos('{_LETTERS}', c)]"
_PROT = "prot AS (SELECT doc_id, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM documents)"
_PEP = _PROT + """,
 pieces AS (SELECT doc_id, regexp_extract_all(s, '[^KR]*[KR]|[^KR]+$') AS p FROM prot),
 pep AS (SELECT DISTINCT peptide FROM (SELECT unnest(p) AS peptide FROM pieces) WHERE length(peptide) BETWEEN 7 AND 25)"""
_TURN = "CASE WHEN length({0}) < 3 THEN {0} ELSE {0}[1] || reverse({0}[2:-2]) || {0}[-1] END"
_INDEX = _PEP + f""",
 turned AS (SELECT DISTINCT {_TURN.format('peptide')} AS peptide FROM pep),
 every AS (SELECT peptide, false AS decoy, 'target' AS origin FROM pep UNION ALL SELECT peptide, true, 'decoy' FROM turned WHERE peptide NOT IN (SELECT peptide FROM pep)),
 weighed AS (SELECT *, list_transform(string_split(peptide, ''), lambda c: {_MASS}) AS w FROM every),
 charged AS (SELECT *, (list_sum(w) + {pep.WATER}::DOUBLE + 2 * {pep.PROTON}::DOUBLE) / 2 AS seq_mz, peptide || '/2' AS proforma FROM weighed),
 seqs AS (SELECT *, ('0x' || substr(md5(proforma || origin), 1, 15))::BIGINT AS seq_id FROM charged WHERE seq_mz BETWEEN 399 AND 1001)"""
_FRAGS = _INDEX + f""",
 steps AS (SELECT seq_id, seq_mz, w, list_reverse(w) AS u, unnest(range(1, len(w))) AS i FROM seqs),
 frags AS (SELECT * FROM (
   SELECT seq_id, seq_mz, 'b' AS ion, i, list_sum(w[1:i]) + {pep.PROTON}::DOUBLE AS mz FROM steps UNION ALL
   SELECT seq_id, seq_mz, 'y', i, list_sum(list_concat([{pep.WATER}::DOUBLE], u[1:i])) + {pep.PROTON}::DOUBLE FROM steps) WHERE mz > 150 AND mz < 2000)"""


@query("WITH " + _PROT + ", pieces AS (SELECT regexp_extract_all(s, '[^KR]*[KR]|[^KR]+$') AS p FROM prot), runs AS (SELECT unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]), list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2]))) AS peptide FROM pieces) SELECT DISTINCT peptide FROM runs WHERE length(peptide) BETWEEN 7 AND 25")
def digest_peptides(spark, sf):
    return peptides(_proteins(spark, sf), SearchConfig())


@query("WITH " + _INDEX + " SELECT proforma AS seq_proforma, round(seq_mz, 6) AS seq_mz FROM seqs WHERE NOT decoy")
def peptide_mz(spark, sf):
    made = precursors(peptides(_proteins(spark, sf), PSEUDO), PSEUDO)
    return made.select("seq_proforma", F.round("seq_mz", 6).alias("seq_mz"))


@query("WITH " + _FRAGS + " SELECT ion AS ion_series, i::INT AS ion_position, count(*) AS n, round(min(mz), 6) AS low, round(max(mz), 6) AS high, round(avg(mz), 6) AS mean FROM frags GROUP BY ion, i")
def fragment_ladder(spark, sf):
    index = PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO)
    return index.frags.groupBy("ion_series", "ion_position").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("mz"), 6).alias("low"), F.round(F.max("mz"), 6).alias("high"), F.round(F.avg("mz"), 6).alias("mean"))


@query("WITH " + _INDEX + " SELECT seq_id, proforma AS seq_proforma, decoy FROM seqs")
def target_decoy_index(spark, sf):
    return PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO).seqs.select("seq_id", "seq_proforma", "decoy")


@query("WITH " + _PEP + f" SELECT peptide, {_TURN.format('peptide')} AS decoy FROM pep")
def make_decoy(spark, sf):
    return peptides(_proteins(spark, sf), PSEUDO).select("peptide", pep.reverse_interior(F.col("peptide")).alias("decoy"))


@query("WITH " + _PEP + f" SELECT {_TURN.format('peptide')} || '/3' AS decoy, peptide || '/3' AS target FROM pep")
def decoy_to_target(spark, sf):
    decoys = peptides(_proteins(spark, sf), PSEUDO).select(F.concat(pep.reverse_interior(F.col("peptide")), F.lit("/3")).alias("decoy"))
    return decoys.select("decoy", pep.reverse_interior(F.col("decoy")).alias("target"))


def _proforma():
    """A made-up modified peptide from a part."""
    return F.concat(F.lit("<["), F.col("p_type"), F.lit("]@C>"), F.upper(F.regexp_replace("p_name", "[^a-z]", "")), F.lit("[+79.9]K/"), (F.col("p_size") % 3 + 1).cast("string"))


_PROFORMA = "'<[' || p_type || ']@C>' || upper(regexp_replace(p_name, '[^a-z]', '', 'g')) || '[+79.9]K/' || (p_size % 3 + 1)"
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace({_PROFORMA}, '^<.*>', ''), '\\[.*?\\]', '', 'g'), '/\\d+$', '')"


@query(f"SELECT p_partkey, {_STRIPPED} AS bare FROM part")
def strip_mods(spark, sf):
    return table(spark, sf, "part").select("p_partkey", pep.strip_mods(pep.strip_global_mods(_proforma())).alias("bare"))


@query(f"SELECT p_partkey, length(b) AS peptide_length, round(100.0::DOUBLE * p_size / length(b), 6) AS npeaks_pct FROM (SELECT p_partkey, p_size, {_STRIPPED} AS b FROM part)")
def peptide_len_pct(spark, sf):
    bare = F.length(pep.strip_mods(pep.strip_global_mods(_proforma())))
    return table(spark, sf, "part").select("p_partkey", bare.cast("long").alias("peptide_length"), F.round(100 * F.col("p_size") / bare, 6).alias("npeaks_pct"))


@query("WITH " + _PROT + " SELECT ngram, count(*) AS proteins FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) AS ngram FROM prot) GROUP BY ngram")
def ngram_index(spark, sf):
    return ngram.ngram_index(_proteins(spark, sf)).groupBy("ngram").agg(F.count(F.lit(1)).alias("proteins"))


_ASKED = _PEP + ", asked AS (SELECT DISTINCT peptide FROM (SELECT unnest(p) AS peptide FROM pieces WHERE doc_id % 50 = 0) WHERE length(peptide) BETWEEN 7 AND 25)"


def _asked(proteins):
    """The search's queries: peptides of every protein whose id is divisible by 50, against all proteins."""
    return peptides(proteins.where("doc_id % 50 = 0"), PSEUDO)


@query("WITH " + _ASKED + " SELECT peptide, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id::VARCHAR) AS proteins FROM asked JOIN prot ON contains(s, peptide) GROUP BY peptide")
def ngram_search(spark, sf):
    proteins = _proteins(spark, sf)
    return ngram.find_proteins(_asked(proteins), ngram.ngram_index(proteins, 7), proteins, 7)


@query("WITH " + _ASKED + f""",
 psm AS (SELECT peptide AS t, CASE WHEN length(peptide) % 3 = 0 THEN {_TURN.format('peptide')} ELSE peptide END || '/2' AS peptide, length(peptide) % 3 <> 0 AS is_target, length(peptide) % 5 AS b_npeaks FROM asked WHERE length(peptide) % 2 = 0),
 own AS (SELECT peptide, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id::VARCHAR) AS proteins FROM asked JOIN prot ON contains(s, peptide) GROUP BY peptide)
SELECT psm.peptide AS peptide, b_npeaks, is_target, 'run' AS filename, t || '/2' AS target_pair, length(t) AS peptide_length, round(100.0::DOUBLE * b_npeaks / length(t), 6) AS b_npeaks_pct, own.proteins AS proteins FROM psm LEFT JOIN own ON own.peptide = psm.t""")
def psm_prepare(spark, sf):
    proteins = _proteins(spark, sf)
    n = F.length("peptide")
    psms = _asked(proteins).select((n % 2 + 1).alias("rank"), F.concat(F.when(n % 3 == 0, pep.reverse_interior(F.col("peptide"))).otherwise(F.col("peptide")), F.lit("/2")).alias("peptide"), F.array(n).alias("mzs"), (n % 5).cast("long").alias("b_npeaks"), (n % 3 == 0).alias("decoy"))
    out = conf.prepare_psms(psms, proteins.select("accession", "sequence"), "run", 7)
    return out.withColumn("peptide_length", F.col("peptide_length").cast("long")).withColumn("b_npeaks_pct", F.round("b_npeaks_pct", 6))


# ---- scoring --------------------------------------------------------------------------------------------------------


def pseudo_peaks(spark, sf):
    """Peaks of supplier spectra; each spectrum has an isolation window of 10 Th."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    low = (F.lit(400) + 10 * (F.col("l_suppkey") % 60)).cast("double")
    peak = F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8
    return rows.select(F.col("l_suppkey").cast("long").alias("spec_id"), peak.alias("peak_id"), (F.col("l_extendedprice") / 50).alias("spec_mz"), F.col("l_quantity").alias("spec_int"), low.alias("prec_low"), (low + 10).alias("prec_high"))


#: Every step is held as a table of its own, so that none is computed twice.
HYPERSCORE_SQL = ("WITH " + _FRAGS + """,
 peaks AS (SELECT l_suppkey AS spec, l_suppkey % 60 AS w, l_extendedprice / 50 AS mz, l_quantity AS inten FROM lineitem),
 binned AS (SELECT *, unnest(range(floor(mz - 0.2)::BIGINT, floor(mz + 0.2)::BIGINT + 1)) AS bin FROM peaks),
 hits AS (SELECT spec, seq_id, ion, inten FROM binned p JOIN (SELECT *, floor(mz)::BIGINT AS fbin, floor((seq_mz - 400) / 10)::BIGINT AS fw FROM frags) f ON p.bin = f.fbin AND p.w = f.fw AND abs(f.mz - p.mz) <= 0.2::DOUBLE),
 cand AS (SELECT spec, seq_id, count(*) AS n, count(*) FILTER (WHERE ion = 'b') AS bn, count(*) FILTER (WHERE ion = 'y') AS yn, coalesce(sum(inten) FILTER (WHERE ion = 'b'), 0) AS bi, coalesce(sum(inten) FILTER (WHERE ion = 'y'), 0) AS yi FROM hits GROUP BY spec, seq_id HAVING count(*) > 3),
 prelim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY n DESC, seq_id) AS r FROM cand) WHERE r <= 200),
 scored AS (SELECT *, ln(1 + bi) + ln(1 + yi) + n AS score FROM prelim),
 z AS (SELECT *, coalesce((score - avg(score) OVER (PARTITION BY spec)) / nullif(stddev_samp(score) OVER (PARTITION BY spec), 0), 0) AS z, rank() OVER (PARTITION BY spec ORDER BY round(score, 9) DESC) AS k, row_number() OVER (PARTITION BY spec ORDER BY round(score, 9) DESC, seq_id) AS rank FROM scored)
SELECT spec AS spec_id, s.proforma AS peptide, s.decoy AS decoy, bn AS b_npeaks, yn AS y_npeaks, round(score, 6) AS "Score", round(z, 6) AS "ScoreZ", rank, round(s.seq_mz, 6) AS "PrecursorMZ" FROM z JOIN seqs s USING (seq_id) WHERE k <= 10""").replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query(HYPERSCORE_SQL)
def hyperscore_topn(spark, sf):
    index = PeptideIndex.from_proteins(_proteins(spark, sf), PSEUDO)
    top = hyperscore(pseudo_peaks(spark, sf), index, 0.2, "da", top_n=10)
    return top.select("spec_id", "peptide", "decoy", "b_npeaks", "y_npeaks", F.round("Score", 6).alias("Score"), F.round("ScoreZ", 6).alias("ScoreZ"), F.col("rank").cast("long").alias("rank"), F.round("PrecursorMZ", 6).alias("PrecursorMZ"))


@query()
def dia_greedy_search(spark, sf):
    """Rows only: the greedy search has no SQL. Twenty windows of 30 Th, twelve scans each. The
    settings are SearchConfig's own but for the fragment tolerance of 0.5 Da."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("w"), (F.col("l_orderkey") % 12).cast("double").alias("rt"), (F.col("l_extendedprice") / 50).alias("mz"), (F.col("l_quantity") * 100).alias("i"))
    peaks = F.array_sort(F.collect_list(F.struct("mz", "i")))
    low = (F.lit(400) + 30 * F.col("w")).cast("double")
    scans = rows.groupBy("w", "rt").agg(peaks.alias("p"))
    raw = scans.select(F.col("rt").alias("rt_values"), low.alias("quad_low_mz_values"), (low + 30).alias("quad_high_mz_values"), F.col("p.mz").alias("mz_values"), F.col("p.i").alias("corrected_intensity_values"), F.lit(None).cast("array<double>").alias("mobility_values"))
    config = SearchConfig(g_tolerances=(20.0, 0.5), g_tolerance_units=("ppm", "da"))
    return window_search(raw, PeptideIndex.from_proteins(_proteins(spark, sf), config), config)


@query()
def deisotope(spark, sf):
    """Rows only: the absorbing pass is sequential. One spectrum per user."""
    peaks = F.array_sort(F.collect_list(F.struct((F.col("value") * 10 + 100).alias("mz"), (F.col("event_id") % 97 + 1.0).alias("i"))))
    spectra = table(spark, sf, "events").groupBy("user_id").agg(peaks.alias("p"))
    out = iso.deisotope(spectra.select("user_id", F.col("p.mz").alias("mz"), F.col("p.i").cast("array<double>").alias("intensity")), 2, 0.01, "da")
    return out.select("user_id", F.size("mz").alias("n_peaks"), F.round(F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v), 6).alias("intensity"))


# ---- confidence -----------------------------------------------------------------------------------------------------


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("Score"), "lang", "source").join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_target")), "doc_id")


_LABELLED = "l AS (SELECT doc_id, n_chars::DOUBLE AS score, lang, source, quality = 1 AS t FROM documents JOIN labels USING (doc_id))"


@query(f"""
WITH {_LABELLED},
 c AS (SELECT *, count(*) FILTER (WHERE t) OVER w AS nt, count(*) FILTER (WHERE NOT t) OVER w AS nd FROM l WINDOW w AS (ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
 f AS (SELECT *, CASE WHEN nt > 0 THEN least(1.0::DOUBLE, (nd + 1)::DOUBLE / nt) ELSE 1.0::DOUBLE END AS fdr FROM c)
SELECT doc_id, t AS is_target, round(min(fdr) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING), 9) AS q_value FROM f""")
def tdc_qvalues(spark, sf):
    return conf.q_values(_labelled(spark, sf), "Score", "is_target").select("doc_id", "is_target", F.round("q_value", 9).alias("q_value"))


@query(f"WITH {_LABELLED}, b AS (SELECT lang || source AS peptide, NOT t AS decoy, max(score) AS s FROM l GROUP BY ALL) SELECT decoy, count(*) AS peptides, round(avg(s), 6) AS mean_score, round(quantile_cont(s, 0.95), 6) AS q95_score FROM b GROUP BY decoy")
def score_metrics(spark, sf):
    rows = _labelled(spark, sf).select(F.concat("lang", "source").alias("peptide"), (~F.col("is_target")).alias("decoy"), "Score")
    return conf.score_metrics(rows).select("decoy", "peptides", F.round("mean_score", 6).alias("mean_score"), F.round("q95_score", 6).alias("q95_score"))


@query(f"WITH {_LABELLED} SELECT CASE WHEN score < 0 THEN 0 WHEN score >= 20000 THEN 101 ELSE floor(score / 200) + 1 END::BIGINT AS bin, count(*) AS n FROM l GROUP BY 1")
def score_histogram(spark, sf):
    return conf.histogram(_labelled(spark, sf), "Score", 0.0, 20000.0)


@query(f"WITH {_LABELLED}, b AS (SELECT lang || source AS target_pair, max_by(doc_id, (score, t::INT, doc_id)) AS d, max(score) AS s FROM l GROUP BY 1) SELECT target_pair, s AS best FROM b")
def best_per_pair(spark, sf):
    rows = _labelled(spark, sf).select(F.concat("lang", "source").alias("target_pair"), "is_target", "Score")
    return conf.best_per_pair(rows, "Score").select("target_pair", F.col("Score").alias("best"))


@query()
def svm_rescore(spark, sf):
    """Rows only: a fitted model. Documents as matches, labels as target and decoy."""
    rows = _labelled(spark, sf).select(F.col("doc_id").cast("string").alias("peptide"), F.col("doc_id").cast("string").alias("target_pair"), "is_target", "Score", F.log1p("Score").alias("log_score"), F.col("source").alias("proteins"))
    return conf.brew(rows, 0.2).select("peptide", "is_target", "q_value")


@query()
def mf_impute(spark, sf):
    """Rows only: a fitted factorisation. Mean value per user and event type, every tenth cell hidden."""
    cells = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("peptide"), F.col("event_type").alias("run")).agg(F.avg("value").alias("value"))
    hidden = cells.withColumn("value", F.when(F.pmod(F.xxhash64("peptide", "run"), F.lit(10)) != 0, F.col("value")))
    return impute.impute(hidden, "value", rank=2).select("peptide", "run", "imputed")


# ---- graphs ---------------------------------------------------------------------------------------------------------


def _edges(spark, sf, kind):
    return table(spark, sf, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("left"), F.floor("value").alias("right")).distinct()


_EDGE = "SELECT DISTINCT user_id AS \"left\", floor(value)::BIGINT AS \"right\" FROM events WHERE event_type = '{}'"


@query(f"({_EDGE.format('view')}) INTERSECT ({_EDGE.format('click')})")
def graph_edges_intersect(spark, sf):
    return graph.common_edges(_edges(spark, sf, "view"), _edges(spark, sf, "click"))


@query(f"WITH e AS ({_EDGE.format('view')}) SELECT DISTINCT 'left' AS side, \"left\" AS node FROM e UNION SELECT DISTINCT 'right', \"right\" FROM e")
def graph_endpoints(spark, sf):
    return graph.endpoints(_edges(spark, sf, "view"))


@query(f"WITH e AS ({_EDGE.format('view')}) SELECT \"left\", count(*) AS n, min(\"right\") AS low, max(\"right\") AS high FROM e GROUP BY 1")
def graph_adjacency(spark, sf):
    made = graph.adjacency(_edges(spark, sf, "view"))
    return made.select("left", F.size("neighbours").cast("long").alias("n"), F.element_at("neighbours", 1).alias("low"), F.element_at("neighbours", -1).alias("high"))


from ionweave import operator_queries  # noqa: E402, F401  registers more queries here
