"""Index, spectrum search, window search, sources and plans, end to end on small inputs."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sample_data import ALBUMIN, SAMPLE_PEAKS, SAMPLE_PRECURSOR
from ionweave import schema
from ionweave.config import IndexConfig, SearchConfig
from ionweave.functions import peptide as pep
from ionweave.operators.peptide_index import PeptideIndex, cached_index, file_md5
from ionweave.operators.scoring import hyperscore, label_decoys
from ionweave.plans import aggregate_runs as agg
from ionweave.plans import window_search as ws
from ionweave.plans.spectrum_search import explode_peaks, spectrum_search
from ionweave.schema import FRAGMENTS, SEQUENCES
from ionweave.sources import sinks, spectra
from ionweave.sources.fasta import read_fasta
from ionweave.sources.mzml import MzmlSource, dda_spectra, read_mzml


@pytest.fixture(scope="module")
def index(spark, albumin):
    made = PeptideIndex.from_proteins(albumin, SearchConfig())
    made.seqs.cache(), made.frags.cache()
    return made


def as_spectrum(spark, peaks, precursor, spec_id=1):
    rows = [(spec_id, precursor, [(float(m), float(i)) for m, i in peaks])]
    return spark.createDataFrame(rows, "spec_id long, prec_mz double, peaks array<struct<mz:double,intensity:double>>")


def test_config_round_trip():
    config = SearchConfig(g_tolerances=(10.0, 15.0), window_subset=None)
    assert SearchConfig.from_toml(config.to_toml()) == config
    assert config.hash() != SearchConfig().hash() and config.index_config.hash() == IndexConfig().hash()
    with pytest.raises(ValueError, match="unknown"):
        SearchConfig.from_toml("nothing = 1")


def test_interface(spark):
    class Frame(schema.TableInterface):
        required_columns = [("foo", schema.T.FloatType()), ("bar", schema.T.StringType())]

    Frame(spark.createDataFrame([(1.0, "a", 1)], "foo double, bar string, more int"))
    with pytest.raises(ValueError, match="wrong data type: foo"):
        Frame(spark.createDataFrame([("1", "a")], "foo string, bar string"))
    with pytest.raises(ValueError, match="missing columns: foo"):
        Frame(spark.createDataFrame([("a",)], "bar string"))


def test_index_tables(spark, index, tmp_path):
    assert [f.name for f in index.seqs.schema] == SEQUENCES.names and [f.name for f in index.frags.schema] == FRAGMENTS.names
    n = index.seqs.count()
    assert 20 < n < 2000 and index.targets.count() == 248
    assert index.frags.count() > 2000 and dict(index.frags.dtypes)["mz"] == "double"
    assert index.seqs.select("seq_id").distinct().count() == n
    assert index.seqs.groupBy("seq_proforma").count().where("count > 1").count() == 0
    index.write(str(tmp_path / "i"))
    back = PeptideIndex.read_range(spark, str(tmp_path / "i"), 500.0, 600.0, index.config)
    assert back.frags.count() == index.frags.where("precursor_mz >= 500 and precursor_mz < 600").count() > 0
    assert back.seqs.count() == index.seqs.where("seq_mz >= 500 and seq_mz < 600").count()
    plan = back.frags._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(precursor_bin" in plan and "GreaterThanOrEqual(precursor_mz,500.0)" in plan
    whole = PeptideIndex.read(spark, str(tmp_path / "i"), index.config)
    assert whole.frags.agg(F.min("mz")).first()[0] > 250
    assert index.between(500, 600).seqs.count() > 0


def test_sample_spectrum_finds_its_peptide(spark, index):
    found = spectrum_search(as_spectrum(spark, SAMPLE_PEAKS, SAMPLE_PRECURSOR), index, SearchConfig())
    hits = {r["peptide"]: r for r in found.collect()}
    assert not hits["VPQVSTPTLVEVSR/2"]["decoy"] and hits["VPQVSTPTLVEVSR/2"]["rank"] == 1
    best = hits["VPQVSTPTLVEVSR/2"]
    assert best["Score"] == pytest.approx(np.log1p(best["b_intensity"]) + np.log1p(best["y_intensity"]) + best["b_npeaks"] + best["y_npeaks"])
    assert max(best["mass_errors"]) <= 20 * 1500 / 1e6 and len(best["mzs"]) == best["b_npeaks"] + best["y_npeaks"]


def test_every_peptide_finds_itself(spark, index):
    own = index.frags.join(index.targets, "seq_id")
    peaks = own.groupBy(F.col("seq_id").alias("spec_id"), (F.col("seq_mz") - 10).alias("prec_low"), (F.col("seq_mz") + 10).alias("prec_high")).agg(F.collect_list(F.struct("mz", F.lit(1.0).alias("intensity"))).alias("peaks"))
    top = hyperscore(explode_peaks(peaks, SearchConfig()), index, 20.0, "ppm", top_n=2)
    recalled = top.where("spec_id = seq_id").select("spec_id").distinct().count()
    searched = peaks.where(F.size("peaks") > 3).count()
    assert recalled == searched == index.targets.count()


@pytest.mark.parametrize("tol,unit", [(0.3, "da"), (300.0, "ppm")])
def test_candidates_equal_all_pairs(spark, tol, unit):
    """Spectra of windows over several bins; sequences, not fragments or matched peaks, are shuffled."""
    rng, config = np.random.default_rng(8), IndexConfig(precursor_charges=(2,), ion_charges=(1, 2))
    words = ["".join(rng.choice(list("ACDEGKLMNPRSTVWY"), rng.integers(7, 16))) for _ in range(150)]
    plain = PeptideIndex.from_peptides(spark.createDataFrame([(w,) for w in words], "peptide string"), config)
    frags, mz = plain.frags.toPandas(), plain.seqs.toPandas().set_index("seq_id")
    peaks = [(int(s), p, float(m), float(rng.integers(1, 9)), 395.0 + 60 * s, 480.0 + 75 * s) for s in range(6) for p, m in enumerate(rng.choice(frags["mz"], 80) + rng.uniform(-0.2, 0.2, 80))]
    expected = {}
    for s, p, m, i, low, high in peaks:
        half = tol if unit == "da" else tol * m / 1e6
        for f in frags[(np.abs(frags["mz"] - m) <= half) & frags["precursor_mz"].between(low, high)].itertuples():
            expected.setdefault((s, f.seq_id), []).append((f.ion_series, p, i))
    top = hyperscore(spark.createDataFrame(peaks, "spec_id long, peak_id long, spec_mz double, spec_int double, prec_low double, prec_high double"), plain, tol, unit, top_n=1000)
    rows = {(r["spec_id"], r["seq_id"]): r for r in top.collect()}
    expected = {k: v for k, v in expected.items() if len(v) > 3}
    assert set(rows) == set(expected) and len(rows) > 10
    for k, v in expected.items():
        r = rows[k]
        assert r["spec_indices"] == sorted(p for _, p, _ in v) and r["b_npeaks"] == sum(ion == "b" for ion, _, _ in v)
        assert r["y_intensity"] == pytest.approx(sum(i for ion, _, i in v if ion == "y")) and r["peptide"] == mz.loc[k[1], "seq_proforma"]
        assert r["med_abs_dm"] == pytest.approx(np.median(r["mass_errors"])) and r["PrecursorMZ"] == mz.loc[k[1], "seq_mz"]
    assert "ion_series" not in top._jdf.queryExecution().executedPlan().toString()


def test_no_match_is_an_empty_table(spark, index):
    assert spectrum_search(as_spectrum(spark, [(1.0, 1.0)], 500.0), index, SearchConfig()).count() == 0


def test_decoy_labels(spark):
    psms = spark.createDataFrame([("A",), ("B",)], "peptide string")
    got = {r["peptide"]: r["decoy"] for r in label_decoys(psms, spark.createDataFrame([("A",)], "peptide string")).collect()}
    assert got == {"A": False, "B": True}


def simulated_run(spark, peptides, low=600.0, high=800.0, scans=120, ims=False):
    """MS2 spectra of one wide window in which each peptide elutes as a Gaussian of its theoretical fragments."""
    rng = np.random.default_rng(2)
    masses = pep.residue_masses()
    held = [([], [], []) for _ in range(scans)]
    for k, p in enumerate(peptides):
        b = np.cumsum([masses[c] for c in p])
        m = np.concatenate([b[:-1] + pep.PROTON, b[-1] - b[:-1] + pep.WATER + pep.PROTON])
        m = m[(m > 150) & (m < 1900)]
        height, centre = rng.uniform(2e3, 2e4, len(m)), 8 + k * (scans - 16) / max(1, len(peptides) - 1)
        for s in range(scans):
            level = height * np.exp(-((s - centre) ** 2) / 8)
            keep = level > 50
            held[s][0].extend(m[keep]), held[s][1].extend(level[keep]), held[s][2].extend(np.full(keep.sum(), 0.8 + 0.01 * (k % 5)))
    rows = []
    for s, (m, i, u) in enumerate(held):
        order = np.argsort(m)
        rows.append((float(s), low, high, *([float(np.asarray(x)[j]) for j in order] for x in (m, i)), [float(np.asarray(u)[j]) for j in order] if ims else None))
    return spark.createDataFrame(rows, schema.SPECTRA)


#: Precursors of these lie between 600 and 800 for charge 2.
ELUTING = ["VPQVSTPTLVEVSR", "LGEYGFQNALIVR", "HLVDEPQNLIK", "DAFLGSFLYEYSR", "TVMENFVAFVDK"]


@pytest.mark.parametrize("ims", [False, True])
def test_window_search_recalls_simulated_peptides(spark, index, ims):
    inside = [p for p in ELUTING if p in ALBUMIN]
    run = simulated_run(spark, inside, ims=ims)
    psms = ws.window_search(run, index, SearchConfig(), ims=ims)
    assert [f.name for f in psms.schema] == schema.psm_schema("by", ims).names
    rows = psms.collect()
    found = {r["peptide"].split("/")[0] for r in rows}
    assert set(inside) <= found
    best = {}
    for r in rows:
        best[r["peptide"]] = max(best.get(r["peptide"], 0), r["Score"])
    assert np.mean([best[p + "/2"] for p in inside]) > 15
    assert ws.window_search(run.where("rt_values < 0"), index, SearchConfig(), ims=ims).count() == 0


def test_window_search_shuffles_sequences(spark, index):
    run = simulated_run(spark, [p for p in ELUTING if p in ALBUMIN])
    psms = ws.window_search(run, index, SearchConfig())
    bare = ws.window_search(run, PeptideIndex(index.seqs, index.frags, index.config), SearchConfig())
    assert sorted(map(str, psms.collect())) == sorted(map(str, bare.collect())) and psms.count() > 0
    assert "ion_series" not in psms._jdf.queryExecution().executedPlan().toString()


def test_relational_stack_equals_the_kernel(spark, index):
    from ionweave.plans.feature_stack import stack_features

    run = simulated_run(spark, [p for p in ELUTING if p in ALBUMIN])
    groups = spectra.scan_groups(run)
    rows = groups.orderBy("scan").collect()
    state = ws.WindowState(np.arange(len(rows)), *([np.array([p[c] for p in r["peaks"]]) for r in rows] for c in ("mz", "intensity")), None, SearchConfig())
    feature = state.stack(int(state.heights.argmax()))
    got = sorted(stack_features(groups, SearchConfig()).collect(), key=lambda r: r["centre_mz"])
    assert [r["centre_mz"] for r in got] == feature.mz.tolist() and [r["is_ref"] for r in got].index(True) == feature.ref
    assert np.allclose([r["correlation"] for r in got], feature.correlations) and np.allclose([r["trace"] for r in got], feature.traces)
    assert index.fragments_between(300, 400).agg(F.max("mz")).first()[0] <= 400


def test_frames_at_the_ends():
    assert [ws.frame(*x) for x in ((4, 3, 7), (1, 3, 7), (6, 3, 7), (0, 21, 5))] == [(3, 6, 1), (0, 3, 1), (4, 7, 2), (0, 5, 0)]
    x = np.stack([np.cos(0.1 * k + np.arange(20) / 20) for k in range(10)])
    assert [round(float(v), 4) for v in ws.trace_correlations(x, 5)] == [0.9208, 0.9318, 0.9442, 0.9588, 0.9767, 0.9991, 0.967, 0.9089, 0.7494, 0.5828]


def encoded(values, kind):
    return base64.b64encode(zlib.compress(np.array(values, dtype="<f8").tobytes())).decode() if kind else ""


def mzml_text(rows):
    cv = lambda a, v="": f'<cvParam accession="{a}" value="{v}" unitName="second"/>'
    body = ""
    for k, (level, rt, bounds, mz, intensity) in enumerate(rows):
        iso = f"<precursorList><precursor><isolationWindow>{cv('MS:1000827', sum(bounds) / 2)}{cv('MS:1000828', (bounds[1] - bounds[0]) / 2)}{cv('MS:1000829', (bounds[1] - bounds[0]) / 2)}</isolationWindow></precursor></precursorList>" if bounds else ""
        arrays = "".join(f"<binaryDataArray>{cv('MS:1000523')}{cv('MS:1000574')}{cv(a)}<binary>{encoded(v, 1)}</binary></binaryDataArray>" for a, v in (("MS:1000514", mz), ("MS:1000515", intensity)))
        body += f'<spectrum index="{k}">{cv("MS:1000511", level)}<scanList><scan>{cv("MS:1000016", rt)}</scan></scanList>{iso}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'
    return f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{body}</spectrumList></run></mzML>'


@pytest.fixture()
def mzml(tmp_path):
    mz = [100.0 + k for k in range(20)]
    rows = [(1, 1.0, None, mz, [float(k) for k in range(20)]), (2, 2.0, (105.0, 107.0), mz, [float(k) for k in range(20)]), (2, 3.0, (110.0, 112.0), mz[:5], [1.0] * 5)]
    path = tmp_path / "small.mzML"
    path.write_text(mzml_text(rows))
    return str(path)


def test_mzml_reader(spark, mzml):
    rows = read_mzml(spark, mzml).orderBy("spectrum_index").collect()
    assert [r["ms_level"] for r in rows] == [1, 2]
    assert (rows[0]["quad_low_mz_values"], rows[1]["quad_low_mz_values"], rows[1]["quad_high_mz_values"]) == (-1, 105, 107)
    spark.dataSource.register(MzmlSource)
    assert spark.read.format("mzml").load(mzml).count() == 3
    dda = dda_spectra(read_mzml(spark, mzml), keep=3).collect()
    assert len(dda) == 1 and [p["mz"] for p in dda[0]["peaks"]] == [119, 118, 117] and dda[0]["prec_mz"] == 106


def test_scan_groups(spark, mzml, tmp_path):
    raw = spectra.read_raw_data(spark, mzml)
    spectra.write_flat(raw, str(tmp_path / "flat.parquet"))
    raw = spectra.read_raw_data(spark, str(tmp_path / "flat.parquet"))
    windows = spectra.isolation_windows(raw)
    assert windows.count() == 1 and spectra.isolation_windows(raw, (5, 6)).count() == 0
    group = spectra.scan_groups(raw).first()
    assert [p["mz"] for p in group["peaks"] if 104 < p["mz"] < 108] == [] and group["base_peak"]["mz"] == 119
    ms1 = spectra.precursor_groups(raw, windows)
    assert [p["mz"] for p in ms1.first()["peaks"]] == [105, 106, 107]
    spectra.write_groups(spectra.scan_groups(raw), str(tmp_path / "groups"))
    assert spectra.read_groups(spark, str(tmp_path / "groups")).first()["base_peak"]["mz"] == 119
    psms = spark.createDataFrame([(1, group["window"], 0.5, 106.0), (2, group["window"], 9.0, 106.0), (3, group["window"], 0.5, 300.0)], "psm_id long, window string, rt double, mz double")
    got = {r["psm_id"]: r["evidence"] for r in spectra.precursor_evidence(psms, ms1, 0.1, "da").collect()}
    assert got == {1: 6.0, 2: 6.0, 3: 0.0}
    for bad in ("run.d", "run.txt"):
        with pytest.raises(NotImplementedError):
            spectra.read_raw_data(spark, bad)


def test_fasta_and_cached_index(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(f"    > sp|KID1|KID1_HUMAN\n    LESLIEKAAAAAR\n    > sp|KID3|KID3_HUMAN\n    EDITHK\n    AAAAAR\n>plain\n{ALBUMIN}\n")
    rows = {r["accession"]: r["sequence"] for r in read_fasta(spark, str(path)).collect()}
    assert rows == {"KID1": "LESLIEKAAAAAR", "KID3": "EDITHKAAAAAR", "plain": ALBUMIN}
    first = cached_index(spark, str(path), SearchConfig(), str(tmp_path / "cache")).seqs.count()
    assert cached_index(spark, str(path), SearchConfig(), str(tmp_path / "cache")).seqs.count() == first > 200
    assert len(list((tmp_path / "cache").iterdir())) == 1 and len(file_md5(str(path))) == 32


def test_modified_peptides_and_collisions(spark):
    config = IndexConfig(peptide_mz_range=(1.0, 5000.0), precursor_charges=(1,))
    made = PeptideIndex.from_peptides(spark.createDataFrame([("LES[+79.9]LIEK",), ("AGAGA",)], "peptide string"), config, modified=True)
    rows = {r["seq_proforma"]: r["decoy"] for r in made.seqs.collect()}
    assert rows == {"LES[+79.9]LIEK/1": False, "LEILS[+79.9]EK/1": True, "AGAGA/1": False}


@pytest.mark.parametrize("keep", [False, True])
def test_decoys_meet_their_targets_in_one_row(spark, keep):
    from ionweave.operators.peptide_index import with_decoys

    targets = ["ABCK", "ACBK", "AK", "AAAA", "PEPTIDEK", "*LESK", "LSEK", "P[+1.0]QRK", "ABCK"]
    held = spark.createDataFrame([(t,) for t in targets], "peptide string")
    turned = dict(held.select("peptide", pep.reverse_interior(F.col("peptide"))).collect())
    expected = {(t, False, "target") for t in targets} | {(d, True, "decoy") for d in turned.values() if d not in targets}
    expected |= {(d, False, "collision") for d in turned.values() if d in targets and keep}
    made = with_decoys(held, IndexConfig(keep_colliding_decoys=keep))
    assert sorted(map(tuple, made.collect())) == sorted(expected)


def test_written_index_holds_sequences(spark, index, tmp_path):
    index.write(str(tmp_path / "i"))
    assert {f.name for f in (tmp_path / "i").iterdir()} == {"peptides.parquet"}
    back = PeptideIndex.read(spark, str(tmp_path / "i"), SearchConfig(ion_mz_range=(300.0, 900.0)))
    assert sorted(map(tuple, back.frags.collect())) == sorted(map(tuple, index.frags.where("mz > 300 and mz < 900").select(*FRAGMENTS.names).collect()))
    plan = PeptideIndex(index.seqs, index.frags, index.config)
    assert plan.ladders(plan.sequences()).count() == index.frags.count()


def test_large_sources_are_several_files(spark):
    from ionweave.operator_queries import _fasta, _mzml

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as tables of some size are dealt
    try:
        paths = [made(spark, "/root/testdata/sf0.001") for made in (_fasta, _mzml)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(spark.read.format("binaryFile").load(path).count() > 1 for path in paths)


def test_sinks(spark, tmp_path, index):
    psms = spectrum_search(as_spectrum(spark, SAMPLE_PEAKS, SAMPLE_PRECURSOR), index, SearchConfig())
    paths = sinks.write_search(psms, str(tmp_path / "out"), "dda")
    assert [p.rpartition("/")[2] for p in paths] == ["out.search.dda.parquet", "out.search.dda.csv"]
    row = spark.read.csv(paths[1], header=True).first()
    assert isinstance(json.loads(row["mzs"]), list)


def test_runs_together(spark, tmp_path):
    rng = np.random.default_rng(4)
    def run(seed):
        r = np.random.default_rng(seed)
        return spark.createDataFrame([(f"P{i}", f"P{i}", True, float(r.normal(8)), float(i + 0.1 * seed), "x") for i in range(40) if r.random() < 0.9] + [(f"D{i}", f"D{i}", False, float(r.normal(2)), float(i), "x") for i in range(20)], "peptide string, target_pair string, is_target boolean, Score double, RetentionTime double, proteins string")
    peptides, proteins = agg.aggregate_runs({"one": run(1), "two": run(2), "three": run(3)}, 0.05)
    assert {"RetentionTime_one", "RetentionTime_two", "RetentionTime_three"} <= set(peptides.columns)
    rows = peptides.collect()
    assert len(rows) >= 35 and all(r["RetentionTime_one"] is not None for r in rows)
    agg.save(peptides, proteins, str(tmp_path))
    with pytest.raises(Exception, match="already exists"):
        agg.save(peptides, proteins, str(tmp_path))
    with pytest.raises(ValueError):
        agg.aggregate_runs({"one": run(1)})


def test_streamed_search(spark, tmp_path, index):
    from ionweave.streaming.acquisition import search_stream

    first = as_spectrum(spark, SAMPLE_PEAKS, SAMPLE_PRECURSOR)
    first.write.parquet(str(tmp_path / "in"))
    search_stream(spark, str(tmp_path / "in"), first.schema, index, SearchConfig(), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True).awaitTermination()
    assert "VPQVSTPTLVEVSR/2" in {r["peptide"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
