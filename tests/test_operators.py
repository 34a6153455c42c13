"""Joins, rankings, graphs, look-ups, confidence and imputation against small expectations or brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import band_join as bj
from ionweave.operators import confidence as conf
from ionweave.operators import graph, impute, ngram, numbering, ranking
from ionweave.operators.deisotope import absorb, deisotope, isotope_edges, mz_tolerance


def table(spark, values, a, b):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{a} int, {b} double")


@pytest.mark.parametrize("tol,unit", [(0.11, "da"), (0.5, "da"), (2000.0, "ppm"), (90000.0, "ppm")])
def test_band_join_is_the_theta_join(spark, tol, unit):
    rng = random.Random(7)
    x, y = [rng.uniform(1, 40) for _ in range(300)], [rng.uniform(1, 40) for _ in range(400)]
    got = bj.band_join(table(spark, x, "i", "l"), table(spark, y, "j", "r"), "l", "r", tol, unit).select("i", "j").collect()
    expected = [(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if abs(b - a) <= (tol if unit == "da" else tol * a / 1e6)]
    assert sorted(map(tuple, got)) == expected


def test_band_join_neighbours_and_nulls(spark):
    left = table(spark, [1, 2, 3, 4, 5, 15, 25], "i", "l")
    right = table(spark, [1.1, 2.3, 3.1, 4, 25, 25.1], "j", "r")
    pairs = bj.band_join(left.union(spark.createDataFrame([(9, None)], left.schema)), right, "l", "r", 0.11).select("i", "j")
    assert sorted(map(tuple, pairs.collect())) == [(0, 0), (2, 2), (3, 3), (6, 4), (6, 5)]
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_multidimensional_band_join(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(0, 20), rng.uniform(0, 5)) for i in range(200)]
    b = [(j, rng.uniform(0, 20), rng.uniform(0, 5)) for j in range(200)]
    left, right = spark.createDataFrame(a, "left int, lx double, ly double"), spark.createDataFrame(b, "right int, rx double, ry double")
    got = bj.band_join_multi(left, right, [("lx", "rx", -0.3, 0.5), ("ly", "ry", -1.0, 1.0)]).select("left", "right")
    expected = [(i, j) for i, x, y in a for j, u, v in b if -0.3 <= u - x < 0.5 and -1 <= v - y <= 1]
    assert sorted(map(tuple, got.collect())) == expected
    finder = graph.NeighborFinder({"x": (-1.0, 1.0), "y": (-2.0, 2.0)}, units={"x": "ppm"})
    one = spark.createDataFrame([(0, 2000.0, 1.0), (1, 2000.001, 1.5), (2, 2001.0, 1.0)], "id int, x double, y double")
    assert sorted(map(tuple, finder.find(one).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        graph.NeighborFinder({"x": (0, 1)}, order=("y",))


def test_range_join_and_next_at_or_after(spark):
    windows = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 20.0)], "w string, lo double, hi double")
    points = table(spark, [0, 9.99, 10, 20], "i", "v")
    assert sorted(map(tuple, bj.range_join(windows, points, "v", "lo", "hi", 4.0, closed=False).select("w", "i").collect())) == [("a", 0), ("a", 1), ("b", 2)]
    left = spark.createDataFrame([("g", 1.0), ("g", 3.5), ("g", 9.0), ("h", 1.0)], "k string, rt double")
    right = spark.createDataFrame([("g", 1.0, 10), ("g", 4.0, 11)], "k string, t double, scan int")
    got = bj.nearest_after(left, right, "rt", "t", ["scan"], "k")
    assert sorted(map(tuple, got.collect()), key=str) == [("g", 1.0, 10), ("g", 3.5, 11), ("g", 9.0, None), ("h", 1.0, None)]


def test_extracted_chromatogram(spark):
    peaks = spark.createDataFrame([("w", s, i, mz, v) for s, i, mz, v in [(0, 0, 100.0, 5.0), (0, 1, 100.01, 6.0), (1, 0, 200.0, 7.0)]], "window string, scan int, peak_index long, mz double, intensity double")
    centres = spark.createDataFrame([("w", 0, 100.0), ("w", 1, 200.0)], "window string, centre_id int, centre_mz double")
    got = {(r["scan"], r["centre_id"]): (r["intensity"], r["indices"]) for r in bj.extracted_chromatogram(peaks, centres, 0.02).collect()}
    assert got == {(0, 0): (11.0, [0, 1]), (0, 1): (0.0, []), (1, 0): (0.0, []), (1, 1): (7.0, [0])}


def test_rankings(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 9.0, 9.0, 1.0, 5.0])], "k string, i int, v double")
    assert sorted(r["i"] for r in ranking.top_with_ties(df, ["k"], "v", 1).collect()) == [1, 2]
    assert sorted(r["i"] for r in ranking.top_with_ties(df, ["k"], "v", 3).collect()) == [0, 1, 2, 4]
    assert ranking.best_row(df, ["k"], F.struct("v", -F.col("i"))).first()["i"] == 1
    assert [r["segment"] for r in ranking.gap_segments(df.withColumn("t", F.element_at(F.array(*map(F.lit, [1, 2, 9, 10, 30])), F.col("i") + 1)), ["k"], "t", 5).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    frames = spark.createDataFrame([(4, 7), (1, 7), (6, 7), (2, 3)], "c int, n int").select(*ranking.centred_frame(F.col("c"), F.col("n"), 3)).collect()
    assert [tuple(r) for r in frames] == [(3, 6), (0, 3), (4, 7), (0, 3)]
    assert [r["mz"] for r in ranking.mz_bins(df.withColumn("m", F.lit(2.5)), ["k"], "m", "v", 1.0).withColumnRenamed("m", "mz").collect()] == [2.0]


def test_dense_ids_have_no_gaps(spark):
    ids = numbering.dense_ids(spark.range(1000).select((F.col("id") * 7).alias("key")), "key", "n")
    assert sorted(r["n"] for r in ids.collect()) == list(range(1000))


def brute_q(rows):
    out = []
    for s, _ in rows:
        t = [sum(1 for x, y in rows if x >= cut and y) for cut in {x for x, _ in rows if x <= s}]
        d = [sum(1 for x, y in rows if x >= cut and not y) for cut in {x for x, _ in rows if x <= s}]
        out.append(min(min(1.0, (b + 1) / a) if a else 1.0 for a, b in zip(t, d)))
    return out


def test_q_values_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 60)) + 8 * t, bool(t)) for t in (rng.random() < 0.6 for _ in range(300))]
    got = conf.q_values(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s double, t boolean"), "s", "t").orderBy("i").collect()
    assert np.allclose([r["q_value"] for r in got], brute_q(rows))
    assert conf.q_values(spark.createDataFrame([], "s double, t boolean"), "s", "t").count() == 0


def test_prepared_psms(spark):
    psms = spark.createDataFrame([(1, "<[UNIMOD:4]@T>EDITH/2", [1], 5, False), (2, "<[UNIMOD:4]@T>EDITH/2", [1], 5, False), (1, "LES[+79.9]LIE/3", [1], 6, False), (1, "LILS[+79.9]EE/3", [1], 6, True), (1, "AAAR/2", [1], 4, False)], "rank int, peptide string, list_col array<int>, cool_npeaks int, decoy boolean")
    proteins = spark.createDataFrame([("KID1", "LESLIEKAAAAAR"), ("KID3", "EDITHKAAAAAR")], "accession string, sequence string")
    out = conf.prepare_psms(psms, proteins, "test")
    assert set(out.columns) == {"peptide", "cool_npeaks", "is_target", "filename", "target_pair", "peptide_length", "cool_npeaks_pct", "proteins"}
    got = sorted(tuple(r[c] for c in ("peptide", "is_target", "target_pair", "peptide_length", "cool_npeaks_pct", "proteins")) for r in out.collect())
    assert got == [("AAAR/2", True, "AAAR/2", 4, 100.0, "KID1;KID3"), ("EDITH/2", True, "EDITH/2", 5, 100.0, "KID3"), ("LES[+79.9]LIE/3", True, "LES[+79.9]LIE/3", 6, 100.0, "KID1"), ("LILS[+79.9]EE/3", False, "LES[+79.9]LIE/3", 6, 100.0, "KID1")]


def test_rescoring_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(f"P{i}", f"P{i}", bool(t), float(rng.normal(6 if t else 3)), float(rng.normal(3 if t else 0)), "x") for i, t in enumerate(rng.random(400) < 0.6)]
    made = conf.brew(spark.createDataFrame(rows, "peptide string, target_pair string, is_target boolean, Score double, other double, proteins string"), 0.2)
    accepted = made.where("q_value <= 0.05 and is_target").count()
    plain = conf.peptide_confidence(spark.createDataFrame(rows, "peptide string, target_pair string, is_target boolean, Score double, other double, proteins string")).where("q_value <= 0.05 and is_target").count()
    assert made.count() == 400 and accepted > plain
    assert conf.protein_confidence(made, "svm_score").count() == 1


def test_ngram_search(spark):
    proteins = spark.createDataFrame([("KID1", "LESLIEKAAAAAR"), ("KID3", "EDITHKAAAAAR")], "accession string, sequence string")
    peptides = spark.createDataFrame([("AAAR",), ("EDITHK",), ("WWWW",), ("AA",)], "peptide string")
    assert sorted(map(tuple, ngram.find_proteins(peptides, ngram.ngram_index(proteins), proteins).collect())) == [("AAAR", "KID1;KID3"), ("EDITHK", "KID3")]


def test_ngram_search_keeps_grams_in_their_tasks(spark):
    rng = random.Random(3)
    rows = [(f"P{i}", "".join(rng.choice("ACKé") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [("N", None)]
    asked = sorted({s[i : i + rng.randint(4, 9)] for _, s in rows[:40] for i in range(0, len(s), 5)} | {"K"})
    proteins = spark.createDataFrame(rows, "accession string, sequence string")
    found = ngram.find_proteins(spark.createDataFrame([(p,) for p in asked], "peptide string"), ngram.ngram_index(proteins), proteins)
    expected = {p: ";".join(sorted(a for a, s in rows if s and p in s)) for p in asked if len(p) >= 4}
    assert {r["peptide"]: r["proteins"] for r in found.collect()} == expected
    assert "ngram#" not in found._jdf.queryExecution().toString()  # no table of n-grams is shuffled


def test_graph_tables(spark):
    a = graph.edges_from_arrays(spark.createDataFrame([([1, 2, 2], [5, 6, 7])], "l array<int>, r array<int>"), "l", "r")
    b = graph.add_edges(a.where("left = 2"), spark.createDataFrame([(9, 9)], "left int, right int"))
    assert sorted(map(tuple, graph.common_edges(a, b).collect())) == [(2, 6), (2, 7)]
    assert sorted(map(tuple, graph.endpoints(a).collect())) == [("left", 1), ("left", 2), ("right", 5), ("right", 6), ("right", 7)]
    assert graph.adjacency(a).where("left = 2").first()["neighbours"] == [6, 7]


def test_deisotoping_golden():
    mz = np.array([800.9, 803.4080, 804.4108, 805.4106, 806.4116, 810.0, 812.0, 812.0 + 1.00335 / 2])
    keep, now, _ = absorb(mz, np.array([1, 4, 3, 2, 1, 1, 9, 4.5]), 2, mz_tolerance(mz, 5.0, "ppm"))
    assert mz[keep].tolist() == [800.9, 803.408, 810.0, 812.0] and now.tolist() == [1, 10, 1, 13.5]
    mz = np.array([800.9, 803.408, 804.4108, 805.4106])
    keep, now, held = absorb(mz, np.array([1, 0.9, 0.8, 0.7]), 2, mz_tolerance(mz, 5.0, "ppm"))
    assert held == [[0], [1, 2, 3]] and np.allclose(now, [1, 2.4])
    mz, ims = np.array([800.9, 803.408, 803.409, 804.4108, 804.4109, 805.4106]), np.array([0.7, 0.7, 0.8, 0.7, 0.8, 0.7])
    keep, now, held = absorb(mz, 1 - 0.1 * np.arange(6), 2, mz_tolerance(mz, 5.0, "ppm"), ims, 0.01)
    assert held == [[0], [1, 3, 5], [2, 4]] and np.allclose(now, [1, 2.1, 1.4])


def test_deisotoping_table(spark):
    df = spark.createDataFrame([("a", [803.408, 804.4108], [4.0, 3.0]), ("b", [], [])], "id string, mz array<double>, intensity array<double>")
    got = {r["id"]: (r["mz"], r["intensity"], r["indices"]) for r in deisotope(df, 2, 5.0, "ppm").collect()}
    assert got == {"a": ([803.408], [7.0], [[0, 1]]), "b": ([], [], [])}
    peaks = spark.createDataFrame([(1, 0, 803.408), (1, 1, 804.4108), (2, 0, 804.4108)], "spec_id int, peak_id int, mz double")
    assert sorted(map(tuple, isotope_edges(peaks, 2, 0.004).collect())) == [(1, 0, 1, 1)]
    with pytest.raises(NotImplementedError):
        deisotope(df, 2, 5.0, "percent")


def test_imputation_rebuilds_a_low_rank_matrix(spark):
    rng = np.random.default_rng(0)
    full = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12))
    hidden = rng.random(full.shape) < 0.1
    cells = spark.createDataFrame([(f"p{i}", f"r{j}", float("nan") if hidden[i, j] else float(full[i, j])) for i in range(60) for j in range(12)], "peptide string, run string, value double")
    made = impute.impute(cells, "value", rank=4, regularisation=1e-4, iterations=25)
    got = {(r["peptide"], r["run"]): (r["value"], r["imputed"]) for r in made.collect()}
    errors = [abs(got[f"p{i}", f"r{j}"][0] - full[i, j]) for i, j in zip(*np.nonzero(hidden))]
    assert len(got) == 720 and np.median(errors) < 0.05 * full.std()
    assert all(got[f"p{i}", f"r{j}"] == (full[i, j], False) for i, j in zip(*np.nonzero(~hidden)))
    best, errors = impute.search_rank(cells, "value", (1, 4), regularisation=1e-3)
    assert best == 4 and not any(np.isnan(list(errors.values())))


def test_factor_product(spark):
    left = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 3.0)], "row string, factor int, weight double")
    right = spark.createDataFrame([("x", 0, 5.0), ("x", 1, 7.0)], "run string, factor int, weight double")
    assert impute.factor_product(left, right).first()["value"] == 31.0


def test_factor_product_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(impute, "BLOCK", 7)
    rng = np.random.default_rng(5)
    cells = [[(k, int(f), None if rng.random() < 0.1 else float(rng.integers(-5, 6))) for k in range(20) for f in rng.choice(40, 3)] for _ in range(2)]
    expected = {}
    for r, f, a in cells[0]:
        for c, g, b in cells[1]:
            if f == g:
                held = expected.setdefault((r, c), [])
                held += [a * b] if a is not None and b is not None else []
    left, right = (spark.createDataFrame(x, f"{n} long, factor int, weight double") for x, n in zip(cells, ("row", "run")))
    made = impute.factor_product(left, right)
    assert {(r["row"], r["run"]): r["value"] for r in made.collect()} == {k: sum(v) if v else None for k, v in expected.items()}
    assert "hashpartitioning(factor" not in made._jdf.queryExecution().executedPlan().toString()


def test_look_ahead_takes_linear_time(spark):
    left = spark.range(300).select((F.col("id") * 1.5).alias("rt"), F.lit(1).alias("k"))
    right = spark.range(200).select((F.col("id") * 2.0).alias("t"), F.col("id").alias("scan"), F.lit(1).alias("k"))
    for key in ("k", None):
        got = bj.nearest_after(left, right, "rt", "t", ["scan"], key)
        assert all(r["scan"] == (-(-r["rt"] // 2) if r["rt"] <= 398 else None) for r in got.collect())
        plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
        assert key is None or "unboundedfollowing" not in plan


def test_seed_neighbours(spark):
    from ionweave.functions.peaks import file_stem, summary
    from ionweave.operators.seeds import seed_neighbours

    rng = random.Random(9)
    rows = [(1, i, rng.uniform(100, 103), rng.uniform(0.5, 0.7), rng.uniform(1, 100)) for i in range(80)]
    df = spark.createDataFrame(rows, "spec_id int, peak_id int, mz double, mobility double, intensity double")
    top = {r[1] for r in sorted(rows, key=lambda r: -r[4])[:16]}
    expected = {(i, i) for i in range(80)}
    for i in top:
        for j in range(80):
            if abs(rows[j][2] - rows[i][2]) <= 0.2 and abs(rows[j][3] - rows[i][3]) <= 0.02:
                expected |= {(i, j), (j, i)}
    assert {(r["left"], r["right"]) for r in seed_neighbours(df, 10, 0.2, 0.02, 0.2).collect()} == expected
    assert spark.range(1).select(file_stem(F.lit("/a/b.c/run.one.mzML"))).first()[0] == "run.one"
    assert tuple(df.agg(*summary("peak_id")).first()) == (0, 79, 80)


def test_fasta_marks_inside_headers(spark, tmp_path):
    from ionweave.sources.fasta import read_fasta

    path = tmp_path / "p.fasta"
    path.write_bytes(b">sp|P1|A_B Alpha-(1->3)-transferase OS=X\r\nMK\r\n WV\r\n>plain one\nACD\nEF\n\n  >sp|P2|C >> D\nGHI")
    rows = {r["accession"]: r for r in read_fasta(spark, str(path)).collect()}
    assert {a: r["sequence"] for a, r in rows.items()} == {"P1": "MKWV", "plain one": "ACDEF", "P2": "GHI"}
    assert rows["P1"]["description"] == "sp|P1|A_B Alpha-(1->3)-transferase OS=X"
