"""Golden vectors of the scalar and array functions."""

import math

import pytest
from pyspark.sql import functions as F

from ionweave.functions import peaks as pk
from ionweave.functions import peptide as pep
from ionweave.functions import traces as tr
from ionweave.functions.mass import ppm_to_da


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_ppm():
    assert ppm_to_da(500.0, 20) == pytest.approx(0.01)


def test_similarities(spark):
    x, y = arr(1, 2, 3), arr(1.1, 2.2, 2.9)
    assert round(value(spark, tr.cosine_similarity(x, y)), 6) == 0.998016
    assert round(value(spark, tr.spectral_angle(x, y)), 6) == 0.959892
    sin, cos = arr(*(math.sin(i / 30) for i in range(200))), arr(*(math.cos(i / 30) for i in range(200)))
    assert round(value(spark, tr.cosine_similarity(sin, cos)), 6) == 0.019283
    assert round(value(spark, tr.spectral_angle(sin, cos)), 6) == 0.012276


def test_rolling_maximum_and_half_height(spark):
    assert value(spark, tr.rolling_max(arr(1, 2, 3, 4, 5, 6, 7, 8), 3)) == [3, 4, 5, 6, 7, 8]
    assert value(spark, tr.rolling_max(arr(1, 2), 3)) == []
    assert value(spark, tr.points_over_half(arr(1, 5, 9, 5, 1))) == 3


def test_reference_trace_correlation(spark):
    rows = [(k, [math.cos(0.1 * k + i / 20) for i in range(20)]) for k in range(10)]
    df = spark.createDataFrame(rows, "k int, x array<double>").select("k", tr.smoothed_unit(F.col("x")).alias("u"))
    top = df.agg(F.max(F.array_max("u")).alias("top")).first()["top"]
    ref = df.where("k = 5").select(F.col("u").alias("r"))
    got = df.crossJoin(ref).select("k", tr.spectral_angle(F.col("u"), F.col("r"), x_max=F.lit(top)).alias("c")).orderBy("k").collect()
    assert [round(r["c"], 4) for r in got] == [0.9208, 0.9318, 0.9442, 0.9588, 0.9767, 0.9991, 0.967, 0.9089, 0.7494, 0.5828]


@pytest.mark.parametrize("sequence,turned", [("LESLIEK", "LEILSEK"), ("LES[+79.9]LIEK", "LEILS[+79.9]EK"), ("LILS[+79.9]EE/3", "LES[+79.9]LIE/3"), ("AK", "AK"), ("A", "A")])
def test_decoys(spark, sequence, turned):
    assert value(spark, pep.reverse_interior(F.lit(sequence))) == turned
    assert value(spark, pep.reverse_interior(F.lit(turned))) == sequence


def test_permutation(spark):
    assert value(spark, pep.undo_permutation(F.lit("S[+79.9]LELIEK"), [2, 0, 1, 3, 4, 5, 6])) == "LES[+79.9]LIEK"


def test_proforma_cleaning(spark):
    assert value(spark, pep.strip_global_mods(F.lit("<[UNIMOD:4]@T>EDITH/2"))) == "EDITH/2"
    assert value(spark, pep.strip_mods(F.lit("LES[+79.9]LIE/3"))) == "LESLIE"


def test_masses_and_ladder(spark):
    masses = pep.token_masses(F.lit("VPQVSTPTLVEVSR"))
    assert value(spark, pep.peptide_mz(masses, F.lit(2))) == pytest.approx(756.42503, abs=1e-4)
    steps = {(s["ion_series"], s["ion_position"], s["charge"]): s["mz"] for s in value(spark, pep.ladder(masses, "by", (1, 2)))}
    for key, mz in {("b", 2, 1): 197.12845, ("b", 3, 1): 325.18703, ("y", 1, 1): 175.11895, ("y", 2, 1): 262.15098, ("y", 13, 1): 1412.77437}.items():
        assert steps[key] == pytest.approx(mz, abs=1e-3)
    assert len(steps) == 2 * 2 * 13
    assert value(spark, pep.total(pep.token_masses(F.lit("C[UNIMOD:4]M[+15.99491]"), modified=True))) == pytest.approx(103.00919 + 57.02146 + 131.04049 + 15.99491)


def test_digest_counts(spark, albumin):
    made = albumin.select(F.explode(pep.digest(F.col("sequence"), "[KR]", 2, (7, 25))).alias("p")).distinct()
    assert made.count() == 175
    assert value(spark, pep.digest(F.lit("AAKCCRDD"), "[KR]", 1, (1, 9))) == ["AAK", "CCR", "DD", "AAKCCR", "CCRDD"]
    assert value(spark, pep.digest(F.lit(""), "[KR]", 2, (1, 9))) == []


def peaks(*pairs):
    return F.array(*(F.struct(F.lit(float(m)).alias("mz"), F.lit(float(i)).alias("intensity")) for m, i in pairs))


def test_peak_filters(spark):
    p = peaks((100, 1), (200, 9), (300, 4), (400, 9))
    mz = lambda c: [x["mz"] for x in value(spark, c)]
    assert mz(pk.keep_between(p, 200, 300)) == [200, 300]
    assert mz(pk.keep_outside(p, 200, 300)) == [100, 400]
    assert mz(pk.keep_ratio(p, 0.4)) == [200, 300, 400]
    assert mz(pk.top_peaks(p, 3)) == [200, 400, 300]
    assert value(spark, pk.base_peak(p)).asDict() == {"intensity": 9.0, "mz": 200.0}
    assert value(spark, pk.base_peak(F.filter(p, lambda x: F.lit(False)))) is None


def test_sorted_arrays(spark):
    assert value(spark, pk.is_sorted(arr(1, 2, 2, 3))) and not value(spark, pk.is_sorted(arr(2, 1)))
    assert value(spark, pk.is_sorted(F.array().cast("array<double>")))
    assert value(spark, pk.slice_between(arr(1, 2, 3, 4), 2, 3)) == [2, 3]
    assert value(spark, pk.slice_between(arr(1, 2, 3, 4), 2, 3, slack=True)) == [1, 2, 3]
    assert value(spark, pk.sorted_union(arr(3, 1), arr(2, 1))) == [1, 2, 3]


def test_unequal_peak_arrays_raise(spark):
    with pytest.raises(Exception, match="different lengths"):
        value(spark, pk.zipped(arr(1, 2), arr(1)))
