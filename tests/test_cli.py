"""The command line from files to files."""

import numpy as np
import pytest
from sample_data import ALBUMIN, SAMPLE_PEAKS, SAMPLE_PRECURSOR

from ionweave import cli
from ionweave.config import SearchConfig
from ionweave.functions import peptide as pep
from test_search import mzml_text


@pytest.fixture()
def fasta(tmp_path):
    path = tmp_path / "albumin.fasta"
    path.write_text(f">sp|P02769|ALBU\n{ALBUMIN}\n")
    return str(path)


def test_spectrum_search_from_files(spark, tmp_path, fasta):
    mz, intensity = zip(*sorted(SAMPLE_PEAKS))
    half = SAMPLE_PRECURSOR * 1e-6
    run = tmp_path / "run.mzML"
    run.write_text(mzml_text([(2, 5.0, (SAMPLE_PRECURSOR - half, SAMPLE_PRECURSOR + half), list(mz), list(intensity))]))
    paths = cli.search(spark, str(run), fasta, str(tmp_path / "out"), "dda", SearchConfig(), str(tmp_path / "cache"))
    assert "VPQVSTPTLVEVSR/2" in {r["peptide"] for r in spark.read.parquet(paths[0]).collect()}


def test_window_search_from_files(spark, tmp_path, fasta):
    masses, rows = pep.residue_masses(), []
    b = np.cumsum([masses[c] for c in "VPQVSTPTLVEVSR"])
    mz = np.sort(np.r_[b[:-1] + pep.PROTON, b[-1] - b[:-1] + pep.WATER + pep.PROTON])
    mz = mz[(mz > 150) & (mz < 1900)]
    for scan in range(40):
        rows.append((2, float(scan), (700.0, 800.0), mz.tolist(), (1e4 * np.linspace(1, 2, len(mz)) * np.exp(-((scan - 20) ** 2) / 8) + 1).tolist()))
    run = tmp_path / "run.mzML"
    run.write_text(mzml_text(rows))
    paths = cli.search(spark, str(run), fasta, str(tmp_path / "out"), "dia", SearchConfig(), str(tmp_path / "cache"))
    assert "VPQVSTPTLVEVSR/2" in {r["peptide"] for r in spark.read.parquet(paths[0]).collect()}


def test_arguments(tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["search", "--fasta", "x"])
    with pytest.raises(SystemExit):
        cli.main(["search", "--data_path", "a", "--fasta", "b", "--mode", "other"])
