"""mzML as a Spark data source: spark.read.format("mzml").load(path).

One row per spectrum, in the flattened layout of ionweave.schema.SPECTRA plus ms_level and spectrum_index. A file is one
partition; its XML is read as a stream, so memory holds one spectrum."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ionweave.schema import SPECTRA

# Terms of the published PSI-MS vocabulary.
TERMS = {"MS:1000511": "ms_level", "MS:1000016": "rt", "MS:1000827": "target", "MS:1000828": "low", "MS:1000829": "high", "MS:1000514": "mz", "MS:1000515": "intensity", "MS:1002476": "mobility_value", "MS:1002815": "mobility_value", "MS:1003006": "mobility", "MS:1003007": "mobility", "MS:1000521": "f4", "MS:1000523": "f8", "MS:1000574": "zlib"}
SCHEMA = T.StructType([T.StructField("spectrum_index", T.IntegerType()), T.StructField("ms_level", T.IntegerType()), *SPECTRA])
MIN_PEAKS = 15


def _array(node) -> tuple[str | None, list[float]]:
    kinds = {TERMS[c.get("accession")] for c in node.iter() if c.get("accession") in TERMS}
    text = next((c.text for c in node if c.tag.endswith("}binary") or c.tag == "binary"), None)
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if "zlib" in kinds and raw else raw
    name = next((k for k in ("mz", "intensity", "mobility") if k in kinds), None)
    return name, np.frombuffer(raw, dtype="<f4" if "f4" in kinds else "<f8").astype(float).tolist()


def _row(node, index: int) -> tuple:
    """A row of SCHEMA from one spectrum element; index where the element has none."""
    level, rt, target, low, high, arrays = 1, None, None, 0.0, 0.0, {}
    for p in node.iter():
        tag, what = p.tag.rpartition("}")[2], TERMS.get(p.get("accession"))
        if tag == "binaryDataArray":
            name, values = _array(p)
            if name:
                arrays[name] = values
        elif what == "ms_level":
            level = int(p.get("value"))
        elif what == "rt":
            rt = float(p.get("value")) * (60.0 if p.get("unitName") == "minute" else 1.0)
        elif what in ("target", "low", "high"):
            value = float(p.get("value"))
            target, low, high = (value, low, high) if what == "target" else (target, value, high) if what == "low" else (target, low, value)
    bounds = (-1.0, -1.0) if target is None else (target - low, target + high)
    return (int(node.get("index", index)), level, rt, *bounds, arrays.get("mz", []), arrays.get("intensity", []), arrays.get("mobility"))


def parse_spectra(stream):
    """Rows of SCHEMA from an open mzML document."""
    index = 0
    for _, node in ElementTree.iterparse(stream):
        if node.tag.rpartition("}")[2] == "spectrum":
            yield _row(node, index)
            index += 1
            node.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class MzmlReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path.removeprefix("file://"), "rb") as f:
            yield from parse_spectra(f)


class MzmlSource(DataSource):
    """For files that every executor can open by path; read_mzml reads from any store that Spark reads."""

    @classmethod
    def name(cls):
        return "mzml"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        from glob import glob

        path = self.options["path"].removeprefix("file://")
        return MzmlReader(sorted(glob(path)) or [path])


def read_mzml(spark: SparkSession, path: str, min_peaks: int = MIN_PEAKS, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Spectra of at least min_peaks peaks, after `hook`, if given, has kept or changed rows of all spectra.

    Spark's own reader splits files at the ends of spectra, so a file of any size is read by many tasks, from any store
    that Spark reads; memory holds a batch of spectra."""
    end = "</spectrum>"

    def rows(frames):
        import pandas as pd

        for pdf in frames:
            parts = (v[v.find("<spectrum ") :] for v in pdf["value"] if "<spectrum " in v)
            block = [_row(ElementTree.fromstring(part + end), -1) for part in parts]
            if block:
                yield pd.DataFrame(block, columns=SCHEMA.names)

    found = spark.read.text(path, lineSep=end).mapInPandas(rows, SCHEMA)
    return (found if hook is None else hook(found)).where(F.size("mz_values") >= min_peaks)


def dda_spectra(spectra: DataFrame, min_peaks: int = MIN_PEAKS, keep: int = 150) -> DataFrame:
    """(spec_id, prec_mz, peaks): MS2 spectra of at least min_peaks peaks with their `keep` most intense ones."""
    from ionweave.functions.peaks import top_peaks, zipped

    ms2 = spectra.where((F.col("ms_level") == 2) & (F.size("mz_values") >= min_peaks))
    middle = (F.col("quad_low_mz_values") + F.col("quad_high_mz_values")) / 2
    return ms2.select(F.col("spectrum_index").cast("long").alias("spec_id"), middle.alias("prec_mz"), top_peaks(zipped(F.col("mz_values"), F.col("corrected_intensity_values")), keep).alias("peaks"))
