"""Protein FASTA files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accession in the header: what stands between the outermost bars (fixed pattern).
ACCESSION = r"^.*\|(.*)\|.*$"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, description, sequence): one row per record, however its lines wrap or are indented.

    Files are split at marks that begin a line, so a large file is read by many tasks, and a mark inside a header is part
    of it. A header without bars is its own accession."""
    parts = spark.read.text(path, lineSep="\n>").select(F.explode(F.split(F.regexp_replace("value", "\r", ""), r"(?:^|\n)[ \t]*>")).alias("value"))
    raw = parts.where(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    header = F.trim(F.substring_index("value", "\n", 1))
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    named = F.regexp_extract(header, ACCESSION, 1)
    return raw.select(F.when(named != "", F.trim(named)).otherwise(header).alias("accession"), header.alias("description"), F.upper(body).alias("sequence")).where(F.length("sequence") > 0)
