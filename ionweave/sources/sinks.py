"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays as JSON text: CSV has no nested types."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema))


def write_search(psms: DataFrame, prefix: str | None = None, mode: str = "dia", peptides: DataFrame | None = None) -> list[str]:
    """Write <prefix>.search[.dda].{csv,parquet} and <prefix>.search.peptides.parquet; returns the paths.
    The CSV is written from the Parquet file, so that the search runs once."""
    stem = f"{prefix or 'ionweave'}.search{'.dda' if mode == 'dda' else ''}"
    psms.write.mode("overwrite").parquet(f"{stem}.parquet")
    flat_for_csv(psms.sparkSession.read.parquet(f"{stem}.parquet")).write.mode("overwrite").csv(f"{stem}.csv", header=True)
    made = [f"{stem}.parquet", f"{stem}.csv"]
    if peptides is not None:
        peptides.write.mode("overwrite").parquet(f"{stem}.peptides.parquet")
        made.append(f"{stem}.peptides.parquet")
    return made
