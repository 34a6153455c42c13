"""Search while a run is being written: each new file of spectra is scored against the index."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ionweave.config import SearchConfig
from ionweave.operators.peptide_index import PeptideIndex
from ionweave.plans.spectrum_search import spectrum_search


def search_stream(spark: SparkSession, folder: str, schema, index: PeptideIndex, config: SearchConfig, out: str, checkpoint: str, top_n: int = 10, available_now: bool = False) -> StreamingQuery:
    """Score spectra (spec_id, prec_mz, peaks) that arrive as Parquet files in folder; matches go to out/batch=<n>.

    A spectrum is scored within its micro-batch, so no state is kept. A batch that is run again after a failure
    overwrites its own folder: each spectrum's matches are there once."""

    def score(batch, number):
        spectrum_search(batch, index, config, top_n).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
