"""Command line: python -m ionweave.cli search --data_path run.mzML --fasta proteins.fasta [...]"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from ionweave.config import SearchConfig
from ionweave.operators.confidence import brew, prepare_psms
from ionweave.operators.peptide_index import cached_index
from ionweave.plans.spectrum_search import spectrum_search
from ionweave.plans.window_search import window_search
from ionweave.sources.fasta import read_fasta
from ionweave.sources.mzml import dda_spectra, read_mzml
from ionweave.sources.sinks import write_search
from ionweave.sources.spectra import read_raw_data

log = logging.getLogger("ionweave")


def setup_logging(file: str | None = None) -> None:
    handlers = [logging.StreamHandler(sys.stderr)] + ([logging.FileHandler(file)] if file else [])
    logging.basicConfig(level=logging.INFO, handlers=handlers, format="%(asctime)s %(levelname)s %(message)s")


def search(spark: SparkSession, data_path: str, fasta: str, out_prefix: str | None, mode: str, config: SearchConfig, cache: str) -> list[str]:
    """Search one run and write its results; peptides with q-values where there are targets and decoys."""
    index = cached_index(spark, fasta, config, cache)
    if mode == "dda":
        return write_search(spectrum_search(dda_spectra(read_mzml(spark, data_path)), index, config), out_prefix, "dda")
    spectra = read_raw_data(spark, data_path)
    psms = window_search(spectra, index, config, ims=bool(spectra.where("mobility_values is not null").take(1)))
    paths = write_search(psms, out_prefix)
    done = spark.read.parquet(paths[0])
    if done.select("decoy").distinct().count() < 2:
        log.error("no confidence: there are no matches to both targets and decoys")
        return paths
    stem = data_path.rstrip("/").rpartition("/")[2].partition(".")[0]
    peptides = brew(prepare_psms(done, read_fasta(spark, fasta), stem), config.train_fdr)
    target = f"{paths[0].removesuffix('.parquet')}.peptides.parquet"
    peptides.write.mode("overwrite").parquet(target)
    return [*paths, target]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("ionweave")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("search")
    for name, need in (("--data_path", True), ("--fasta", True), ("--out_prefix", False), ("--config", False)):
        run.add_argument(name, required=need)
    run.add_argument("--mode", choices=("dia", "dda"), default="dia")
    run.add_argument("--cache", default="ionweave-index")
    build = commands.add_parser("index")
    build.add_argument("--fasta", required=True)
    build.add_argument("--config")
    build.add_argument("--cache", default="ionweave-index")
    args = parser.parse_args(argv)
    setup_logging()
    config = SearchConfig()
    if args.config:
        with open(args.config) as f:
            config = SearchConfig.from_toml(f.read())
    config.log(log)
    spark = SparkSession.builder.appName("ionweave").getOrCreate()
    if args.command == "index":
        cached_index(spark, args.fasta, config, args.cache)
        return 0
    for path in search(spark, args.data_path, args.fasta, args.out_prefix, args.mode, config, args.cache):
        log.info("wrote %s", path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
