"""Several runs together: joint confidence, run-by-run values, imputation, files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.operators.confidence import peptide_confidence, protein_confidence
from ionweave.operators.impute import collection_matrix, impute, search_rank

RANKS = (2, 4, 8, 16)


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs with their name in `run`; columns that a run lacks are null."""
    if len(runs) < 2:
        raise ValueError("aggregation needs at least two runs")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("run", F.lit(name)) for name, df in runs.items()))


def run_cells(together: DataFrame, peptides: DataFrame, value: str, score: str, runs: list[str]) -> DataFrame:
    """(peptide, run, value): every peptide in every run with the value of its best match there, null without one."""
    best = together.groupBy("peptide", "run").agg(F.max_by(value, score).alias(value))
    every = peptides.select("peptide", F.explode(F.array(*map(F.lit, runs))).alias("run"))
    return every.join(best, ["peptide", "run"], "left")


def aggregate_runs(runs: dict[str, DataFrame], eval_fdr: float = 0.01, score: str = "Score", values=("RetentionTime", "IonMobility"), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(peptides, proteins): accepted peptides with a column per run and value, missing ones imputed, and accepted proteins."""
    together = union_runs(runs)
    peptides = peptide_confidence(together, score)
    accepted = peptides.where(F.col("is_target") & (F.col("q_value") <= eval_fdr)).select("peptide", score, "q_value", "proteins")
    names, out = list(runs), accepted
    for value in [v for v in values if v in together.columns]:
        cells = run_cells(together, accepted.select("peptide"), value, score, names)
        rank, _ = search_rank(cells, value, RANKS, seed=seed)
        wide = collection_matrix(impute(cells, value, rank=rank, seed=seed), value, names)
        out = out.join(wide.select("peptide", *(F.col(f"`{n}`").alias(f"{value}_{n}") for n in names)), "peptide", "left")
    proteins = protein_confidence(peptides, score).where(F.col("is_target") & (F.col("q_value") <= eval_fdr))
    return out, proteins


def save(peptides: DataFrame, proteins: DataFrame, folder: str, overwrite: bool = False) -> tuple[str, str]:
    """Write both tables into <folder>/aggregate; existing files are an error unless overwrite."""
    paths = f"{folder}/aggregate/search.peptides.parquet", f"{folder}/aggregate/search.proteins.parquet"
    for df, path in zip((peptides, proteins), paths):
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return paths


def searches(spark: SparkSession, paths: list[str], folder: str, eval_fdr: float = 0.01, overwrite: bool = False) -> tuple[str, str]:
    """Aggregate the prepared matches of several runs, each a Parquet path; a run is named by its path's last part."""
    runs = {p.rstrip("/").rpartition("/")[2].removesuffix(".parquet"): spark.read.parquet(p) for p in paths}
    return save(*aggregate_runs(runs, eval_fdr), folder, overwrite)
