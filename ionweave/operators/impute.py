"""Missing retention times and mobilities across runs by matrix factorisation (alternating least squares)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.operators.numbering import dense_ids


def _indexed(cells: DataFrame, row: str, run: str, value: str) -> DataFrame:
    ids = cells.join(dense_ids(cells, row, "_row"), row).join(dense_ids(cells, run, "_run"), run)
    known = ids.select(row, run, "_row", "_run", F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double")).alias("_value"))
    mean = known.agg(F.avg("_value")).first()[0] or 0.0
    return known.withColumn("_centred", F.col("_value") - mean).withColumn("_mean", F.lit(mean))


def _model(rank: int, regularisation: float, iterations: int, seed: int):
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, regParam=regularisation, maxIter=iterations, seed=seed, userCol="_row", itemCol="_run", ratingCol="_centred", nonnegative=False, coldStartStrategy="nan", checkpointInterval=4)


def impute(cells: DataFrame, value: str, row: str = "peptide", run: str = "run", rank: int = 2, regularisation: float = 0.01, iterations: int = 12, seed: int = 0) -> DataFrame:
    """(row, run, value, imputed): every combination of row and run; observed values stay, missing ones (absent, null or
    NaN) are predicted. A row or run without any observation gets the mean."""
    known = _indexed(cells, row, run, value)
    fitted = _model(rank, regularisation, iterations, seed).fit(known.where("_value is not null"))
    runs = known.select(run, "_run").distinct().collect()  # the files of an experiment
    names = F.array(*(F.struct(F.lit(r[run]).alias(run), F.lit(r["_run"]).alias("_run")) for r in runs)) if runs else F.lit(None).cast(T.ArrayType(known.select(run, "_run").schema))
    grid = known.select(row, "_row").distinct().select(row, "_row", F.explode(names).alias("_r")).select(row, "_row", "_r.*")
    mean = known.select("_mean").limit(1).first()
    predicted = fitted.transform(grid).join(known.select(row, run, "_value"), [row, run], "left")
    guess = F.coalesce(F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)), F.lit(0.0)) + F.lit(mean[0] if mean else 0.0)
    return predicted.select(row, run, F.coalesce("_value", guess).alias(value), F.col("_value").isNull().alias("imputed"))


def search_rank(cells: DataFrame, value: str, ranks=(2, 4, 8, 16), folds: int = 3, row: str = "peptide", run: str = "run", regularisation: float = 0.01, iterations: int = 12, seed: int = 0) -> tuple[int, dict[int, float]]:
    """(best rank, mean squared error of each) by folds over the observed cells; missing cells play no part."""
    known = _indexed(cells, row, run, value).where("_value is not null").withColumn("_fold", F.pmod(F.xxhash64(row, run, F.lit(seed)), F.lit(folds)))
    known = known.persist()
    errors = {}
    for rank in ranks:
        total, n = 0.0, 0
        for k in range(folds):
            made = _model(rank, regularisation, iterations, seed).fit(known.where(F.col("_fold") != k)).transform(known.where(F.col("_fold") == k))
            got = made.select(F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)).alias("p"), "_centred").agg(F.sum((F.col("p") - F.col("_centred")) ** 2), F.count(F.lit(1))).first()
            total, n = total + (got[0] or 0.0), n + got[1]
        errors[rank] = total / max(1, n)
    known.unpersist()
    return min(errors, key=errors.get), errors


def collection_matrix(cells: DataFrame, value: str, runs: list[str], row: str = "peptide", run: str = "run") -> DataFrame:
    """One row per peptide, one column per run: the first value by order, null where missing."""
    return cells.groupBy(row).pivot(run, runs).agg(F.min(value))


#: Rows, and runs, of a block of a factor product: a task holds one block of values.
BLOCK = 1024


def _block(names: list[str]):
    def codes(column):
        held = column.combine_chunks().dictionary_encode()
        held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
        return held.dictionary, held.indices.to_numpy(zero_copy_only=False)

    def run(key, left, right):
        factors = pa.concat_arrays([t.column("factor").combine_chunks() for t in (left, right)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        (rows, i), (runs, j) = codes(left.column("row")), codes(right.column("run"))
        met, known, value = (np.zeros((len(rows), len(runs)), t) for t in (bool, bool, float))
        weights = [t.column("weight").to_numpy() for t in (left, right)]
        given = [t.column("weight").combine_chunks().is_valid().to_numpy(zero_copy_only=False) for t in (left, right)]
        for f in np.intersect1d(factors[: len(i)], factors[len(i) :]).tolist():
            sums, some, all_ = [], [], []
            for k, w, g, own, n in zip((i, j), weights, given, (factors[: len(i)] == f, factors[len(i) :] == f), (len(rows), len(runs))):
                all_.append(np.bincount(k[own], minlength=n) > 0)
                sums.append(np.bincount(k[own & g], w[own & g], n))
                some.append(np.bincount(k[own & g], minlength=n) > 0)
            met |= np.outer(*all_)
            both = np.outer(*some)
            known |= both
            value[both] += np.outer(*sums)[both]
        r, c = np.nonzero(met)
        return pa.table([rows.take(pa.array(r)), runs.take(pa.array(c)), pa.array(value[r, c], mask=~known[r, c])], names=names)

    return run


def factor_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(row, run, value) of two factor tables (row, factor, weight) and (run, factor, weight): all pairs that share a
    factor. Blocks of about BLOCK rows meet blocks of about BLOCK runs; the products of a block are summed where it is made,
    so memory is bounded and blocks are spread over the tasks. The pairs themselves are rows times runs."""
    kind = "long" if left.schema["factor"].dataType != right.schema["factor"].dataType else left.schema["factor"].dataType
    as_table = lambda df, name: df.where("factor is not null").select(name, F.col("factor").cast(kind).alias("factor"), F.col("weight").cast("double").alias("weight"))
    a, b = as_table(left, "row"), as_table(right, "run")
    n, m = (max(1, -(-df.select(c).distinct().count() // BLOCK)) for df, c in ((a, "row"), (b, "run")))
    of = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = a.withColumn("_i", of("row", n)).withColumn("_j", every(m)).repartition(min(n * m, 4096), "_i", "_j")
    b = b.withColumn("_j", of("run", m)).withColumn("_i", every(n)).repartition(min(n * m, 4096), "_i", "_j")
    schema = T.StructType([T.StructField("row", left.schema["row"].dataType), T.StructField("run", right.schema["run"].dataType), T.StructField("value", T.DoubleType())])
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(_block(schema.names), schema)
