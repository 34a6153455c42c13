"""Target-decoy confidence: preparation of matches, q-values, rescoring, proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ionweave.functions.peptide import reverse_interior, strip_global_mods, strip_mods
from ionweave.operators.ngram import NGRAM, find_proteins, ngram_index
from ionweave.operators.numbering import order_bucket
from ionweave.operators.ranking import best_row

#: Columns that say what a match is, not how good it is.
NOT_FEATURES = ("id", "peptide", "proteins", "filename", "target_pair", "peak_id", "is_target", "PrecursorMZ", "RetentionTime")


def prepare_psms(results: DataFrame, proteins: DataFrame, filename: str, ngram_size: int = NGRAM) -> DataFrame:
    """First-rank matches ready for confidence: no array columns, peptides without global modifications, each decoy
    with its target, lengths, peak counts per residue, proteins. Peptides of no protein have null proteins; ngram_size is
    at most the length of the shortest peptide."""
    plain = [f.name for f in results.schema if not isinstance(f.dataType, T.ArrayType) and f.name not in ("rank", "decoy")]
    kept = results.where(F.col("rank") == 1).select(*plain, (~F.col("decoy")).alias("is_target"))
    kept = kept.withColumn("filename", F.lit(filename)).withColumn("peptide", strip_global_mods(F.col("peptide")))
    kept = kept.withColumn("target_pair", F.when(F.col("is_target"), F.col("peptide")).otherwise(reverse_interior(F.col("peptide"))))
    kept = kept.withColumn("_bare", strip_mods(F.col("target_pair"))).withColumn("peptide_length", F.length("_bare"))
    for name in [c for c in kept.columns if "npeaks" in c]:
        kept = kept.withColumn(f"{name}_pct", 100 * F.col(name) / F.col("peptide_length"))
    owners = find_proteins(kept.select(F.col("_bare").alias("peptide")), ngram_index(proteins, ngram_size), proteins, ngram_size)
    return kept.join(owners.withColumnRenamed("peptide", "_bare"), "_bare", "left").drop("_bare")


def q_values(psms: DataFrame, score: str, is_target: str, name: str = "q_value") -> DataFrame:
    """psms with the q-value of each row: among all rows with at least its score, (decoys + 1) / targets, at most 1, and
    then the smallest of that over all lower thresholds. Equal scores share a value; a null score has none.

    Counts are combined per score; a global order is cut into buckets of scores whose totals are joined, so that no
    task sorts the table."""
    counts = psms.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(is_target)).alias("_t"), F.count_if(~F.col(is_target)).alias("_d"))
    bucketed = counts.withColumn("_b", order_bucket(counts, "_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("_b").agg(F.sum("_t").alias("_bt"), F.sum("_d").alias("_bd"))
    starts = totals.select("_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_bt", "_t0"), ("_bd", "_d0"))))
    down = Window.partitionBy("_b").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    placed = bucketed.join(F.broadcast(starts), "_b")  # one row per bucket
    targets, decoys = F.col("_t0") + F.sum("_t").over(down), F.col("_d0") + F.sum("_d").over(down)
    rates = placed.withColumn("_fdr", F.when(targets > 0, F.least(F.lit(1.0), (decoys + 1) / targets)).otherwise(1.0)).select("_b", "_s", "_fdr")
    lows = rates.groupBy("_b").agg(F.min("_fdr").alias("_low"))
    lower = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    below = lows.select("_b", F.coalesce(F.min("_low").over(lower), F.lit(1.0)).alias("_below"))
    up = Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    table = rates.join(F.broadcast(below), "_b").select("_s", F.least("_below", F.min("_fdr").over(up)).alias(name))
    return psms.withColumn("_s", F.col(score).cast("double")).join(table, "_s", "left").drop("_s")


def best_per_pair(psms: DataFrame, score: str, pair: str = "target_pair") -> DataFrame:
    """The best match of each target-decoy pair (target first, then smaller peptide, among equals)."""
    order = F.struct(F.col(score), F.col("is_target").cast("int"))
    return best_row(psms, [pair], order)


def peptide_confidence(psms: DataFrame, score: str = "Score") -> DataFrame:
    """Competition: the best match of each pair, with q_value."""
    return q_values(best_per_pair(psms, score), score, "is_target")


def protein_confidence(peptides: DataFrame, score: str = "Score") -> DataFrame:
    """(proteins, is_target, score, q_value): picked proteins, each group by its best peptide, target against decoy."""
    best = peptides.where(F.col("proteins").isNotNull()).groupBy("proteins").agg(F.max_by(F.struct("is_target", F.col(score).alias(score)), F.struct(F.col(score), F.col("is_target").cast("int"))).alias("_b"))
    return q_values(best.select("proteins", "_b.is_target", f"_b.{score}"), score, "is_target")


def feature_columns(psms: DataFrame) -> list[str]:
    return [f.name for f in psms.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]


def rescore(psms: DataFrame, train_fdr: float = 0.01, rounds: int = 2, folds: int = 3, start: str = "Score") -> DataFrame:
    """psms with svm_score: a linear SVM separates confident targets from decoys, semi-supervised and cross-validated.

    Folds are by hash of target_pair; each fold is scored by a model that never saw it. Positives of a round are the
    targets within train_fdr by the score so far. A fold without both kinds keeps its score. Scores of a fold are
    centred and scaled by its decoys, which makes folds comparable."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = feature_columns(psms)
    filled = psms.select("*", *(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, n in enumerate(names)))
    packed = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol="_raw").transform(filled).drop(*(f"_f{i}" for i in range(len(names))))
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(packed).transform(packed).drop("_raw")
    data = scaled.withColumn("_fold", F.pmod(F.xxhash64("target_pair"), F.lit(folds))).withColumn("svm_score", F.col(start).cast("double")).persist()
    for _ in range(rounds):
        judged = q_values(data, "svm_score", "is_target", "_q").where(~F.col("is_target") | (F.col("_q") <= train_fdr)).withColumn("label", F.col("is_target").cast("double"))
        judged = judged.persist()
        scored = []
        for k in range(folds):
            train, held = judged.where(F.col("_fold") != k), data.where(F.col("_fold") == k)
            if train.select("label").distinct().count() < 2:
                scored.append(held)
                continue
            model = LinearSVC(featuresCol="_x", labelCol="label", rawPredictionCol="_out", predictionCol="_p", regParam=0.01, maxIter=15).fit(train)
            made = model.transform(held).withColumn("svm_score", vector_to_array("_out")[1]).drop("_out", "_p")
            spread = made.where(~F.col("is_target")).agg(F.avg("svm_score"), F.stddev_pop("svm_score")).first()
            centre, scale = spread[0] or 0.0, spread[1] or 1.0
            scored.append(made.withColumn("svm_score", (F.col("svm_score") - centre) / scale))
        merged = scored[0]
        for part in scored[1:]:
            merged = merged.unionByName(part)
        judged.unpersist()
        before, data = data, merged.persist()
        data.count()
        before.unpersist()
    return data.drop("_x", "_fold")


def brew(psms: DataFrame, train_fdr: float = 0.01, score: str = "svm_score") -> DataFrame:
    """Rescored peptides with q-values, targets and decoys alike."""
    return peptide_confidence(rescore(psms, train_fdr), score)


def score_metrics(psms: DataFrame, score: str = "Score") -> DataFrame:
    """(decoy, peptides, mean_score, q95_score) over the best score of each peptide; quantiles interpolate.

    The two rows around the quantile are found by counts per score bucket, so no task holds a group's scores."""
    best = psms.groupBy("peptide", "decoy").agg(F.max(F.col(score).cast("double")).alias("score"))
    counts = best.groupBy("decoy", "score").agg(F.count(F.lit(1)).alias("_n"))
    bucketed = counts.where(F.col("score").isNotNull()).withColumn("_b", order_bucket(counts.where(F.col("score").isNotNull()), "score"))
    before = Window.partitionBy("decoy").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("decoy", "_b").agg(F.sum("_n").alias("_in")).select("decoy", "_b", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_from"))  # one row per bucket and kind
    inside = Window.partitionBy("decoy", "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("_from") + F.sum("_n").over(inside)
    placed = bucketed.join(starts, ["decoy", "_b"]).select("decoy", "score", (stop - F.col("_n")).alias("_first"), (stop - 1).alias("_last"))
    sums = best.groupBy("decoy").agg(F.count(F.lit(1)).alias("peptides"), F.avg("score").alias("mean_score"), ((F.count("score") - 1) * F.lit(0.95)).alias("_at"))
    at = lambda place: F.max(F.when(F.lit(place).between(F.col("_first"), F.col("_last")), F.col("score")))
    around = placed.join(F.broadcast(sums), "decoy").groupBy("decoy", "peptides", "mean_score", "_at").agg(at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high"))  # two rows sent
    q95 = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return sums.select("decoy", "peptides", "mean_score").join(around.select("decoy", q95.alias("q95_score")), "decoy", "left")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """(bin, n): counts of equal bins from 1; values outside fall into 0 and bins + 1."""
    return df.groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
