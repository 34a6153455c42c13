"""Top-k, ranks, frames and segments as window expressions with deterministic ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_with_ties(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n largest of each key, and all that equal the n-th (Catalyst limits each group before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= n).drop("_rank")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def best_row(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the largest order value of each key; a partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best")).select(*keys, "_best.*")


def share_or_count(df: DataFrame, keys: list[str], order: list[Column], n: int, share: float) -> DataFrame:
    """The first max(n, share * rows) rows of each key (seeds of a neighbourhood search)."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    return numbered.where(F.col("_rank") <= F.greatest(F.lit(n), F.floor(F.col("_n") * share))).drop("_n", "_rank")


def at_least_kth(df: DataFrame, keys: list[str], value: str, k: int, least: float) -> DataFrame:
    """Rows with value >= max(least, the k-th largest of the key); equals of the k-th stay."""
    return top_with_ties(df, keys, value, k).where(F.col(value) >= least)


def centred_frame(index: Column, length: Column, window: int) -> tuple[Column, Column]:
    """(first, stop) of the `window` rows around a row, moved inwards at the ends; the whole group if it is shorter."""
    first = F.greatest(F.lit(0), F.least(index - window // 2, length - window))
    return first.cast("long"), F.least(first + window, length).cast("long")


def gap_segments(df: DataFrame, keys: list[str], order: str, gap: float) -> DataFrame:
    """df with `segment`: numbered from 0 in order, a new one where the value rises by more than the gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    jumps = df.withColumn("_jump", F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0)))
    return jumps.withColumn("segment", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def chunks(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """df with `chunk`: which run of `size` rows of its key a row is in."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(n / size).cast("long"))


def z_score(value: str, keys: list[str]) -> Column:
    """(value - mean) / sample deviation over the key; zero where that is undefined."""
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    return F.coalesce(z, F.lit(0.0))


def correlation_weight(correlation: str, keys: list[str], tie: str) -> Column:
    """ln(1 + place of the correlation from the largest, from 0) + 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(correlation), tie)
    return F.log1p((F.row_number().over(w) - 1).cast("double")) + 1


def sorted_violations(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_before", before).where(F.col(value) < F.col("_before")).drop("_before")


def mz_bins(df: DataFrame, keys: list[str], mz: str, intensity: str, width: float, offset: float = 0.0) -> DataFrame:
    """(keys, mz, intensity): intensity summed per bin; the bin of a value is the nearest multiple, halves to even."""
    step = F.rint((F.col(mz) + offset) / width)
    return df.groupBy(*keys, step.alias("_bin")).agg(F.sum(intensity).alias(intensity)).select(*keys, (F.col("_bin") * width - offset).alias(mz), intensity)


def rolling_max_rows(df: DataFrame, keys: list[str], order: list, value: str, window: int, name: str = "rolling_max") -> DataFrame:
    """df with the maximum of a row and those after it; rows without a full window go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, window - 1)
    return df.withColumn("_full", F.count(F.lit(1)).over(w)).withColumn(name, F.max(value).over(w)).where(F.col("_full") == window).drop("_full")
