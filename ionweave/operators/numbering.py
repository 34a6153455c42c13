"""Order and numbering over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a global order; their totals are the only thing that one task sees at once.
BUCKETS = 256


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): 0..n-1 for the distinct values of key, the same on every run: numbered within hash buckets, which
    are then set end to end."""
    keys = df.select(key).distinct().withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    local = keys.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1)
    sizes = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    start = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_bucket", F.coalesce(start, F.lit(0)).alias("_start")))  # BUCKETS rows
    return local.join(starts, "_bucket").select(key, (F.col("_start") + F.col("_n")).cast("int").alias(name))


def order_bucket(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Bucket number of a value, larger values first; equal values share one. The cuts are approximate quantiles."""
    cuts = df.select(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()[0] or []
    held = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(held, lambda c: c > F.col(value)))
