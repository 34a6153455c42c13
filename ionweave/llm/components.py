"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014), as DataFrame joins.

Each step is a map-side combined minimum and a join that adaptive execution may split, so one node with a third of
all edges does not land in one task. Each round is written to the shared folder: no round recomputes another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Each edge with the minimum of its u. The minima's key is an expression of its own, so that the edges' shuffle
    serves this join only and adaptive execution may split a node with many edges over tasks."""
    return edges.join(low.select(F.expr("u ^ 0L").alias("_k"), "m"), F.col("u") == F.col("_k")).drop("_k")


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_low(edges, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node of its component.

    pairs: long columns a and b; self loops, repeats and nulls count for nothing. Empty pairs give an empty table. With
    rounds, at most so many are run: nodes of one root are connected then, but connected nodes may have several roots."""
    spark = pairs.sparkSession
    ends = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    edges = store(ends.where("_a <> _b").select("u", "v").distinct(), "edges")
    mark, done = _print(edges), 0
    while mark[0] and done != rounds:
        after = store(_small_star(_large_star(edges)), "edges")
        now = _print(after)
        forget(spark, edges)
        edges = after
        if now == mark:
            break
        mark, done = now, done + 1
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
