"""Bipartite neighbour graphs as edge tables (left, right)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.band_join import band_join_multi


def edges_from_arrays(df: DataFrame, left: str, right: str) -> DataFrame:
    """Edges of two parallel array columns; unequal lengths raise an error."""
    pairs = F.when(F.size(left) == F.size(right), F.arrays_zip(F.col(left).alias("left"), F.col(right).alias("right"))).otherwise(F.raise_error(F.lit("arrays have different lengths")))
    return df.select(F.explode(pairs).alias("e")).select("e.left", "e.right").distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.select("left", "right").union(more.select("left", "right")).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """(side, node): distinct nodes of either side that have an edge."""
    return edges.select(F.lit("left").alias("side"), F.col("left").alias("node")).union(edges.select(F.lit("right"), "right")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(left, neighbours): sorted right nodes of each left node."""
    return edges.groupBy("left").agg(F.array_sort(F.collect_set("right")).alias("neighbours"))


def common_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("left", "right").intersect(b.select("left", "right"))


@dataclass(frozen=True)
class NeighborFinder:
    """Neighbour search with ranges per dimension: {name: (low, high)} of right - left; units `da` or `ppm`.

    distances: {name: function of the left and right column that gives a column} replaces the difference of a dimension,
    with a closed range. At least one dimension keeps a difference: rows meet by its bins."""

    ranges: dict
    order: tuple = ()
    units: dict = field(default_factory=dict)
    distances: dict = field(default_factory=dict)

    def __post_init__(self):
        if not set(self.ranges) - set(self.distances):
            raise ValueError("one dimension at least needs a plain difference")
        if set(self.order or self.ranges) != set(self.ranges):
            raise ValueError("order and ranges name different dimensions")

    def find(self, left: DataFrame, right: DataFrame | None = None, left_id: str = "id", right_id: str = "id") -> DataFrame:
        """Edges between rows of left and right (left itself if None)."""
        names = list(self.order or self.ranges)
        a = left.select(F.col(left_id).alias("left"), *(F.col(n).alias(f"l_{n}") for n in names))
        b = (left if right is None else right).select(F.col(right_id).alias("right"), *(F.col(n).alias(f"r_{n}") for n in names))
        plain = [n for n in names if n not in self.distances]
        met = band_join_multi(a, b, [(f"l_{n}", f"r_{n}", *self.ranges[n]) for n in plain], [self.units.get(n, "da") for n in plain])
        for n, distance in self.distances.items():
            met = met.where(distance(F.col(f"l_{n}"), F.col(f"r_{n}")).between(*self.ranges[n]))
        return met.select("left", "right")
