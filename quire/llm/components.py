"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round halves distances.  Every aggregate here is a minimum, which Spark combines before it
shuffles; the minima are stored, so the join with them is of two plain shuffles, and adaptive execution
can split the rows of a node with many neighbours: one huge component is no hot task.  Rounds are tables in
the shared folder, each deleted once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import storage


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for each node that has an edge; component is the smallest node reachable.

    Self loops and repeated edges are harmless; edges with a null end are ignored; no edges give an
    empty table.
    """
    a, b = F.col(u), F.col(v)
    spark = edges.sparkSession
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    pairs, path = storage.write_table(pairs, "pairs")
    size = _signature(pairs)
    while True:
        for star in (_LargeStar, _SmallStar):
            least, least_path = storage.write_table(star.least(pairs), "minima")
            pairs, new_path = storage.write_table(star.join(pairs, least), "pairs")
            storage.drop_table(spark, path)
            storage.drop_table(spark, least_path)
            path = new_path
        now = _signature(pairs)
        if now == size:
            break
        size = now
    roots = pairs.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def _signature(pairs: DataFrame) -> tuple:
    """Two rounds with the same edges are the end."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("lo", "hi"))).first())


class _LargeStar:
    """Links each larger neighbour of a node to the smallest node around it."""

    @staticmethod
    def least(pairs: DataFrame) -> DataFrame:
        return _both(pairs).groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))

    @staticmethod
    def join(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return _both(pairs).where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


class _SmallStar:
    """Links each smaller neighbour of a node, and the node, to its smallest neighbour."""

    @staticmethod
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("hi").agg(F.min("lo").alias("m"))

    @staticmethod
    def join(pairs: DataFrame, least: DataFrame) -> DataFrame:
        joined = pairs.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        return joined.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
