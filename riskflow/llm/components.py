"""Connected components of a graph in DataFrames, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import remove, stored


def _nearest(pairs: DataFrame) -> DataFrame:
    """Adds m, the smallest of u and what it is paired with."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def roots(edges: DataFrame) -> DataFrame:
    """(u, v) links to (u, v) with v the smallest node that u reaches, for u > v only.

    Larger neighbours are linked to the smallest one, then smaller ones are, until
    nothing changes; the number of rounds grows with the logarithm of the longest
    path. Every round starts from a written table, and the one before it is removed.
    """

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()

    edges = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = stored(edges.distinct(), "links")
    now = state(edges)
    while True:
        large = _nearest(_both_ways(edges)).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        small = _nearest(large.distinct())
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        moved = stored(small.filter("u <> v").distinct(), "links")
        before, now = now, state(moved)
        # Different sets may agree in number and sum, so equal ones are compared in full.
        done = now == before and edges.join(moved, ["u", "v"], "left_anti").isEmpty()
        remove(edges)
        edges = moved
        if done:
            return edges
