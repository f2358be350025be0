"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duowave.plans.scratch import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node in ``edges`` (columns a, b; long).

    Each round hangs the larger neighbours of every node, then the smaller ones, below the smallest of them; the
    rounds needed grow with the logarithm of the longest path. Minima combine before the shuffle and nothing but
    a checksum reaches the driver. Loops and repeated edges are ignored; an empty table gives no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = scratch.write(ordered(edges), "state_0")
    before = checksum(state)
    for turn in range(1, max_rounds + 1):
        # Large star: all neighbours of a node above it go below the smallest neighbour.
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        ).distinct()
        # Small star: the neighbours of a node below it, and itself, go below the smallest of them.
        large = scratch.write(large, f"large_{turn % 2}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        state = scratch.write(small, f"state_{turn % 2}")
        after = checksum(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
