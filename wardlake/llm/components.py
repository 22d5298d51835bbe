"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wardlake.session import dropped, written


def _stars(pairs: DataFrame) -> DataFrame:
    """Each node's neighbours ``v`` with the least of the node ``u`` and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that it can reach, for every node of ``edges`` (a, b).

    Every round writes its edges to the shared folder, so a lost executor costs one round
    at most, and deletes those of the round before. One count and one checksum of the edges come to the driver. Edges that already
    lead to the smallest node of each component take one round, none take no round.
    """

    def state_of(rows: DataFrame) -> Row:
        return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()

    current = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state_of(current)
    while before.n:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _stars(large.where("u != v").distinct())
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        earlier, current = current, written(pairs.where("u != v").distinct(), "edges")
        dropped(earlier)
        state = state_of(current)
        if state == before:
            break
        before = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
