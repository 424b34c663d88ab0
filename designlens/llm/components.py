"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designlens.shared import materialize

#: The steps needed grow with the logarithm of the largest component.
MAX_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: larger neighbours (large star), or the others (small star)."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u")
        out = out.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points once at most, and none to a node that points on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("points")), F.struct(F.col("v").alias("id"), F.lit(0).alias("points")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("points").alias("points"), F.min("points").alias("least")).where("points > 1 or (points = 1 and least = 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): each id of ``links`` (a, b) with the least id it reaches.

    Null ends and loops link nothing. Ids without a link are not in the result.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    edges = materialize(pairs.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        edges = materialize(_star(_star(edges, True), False), "edges")
    else:
        raise RuntimeError("the components did not settle")
    # every node now points to its least member
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
