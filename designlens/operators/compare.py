"""Designs against each other: ranks, fronts, neighbours, correlations given a control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from designlens.functions.slots import hamming
from designlens.operators.pareto import skyline


def partial_correlation(df: DataFrame, group: list[str], x: str, y: str, z: str, least: int = 3) -> DataFrame:
    """Correlation of x and y given z; null for fewer than ``least`` rows or where a denominator is 1e-12 or less."""
    c = lambda a, b: F.covar_pop(a, b)
    m = df.groupBy(*group).agg(F.count("*").alias("n"), *[c(a, b).alias(f"{a}_{b}") for a, b in ((x, x), (y, y), (z, z), (x, y), (x, z), (y, z))])
    r = lambda a, b: F.col(f"{a}_{b}") / F.sqrt(F.nullif(F.col(f"{a}_{a}") * F.col(f"{b}_{b}"), F.lit(0.0)))
    below = F.sqrt((1 - r(x, z) ** 2) * (1 - r(y, z) ** 2))
    return m.select(*group, "n", F.when((F.col("n") >= least) & (below > 1e-12), F.round((r(x, y) - r(x, z) * r(y, z)) / below, 6)).alias("partial_r"))


def front_recall(df: DataFrame, group: list[str], actual: tuple[str, str], predicted: tuple[str, str], key: str) -> DataFrame:
    """Rows on the front of the actual scores, and the share of them on the front of the predicted ones."""
    a = skyline(df, group, *actual, key).select(*group, key)
    p = skyline(df, group, *predicted, key).select(*group, key).withColumn("both", F.lit(1))
    met = a.join(p, [*group, key], "left")
    return met.groupBy(*group).agg(F.count("*").alias("n_actual"), F.round(F.count("both") / F.count("*"), 6).alias("recall"))


def rank_of(df: DataFrame, chosen: DataFrame, group: list[str], score: str, key: str) -> DataFrame:
    """The rank of each chosen row in its group: one more than the rows with a larger score."""
    own = chosen.select(*group, F.col(key).alias("chosen"), F.col(score).alias("own"))
    met = df.select(*group, score).join(own, group)
    return met.groupBy(*group, "chosen").agg((F.count_if(F.col(score) > F.col("own")) + 1).alias("rank"))


def comparators(df: DataFrame, anchors: DataFrame, group: list[str], key: str, slots: str, roles: dict[str, Column], order: Column) -> DataFrame:
    """For each anchor and role the nearest row of its group that fits the role (a condition on the row and ``anchor_...`` columns).

    Rows and anchors meet on the group, never all with all; ties go to the least ``order``, then the least key.
    """
    own = anchors.select(*group, *[F.col(c).alias(f"anchor_{c}") for c in anchors.columns if c not in group])
    met = df.join(own, group).where(F.col(key) != F.col(f"anchor_{key}")).withColumn("distance", hamming(F.col(slots), F.col(f"anchor_{slots}")))
    role = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in roles.items()]))
    each = met.select(F.col(f"anchor_{key}").alias("anchor"), F.col(key).alias("other"), "distance", order.alias("by"), F.explode(role).alias("role"))
    return each.groupBy("anchor", "role").agg(F.min(F.struct("distance", "by", "other")).alias("m"), F.count("*").alias("n_fit")).select("anchor", "role", "n_fit", "m.distance", "m.other")


def top_both_ways(table: DataFrame, group: list[str], effect: str, key: str, n: int) -> DataFrame:
    """The ``n`` strongest effects of each sign in each group, with their rank."""
    way = F.when(F.col(effect) > 0, "up").otherwise("down")
    w = Window.partitionBy(*group, "direction").orderBy(F.abs(effect).desc(), key)
    ranked = table.where(F.col(effect).isNotNull() & (F.col(effect) != 0)).withColumn("direction", way).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n).select(*group, "direction", "rank", key, effect)


def task_views(df: DataFrame, keep: list[str], scores: list[str], floor: float) -> DataFrame:
    """keep, task, y: each score as it is and as a logarithm, never of less than ``floor``."""
    views = [F.struct(F.lit(name).alias("task"), value.alias("y")) for c in scores for name, value in ((c, F.col(c).cast("double")), (f"{c}_ln", F.ln(F.greatest(F.col(c).cast("double"), F.lit(floor)))))]
    return df.select(*keep, F.explode(F.array(*views)).alias("v")).select(*keep, "v.*")
