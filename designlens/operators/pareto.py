"""Skylines of two scores, knees, portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designlens.shared import materialize

#: Parts of a group that are reduced on their own before the group meets, and rows of a group that one task may sort then.
SALTS, LARGE = 64, 1_000_000


def _front(df: DataFrame, group: list[str], x: str, y: str, key: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(x).desc(), F.col(y).desc(), F.col(key))
    before = F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(y) > F.col("_before"))).drop("_before")


def skyline(df: DataFrame, group: list[str], x: str, y: str, key: str) -> DataFrame:
    """Rows that no row of their group beats in both scores; of exact duplicates the one with the least key.

    Two levels: fronts of salted parts of each group first, which are written once,
    then the front of those. Where that leaves more than ``LARGE`` rows of a group,
    the last level goes by ranges of x, so a front of any size is never sorted in
    one task. Jobs run while the plan is built.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    parts = materialize(_front(salted, [*group, "_salt"], x, y, key).drop("_salt"), "fronts")
    if parts.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).head(1):
        return _front_by_ranges(parts, group, x, y, key)
    return _front(parts, group, x, y, key)


def _front_by_ranges(df: DataFrame, group: list[str], x: str, y: str, key: str) -> DataFrame:
    """The same for groups of any size: fronts of ranges of x, less what the largest y of all higher ranges beats."""
    ranged = materialize(df.repartitionByRange(*group, x).withColumn("_range", F.spark_partition_id()), "ranges")
    # ranges ascend in x; equal x share a range
    most = ranged.groupBy(*group, "_range").agg(F.max(y).alias("_most"))
    above = F.max("_most").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(1, Window.unboundedFollowing))
    limits = most.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_range").alias("_at"), above.alias("_above"))
    same = F.col("_range") == F.col("_at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    kept = ranged.join(limits, same).where(F.col("_above").isNull() | (F.col(y) > F.col("_above")))
    return _front(kept.select(*df.columns, "_range"), [*group, "_range"], x, y, key).drop("_range")


def normalised(front: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Scores scaled to 0..1 in each group; a constant one is 0.5."""
    w = Window.partitionBy(*group)

    def scale(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    return front.withColumns({"nx": scale(x), "ny": scale(y)})


def knees(front: DataFrame, group: list[str], x: str, y: str, key: str) -> DataFrame:
    """Three knees of each front: farthest from the chord of its ends, largest product, nearest to the ideal."""
    n = normalised(front, group, x, y)
    w = Window.partitionBy(*group).orderBy(x, F.col(y).desc(), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = n.withColumns({"x0": F.first("nx").over(w), "y0": F.first("ny").over(w), "x1": F.last("nx").over(w), "y1": F.last("ny").over(w)})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    chord = F.sqrt(dx * dx + dy * dy)
    away = F.when(chord < 1e-12, 0.0).otherwise(F.abs(dy * (F.col("nx") - F.col("x0")) - dx * (F.col("ny") - F.col("y0"))) / F.greatest(chord, F.lit(1e-12)))
    measure = {"a": F.round(away, 9), "b": F.round(F.col("nx") * F.col("ny"), 9), "c": -F.round(F.sqrt((1 - F.col("nx")) ** 2 + (1 - F.col("ny")) ** 2), 9)}
    scored = ends.withColumns({f"m_{k}": v for k, v in measure.items()})
    pick = lambda k: F.max_by(key, F.struct(F.col(f"m_{k}"), -F.col(x), -F.col(key))).alias(f"knee_{k}")
    return scored.groupBy(*group).agg(F.count("*").alias("n_front"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), *[pick(k) for k in "abc"])


def envelope(front: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """For each x of a group the largest y at that x or beyond."""
    at = front.groupBy(*group, x).agg(F.max(y).alias("y"))
    w = Window.partitionBy(*group).orderBy(x).rowsBetween(0, Window.unboundedFollowing)
    return at.select(*group, F.col(x).alias("x"), F.max("y").over(w).alias("envelope"))


def best_per_target(designs: DataFrame, targets: DataFrame, score: str, key: str, n: int = 15) -> DataFrame:
    """The best design of each target, multi-target ones for all of theirs; the n best of those with their rank."""
    each = designs.join(targets, "group_no")
    best = each.groupBy("target").agg(F.max_by(F.struct("topology", key, score), F.struct(F.col(score), -F.col(key))).alias("b")).select("target", "b.*")
    rank = F.row_number().over(Window.orderBy(F.col(score).desc(), key, "target"))
    return best.orderBy(F.col(score).desc(), key, "target").limit(n).withColumn("rank", rank)


def portfolio(front: DataFrame, x: str, y: str, keys: list[str], n: int) -> DataFrame:
    """The ``n`` rows of the largest combined score, half from each score over its maximum, with their rank."""
    most = front.agg(F.max(x).alias("_x"), F.max(y).alias("_y"))
    combined = F.round(0.5 * F.col(x) / F.col("_x") + 0.5 * F.col(y) / F.col("_y"), 9)
    # one row of maxima
    scored = front.crossJoin(most).select(*keys, combined.alias("combined"))
    best = scored.orderBy(F.col("combined").desc(), keys[-1]).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("combined").desc(), keys[-1])))


def combined_by_floors(rows: DataFrame, x: str, y: str, x_floor: float, y_floor: float, y_most: float) -> DataFrame:
    """Rows that reach both floors, with ``combined``: how far x and y are above them, as shares of the best x and of ``y_most``."""
    fit = rows.where((F.col(x) >= x_floor) & (F.col(y) >= y_floor))
    most = fit.agg(F.greatest(F.max(x) - x_floor, F.lit(1e-9)).alias("_x"))
    # one row
    share = (F.col(x) - x_floor) / F.col("_x") + (F.col(y) - y_floor) / max(y_most - y_floor, 1e-9)
    return fit.crossJoin(most).withColumn("combined", F.round(share, 9)).drop("_x")


def best_knees(rows: DataFrame, targets: DataFrame, group: str, key: str, n: int = 15) -> DataFrame:
    """target, ``key``, combined, rank: the row of the largest ``combined`` of each target, multi-target ones for all of theirs, and of those the n best."""
    best = rows.join(targets, group).groupBy("target").agg(F.min(F.struct((-F.col("combined")).alias("by"), F.col(key).alias("key"))).alias("b"))
    order = [F.desc("combined"), F.col(key), F.col("target")]
    top = best.select("target", F.col("b.key").alias(key), (-F.col("b.by")).alias("combined")).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
