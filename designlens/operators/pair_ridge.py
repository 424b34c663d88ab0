"""Ridge fits with as many features as pairs of parts make: conjugate gradients, with all sums over rows made by Spark.

A row names the features that it has; a fit of a group is a weight for each
feature. No matrix of features is made: a step reads the rows once, adds up the
weights that each row names, and sums what comes of it by feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designlens.shared import materialize

#: Bytes of weights of all groups that are sent to every task; more are joined.
SENT = 256 << 20


def main_features(slots: Column, parts: int) -> Column:
    """A feature for each slot's part: slot times ``parts`` plus part less one."""
    return F.transform(slots, lambda p, i: i * parts + p - 1)


def pair_features(slots: Column, parts: int, most: int) -> Column:
    """The main features of up to ``most`` slots, and one for the parts of each two slots, numbered after them; ``feature_count`` in all."""
    own = main_features(slots, parts)
    n = most * parts
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.lit(n) + a * n + b)))
    return F.concat(own, pairs)


def feature_count(parts: int, most: int, pairs: bool) -> int:
    n = most * parts
    return n + n * n if pairs else n


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def _by_feature(each: DataFrame, groups: DataFrame, group: list[str], size: int, name: str) -> DataFrame:
    """``group`` and the sums of v by feature as an array of ``size``; ``each`` has ``group``, f, v."""
    zeros = groups.select(*group, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("f"), F.lit(0.0).alias("v"))
    sums = each.unionByName(zeros).groupBy(*group, "f").agg(F.sum("v").alias("v"))
    return sums.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias(name))


def ridge_by_gradients(df: DataFrame, group: list[str], features: Column, y: str, size: int, penalty: float, steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``group``, n, mean, weights, r2: the ridge fit of ``y`` with a free constant, by group.

    ``features`` is an array of different numbers below ``size``. The weights minimise the squared residuals plus
    ``penalty`` (above 0) times their squares; the prediction is mean plus the sum of a row's weights less their average
    over the rows. r2 is null where y is constant. Rows with a null y or group take no part. There are at most ``steps``
    steps, a job each while the plan is built, until every group's gradient is below ``tolerance`` of the first; a fit
    that has not settled raises an error.
    """
    known = F.lit(True)
    for c in group:
        known = known & F.col(c).isNotNull()
    rows = materialize(df.where(known & F.col(y).isNotNull()).select(*group, features.alias("_f"), F.col(y).cast("double").alias("_y")), "ridge-rows")
    stats = materialize(rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("_v")), "ridge-groups")
    n_groups = stats.count()
    sent = (lambda t: F.broadcast(t)) if 3 * 8 * size * max(n_groups, 1) <= SENT else (lambda t: t)
    seen = rows.select(*group, F.explode("_f").alias("f"), F.lit(1.0).alias("v"))
    share = _by_feature(seen, stats, group, size, "_seen").join(stats, group).select(*group, F.transform("_seen", lambda c: c / F.col("n")).alias("share"))
    right = rows.join(sent(stats.select(*group, "mean")), group).select(*group, F.explode("_f").alias("f"), (F.col("_y") - F.col("mean")).alias("v"))
    start = _by_feature(right, stats, group, size, "r").join(share, group)
    zero = F.transform("r", lambda _: F.lit(0.0))
    state = materialize(start.select(*group, "share", zero.alias("w"), "r", F.col("r").alias("p"), _dot("r", "r").alias("rs"), _dot("r", "r").alias("first")), "ridge-state")
    open_ = F.col("rs") > tolerance * tolerance * F.col("first")
    for _ in range(steps):
        if not state.where(open_).head(1):
            break
        now = state.where(open_).select(*group, "p", _dot("share", "p").alias("_level"))
        reached = F.aggregate("_f", F.lit(0.0), lambda t, f: t + F.get("p", f)) - F.col("_level")
        back = rows.join(sent(now), group).select(*group, reached.alias("v"), F.explode("_f").alias("f"))
        met = state.join(_by_feature(back.select(*group, "f", "v"), now, group, size, "q"), group, "left")
        q = F.when(F.col("q").isNotNull(), F.zip_with("q", "p", lambda a, b: a + penalty * b))
        met = materialize(met.withColumn("q", q).withColumn("alpha", F.col("rs") / F.nullif(_dot("p", "q"), F.lit(0.0))), "ridge-step")
        moved = F.col("alpha").isNotNull()
        w = F.when(moved, F.zip_with("w", "p", lambda a, b: a + F.col("alpha") * b)).otherwise(F.col("w"))
        r = F.when(moved, F.zip_with("r", "q", lambda a, b: a - F.col("alpha") * b)).otherwise(F.col("r"))
        after = met.select(*group, "share", w.alias("w"), r.alias("r"), "p", F.col("rs").alias("was"), "first", moved.alias("moved")).withColumn("rs", _dot("r", "r"))
        p = F.when(F.col("moved"), F.zip_with("r", "p", lambda a, b: a + F.col("rs") / F.col("was") * b)).otherwise(F.col("p"))
        state = materialize(after.withColumn("p", p).select(*state.columns), "ridge-state")
    else:
        if state.where(open_).head(1):
            raise RuntimeError(f"ridge fits have not settled after {steps} steps")
    fits = state.select(*group, F.col("w").alias("weights"), _dot("share", "w").alias("_level")).join(stats, group)
    told = F.col("mean") - F.col("_level") + F.aggregate("_f", F.lit(0.0), lambda t, f: t + F.get("weights", f))
    error = rows.join(sent(fits), group).groupBy(*group).agg(F.avg((F.col("_y") - told) ** 2).alias("_error"))
    return fits.join(error, group).select(*group, "n", "mean", "weights", (1 - F.col("_error") / F.nullif(F.col("_v"), F.lit(0.0))).alias("r2"))
