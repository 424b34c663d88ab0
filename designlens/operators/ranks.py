"""Exact ranks and quantiles of groups of any size, without sorting a group in one task.

For ranks of all rows scores are counted first. The counts are dealt into ranges
of (group, score), so a large group lies in many ranges; each range is summed on
its own, and the sums of the ranges before it, a row for each range and group,
are added. Quantiles need a few ranks only and come from histograms that are
refined where those ranks lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from designlens.shared import materialize

#: Bins of an interval, rows of an interval that is counted by value at once, and rounds after which any is.
BINS, EXACT, ROUNDS = 2048, 1 << 16, 12


def cumulative(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """``group``, ``score``, n, before (rows of the group with a smaller score), total: a row for each distinct score that isn't null."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("n"))
    ranged = materialize(counts.repartitionByRange(*group, score).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*group, "_range").agg(F.sum("n").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_sum")
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_of"), ahead.alias("_ahead"), F.sum("_sum").over(Window.partitionBy(*group)).alias("total"))
    same = F.col("_range") == F.col("_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.sum("n").over(Window.partitionBy("_range", *group).orderBy(score)) - F.col("n")
    return ranged.withColumn("_inside", inside).join(offsets, same).select(*group, score, "n", (F.col("_ahead") + F.col("_inside")).alias("before"), "total")


def quantiles(df: DataFrame, group: list[str], score: str, asked: dict[str, float]) -> DataFrame:
    """``group`` and a column for each of ``asked`` (name -> probability): interpolated quantiles, as ``percentile`` gives them.

    The scores are written once without a shuffle. Each group is then an interval that is counted in ``BINS`` bins, and
    only the bins that hold a wanted rank are looked into again, until each is one value; an interval of at most
    ``EXACT`` rows is counted by value at once. What is shuffled are counts of bins, however many rows there are. Jobs run
    while the plan is built. Null scores are left out, NaN is above all numbers.
    """
    rows = materialize(df.where(F.col(score).isNotNull()).select(*group, F.col(score).alias("_v")), "scores")
    v = F.col("_v")
    number = v.cast("double")
    finite = F.when(F.abs(number) < float("inf"), v)  # null for NaN and the infinite
    found = [F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min(finite).alias("flo"), F.max(finite).alias("fhi")]
    whole = rows.groupBy(*group).agg(*found)
    state = materialize(whole.withColumns({"total": F.col("n"), "before": F.lit(0).cast("bigint")}), "intervals")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("total") - 1) * F.lit(float(p))), F.ceil((F.col("total") - 1) * F.lit(float(p)))) for p in asked.values()])))
    done, rounds = state.where("lo = hi"), 0
    while state.where("lo <> hi").head(1):
        # a group's open intervals lie side by side, at most two for each quantile that is asked for
        packed = state.where("lo <> hi").groupBy(*group).agg(F.max("total").alias("total"), F.collect_list(F.struct("lo", "hi", "flo", "fhi", "n", "before")).alias("open"))
        met = rows.join(_renamed(packed, group), _same(group), "inner").select(*group, "_v", "total", F.explode(F.filter("open", lambda x: (x["lo"] <= F.col("_v")) & (F.col("_v") <= x["hi"]))).alias("x"))
        half = lambda c: F.col(f"x.{c}").cast("double") / 2
        at = F.try_divide((number / 2 - half("flo")), F.nullif(half("fhi") - half("flo"), F.lit(0.0))) * BINS
        bin_ = F.when(F.isnan(number) | (number == float("inf")), BINS).when(number == float("-inf"), -1).otherwise(F.coalesce(F.least(F.floor(at), F.lit(BINS - 1)), F.lit(0)))
        exact = (F.col("x.n") <= EXACT) | F.lit(rounds >= ROUNDS)
        keys = [*group, "total", F.col("x.before").alias("_from"), F.when(~exact, bin_).alias("_bin"), F.when(exact | F.isnan(number), v).alias("_value")]
        counted = met.groupBy(*keys).agg(*found)
        upto = F.sum("n").over(Window.partitionBy(*group, "_from").orderBy("lo"))
        parts = counted.withColumn("before", F.col("_from") + upto - F.col("n"))
        state = materialize(parts.where(F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).select(*state.columns), "intervals")
        done, rounds = done.unionByName(state.where("lo = hi")), rounds + 1
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in asked.items()])
    holds = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    place = lambda a: (F.col("total") - 1) * a["p"]
    at = F.filter(names, lambda a: holds(F.floor(place(a))) | holds(F.ceil(place(a))))
    met = done.select(*group, F.col("lo").alias("_v"), "before", "n", "total", F.explode(at).alias("a")).withColumn("h", (F.col("total") - 1) * F.col("a.p"))
    low, high = F.max(F.when(holds(F.floor("h")), v)), F.max(F.when(holds(F.ceil("h")), v))
    ends = met.groupBy(*group, F.col("a.name").alias("name")).agg(low.alias("low"), high.alias("high"), (F.max("h") - F.max(F.floor("h"))).alias("part"))
    between = F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).otherwise((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).cast("double"))
    one = ends.select(*group, "name", between.alias("value"))
    return one.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in asked])


def _renamed(df: DataFrame, group: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_of_{c}" for c in group})


def _same(group: list[str]) -> Column:
    """Null-safe equality with the columns of a ``_renamed`` table."""
    out = F.lit(True)
    for c in group:
        out = out & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return out


def average_rank(n: Column, before: Column) -> Column:
    """The mean of the ranks 1, 2, ... that equal scores share."""
    return before + (n + 1) / 2
