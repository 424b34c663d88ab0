"""Percentile tiers within size classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designlens.operators.ranks import cumulative, quantiles

TIERS = (1, 5, 10, 25)


def histogram(designs: DataFrame, group: list[str], score: str, low: float, width: float, bins: int) -> DataFrame:
    """Designs in each bin of a fixed grid, ends included in the outer bins. Mergeable: bins of parts add up."""
    at = F.least(F.greatest(F.floor((F.col(score) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return designs.groupBy(*group, at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentiles(hist: DataFrame, group: list[str], low: float, width: float, percents: list[float]) -> DataFrame:
    """Percentiles from a histogram, linear within a bin."""
    w = Window.partitionBy(*group).orderBy("bin")
    upto = hist.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*group))})
    asked = upto.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent"))
    need = F.col("percent") / 100 * F.col("total")
    inside = asked.where((need <= F.col("upto")) & ((need > F.col("upto") - F.col("n")) | ((F.col("upto") == F.col("n")) & (need <= 0))))
    value = low + width * (F.col("bin") + (need - (F.col("upto") - F.col("n"))) / F.col("n"))
    return inside.select(*group, "percent", F.round(value, 6).alias("value"))


def tier_thresholds(designs: DataFrame, size: str, score: str) -> DataFrame:
    """Exact thresholds of the top and bottom tiers of each size class."""
    return quantiles(designs, [size], score, {f"top_{t:02d}": (100 - t) / 100 for t in TIERS} | {f"bot_{t:02d}": t / 100 for t in TIERS})


def tier_counts(designs: DataFrame, size: str, group: str, score: str) -> DataFrame:
    """Designs of each group in each tier of its own size class."""
    joined = designs.join(tier_thresholds(designs, size, score), size)
    top = [F.count_if(F.col(score) >= F.col(f"top_{t:02d}")).alias(f"n_top_{t:02d}") for t in TIERS]
    bottom = [F.count_if(F.col(score) <= F.col(f"bot_{t:02d}")).alias(f"n_bot_{t:02d}") for t in TIERS]
    return joined.groupBy(size, group).agg(F.count("*").alias("n_designs"), *top, *bottom)


def tier_shares(designs: DataFrame, size: str, score: str) -> DataFrame:
    """The share of each size class in each of its top tiers, against the nominal one."""
    joined = designs.join(tier_thresholds(designs, size, score), size)
    counts = joined.groupBy(size).agg(F.count("*").alias("all"), *[F.count_if(F.col(score) >= F.col(f"top_{t:02d}")).alias(f"n_{t:02d}") for t in TIERS])
    each = F.explode(F.array(*[F.struct(F.lit(f"{t:02d}").alias("tier"), F.col(f"n_{t:02d}").alias("n"), F.lit(t / 100).alias("nominal")) for t in TIERS]))
    return counts.select(size, "all", each.alias("t")).select(size, "t.tier", "t.n", F.round(F.col("t.n") / F.col("all"), 6).alias("share"), F.round("t.nominal", 6).alias("nominal"))


def percentile_sweep(designs: DataFrame, group: list[str], score: str, steps: int) -> DataFrame:
    """group, percent, value: the least score that percent of the rows do not exceed, at ``steps`` + 1 even anchors."""
    upto = cumulative(designs, group, score).withColumnRenamed(score, "value").withColumn("upto", F.col("before") + F.col("n"))
    # anchor a asks for the row of rank max(1, ceil(a * total / steps)): those whose rank falls among a value's own rows
    first = F.when(F.col("upto") == F.col("n"), F.lit(0)).otherwise(F.expr(f"(upto - n) * {steps} div total") + 1)
    last = F.expr(f"upto * {steps} div total")
    asked = upto.select(*group, "value", first.cast("bigint").alias("lo"), last.cast("bigint").alias("hi")).where("lo <= hi")
    each = asked.select(*group, "value", F.explode(F.sequence("lo", "hi")).alias("anchor"))
    return each.select(*group, (F.col("anchor") * F.lit(100.0) / F.lit(steps)).alias("percent"), "value")


def percentile_rank(rows: DataFrame, sweep: DataFrame, group: list[str], key: str, score: str, steps: int) -> DataFrame:
    """The percentile of each row's score in the sweep of its group, linear between anchors, 0 below and 100 above all."""
    # the anchors of a group, steps + 1 of them, in one array: a row meets its group once
    anchors = sweep.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("value", "percent"))).alias("anchors"))
    reached = F.filter("anchors", lambda a: a["value"] <= F.col(score))
    beyond = F.filter("anchors", lambda a: a["value"] > F.col(score))
    last = F.get(reached, F.size(reached) - 1)
    at = rows.join(anchors, group).select(key, score, F.array_max(F.transform(reached, lambda a: a["percent"])).alias("lo"), last["value"].alias("vlo"), F.get(beyond, F.lit(0))["value"].alias("vhi"))
    between = F.col("lo") + F.lit(100.0 / steps) * (F.col(score) - F.col("vlo")) / (F.col("vhi") - F.col("vlo"))
    return at.select(key, score, F.round(F.when(F.col("lo").isNull(), 0.0).when(F.col("vhi").isNull(), 100.0).otherwise(between), 6).alias("percent"))
