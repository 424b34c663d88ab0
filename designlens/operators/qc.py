"""Quality tiers of groups by two measures, and what they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(a: Column, b: Column, high: float, low: float) -> Column:
    """A1 if both measures reach ``high``, A2 if both reach ``low``, A3 otherwise, BROKEN where one is missing."""
    both = F.least(a, b)
    return F.when(a.isNull() | b.isNull(), "BROKEN").when(both >= high, "A1").when(both >= low, "A2").otherwise("A3")


def best_variant(metrics: DataFrame, group: list[str], variant: str, measure: str, others: list[str]) -> DataFrame:
    """The variant of each group with the largest ``measure``, of equals the first by name, with its other columns; missing measures lose."""
    row = F.struct(F.coalesce(-F.col(measure), F.lit(float("inf"))).alias("by"), F.col(variant).alias("variant"), F.col(measure).alias("m"), *[F.col(c) for c in others])
    return metrics.groupBy(*group).agg(F.min(row).alias("b")).select(*group, F.col("b.variant").alias("best_variant"), F.col("b.m").alias(measure), *[F.col(f"b.{c}").alias(c) for c in others])


def kept_rows(rows: DataFrame, best: DataFrame, group: list[str], variant: str, tiers: list[str]) -> DataFrame:
    """The rows of each kept group's best variant."""
    chosen = best.where(F.col("tier").isin(tiers)).select(*group, F.col("best_variant").alias(variant))
    return rows.join(chosen, [*group, variant], "left_semi")


def crosstab(table: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A row for each ``row`` value, a count for each of the stated ``values`` of ``column``."""
    return table.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values])


def calibration(observed: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``observed`` with the expected range (low, high) of its keys, and whether it lies inside; null where none is stated."""
    return observed.join(expected, keys, "left").withColumn("inside", F.col(value).between(F.col("low"), F.col("high")))
