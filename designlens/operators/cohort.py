"""Cohorts of designs: stratified choice, merged sources, coverage, best variants, selection funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohort_topn(designs: DataFrame, strata: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each stratum with their rank. The limit reaches below the shuffle, so each task sends n rows at most."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return designs.withColumn("rank", rank).where(F.col("rank") <= n)


def source_merge(cohort: DataFrame, key: str, source: str, flag: str) -> DataFrame:
    """One row for each key: its sources in order, its best rank, and whether any of its rows has the flag."""
    return cohort.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("selected_for"), F.min("rank").alias("best_rank"), F.bool_or(flag).alias(flag))


def coverage(found: DataFrame, rows: DataFrame, columns: list[int], row: str, column: str, counted: str) -> DataFrame:
    """Distinct ``counted`` values in each cell of a grid, zero cells included."""
    grid = rows.select(row).distinct().withColumn(column, F.explode(F.array(*[F.lit(c) for c in columns])))
    n = found.groupBy(row, column).agg(F.count_distinct(counted).alias("n"))
    return grid.join(n, [row, column], "left").fillna(0, ["n"])


def variant_metrics(designs: DataFrame, group: list[str], variant: str, x: str, y: str, key: str, k: int = 10) -> DataFrame:
    """Of each variant: rows, the largest ``x``, the mean of its ``k`` largest, the mean of ``y``."""
    whole = designs.groupBy(*group, variant).agg(F.count("*").alias("n"), F.max(x).alias("max_x"), F.avg(y).alias("mean_y"))
    top = cohort_topn(designs, [*group, variant], [F.col(x).desc(), F.col(key)], k)
    return whole.join(top.groupBy(*group, variant).agg((F.sum(x) / F.count("*")).alias("top_x")), [*group, variant])


def best_variants(metrics: DataFrame, group: list[str], variant: str) -> DataFrame:
    """The best variant of each group by three measures, and which of them agree; of equals the first by name."""
    best = lambda m: F.min_by(variant, F.struct(-F.col(m), F.col(variant)))
    out = metrics.groupBy(*group).agg(best("max_x").alias("best_max"), best("top_x").alias("best_top"), best("mean_y").alias("best_mean"))
    same = lambda a, b: F.col(f"best_{a}") == F.col(f"best_{b}")
    return out.withColumns({"max_top": same("max", "top"), "max_mean": same("max", "mean"), "top_mean": same("top", "mean"), "all_agree": same("max", "top") & same("max", "mean")})


def agreement_rates(best: DataFrame) -> DataFrame:
    """The share of groups in which each two measures, and all three, name one variant."""
    flags = ("max_top", "max_mean", "top_mean", "all_agree")
    return best.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("double")), 6).alias(f) for f in flags])


def rejections(rows: DataFrame, rules: dict[str, Column], group: list[str]) -> DataFrame:
    """Rows by the first rule (name -> condition to pass) that they fail, or ``kept``."""
    reason = F.lit("kept")
    for name, passes in reversed(rules.items()):
        reason = F.when(F.coalesce(passes, F.lit(False)), reason).otherwise(name)
    return rows.groupBy(*group, reason.alias("reason")).agg(F.count("*").alias("n"))


def with_any_source(rows: DataFrame, sources: str, wanted: list[str]) -> DataFrame:
    """Rows whose array of sources holds any of the wanted ones, whatever the case; all rows if none is wanted."""
    if not wanted:
        return rows
    return rows.where(F.arrays_overlap(F.transform(sources, F.lower), F.array(*[F.lit(w.lower()) for w in wanted])))
