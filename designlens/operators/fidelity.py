"""How faithfully one score ranks designs against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from designlens.operators.ranks import average_rank, cumulative
from designlens.shared import materialize


def r_squared(df: DataFrame, group: list[str], actual: str, predicted: str) -> DataFrame:
    """1 - residual / total sum of squares; null where the actual score is constant."""
    total = F.var_pop(actual) * F.count("*")
    return df.groupBy(*group).agg(F.round(1 - F.sum((F.col(actual) - F.col(predicted)) ** 2) / F.nullif(total, F.lit(0.0)), 6).alias("r2"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks of ties; null where a score is constant.

    Ranks come from counts of distinct values in ranges, so no group is sorted in one task.
    """

    def ranked(c: str) -> DataFrame:
        return cumulative(df, group, c).select(*group, c, average_rank(F.col("n"), F.col("before")).alias(f"rank_{c}"))

    df = materialize(df.select(*group, x, y), "scores")  # read three times
    both = df.join(ranked(x), [*group, x]).join(ranked(y), [*group, y])
    a, b = f"rank_{x}", f"rank_{y}"
    return both.groupBy(*group).agg(F.round(F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0)), 6).alias("rho"))


def top_k_recall(df: DataFrame, actual: str, predicted: str, key: str, ks: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """Share of the k best by one score that are among the k best by the other; only the k best are ever sorted together."""
    k = max(ks)

    def best(c: str, name: str) -> DataFrame:
        top = df.select(key, c).orderBy(F.col(c).desc(), key).limit(k)
        return top.select(key, F.row_number().over(Window.orderBy(F.col(c).desc(), key)).alias(name))

    both = best(actual, "r1").join(best(predicted, "r2"), key)
    asked = both.select("r1", "r2", F.explode(F.array(*[F.lit(x) for x in ks])).alias("k"))
    return asked.groupBy("k").agg(F.round(F.count_if((F.col("r1") <= F.col("k")) & (F.col("r2") <= F.col("k"))) / F.col("k"), 6).alias("recall"))
