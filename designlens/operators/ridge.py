"""Ridge fits on features that are on or off, from counts that Spark adds up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ridge(rows: DataFrame, group: list[str], features: str, score: str, alpha: float = 1.0) -> DataFrame:
    """``group``, feature (null: the intercept), coefficient, r2: least squares with ``alpha`` times the squared coefficients, none on the intercept.

    ``features`` is an array of the places of the ones. Rows are reduced to counts of pairs of features and sums of scores before
    they meet; a task solves one group, whose size is the square of its features (hundreds for slots and parts), whatever the rows.
    Without rows there is no fit; a constant score has a null r2.
    """
    own, y = F.array_sort(F.array_distinct(features)), F.col(score).cast("double")
    each = rows.where(F.col(features).isNotNull() & F.col(score).isNotNull()).select(*group, own.alias("own"), y.alias("y"))
    none = F.lit(None).cast("int")
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b >= a), lambda b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))))
    both = each.select(*group, F.explode(pairs).alias("p")).groupBy(*group, "p.a", "p.b").agg(F.count("*").cast("double").alias("v"), F.lit(0.0).alias("w"))
    single = each.select(*group, "y", F.explode("own").alias("a")).groupBy(*group, F.col("a").cast("int").alias("a")).agg(F.sum("y").alias("v"), F.lit(0.0).alias("w")).select(*group, "a", none.alias("b"), "v", "w")
    # squares are taken around the mean by Spark's own variance, so that large scores keep their digits
    whole = each.groupBy(*group).agg(F.count("*").cast("double").alias("v"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("ss"))
    ends = whole.select(*group, none.alias("a"), none.alias("b"), "v", F.col("m").alias("w")).union(whole.select(*group, none.alias("a"), F.lit(-1).alias("b"), F.col("ss").alias("v"), F.lit(0.0).alias("w")))
    fields = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in group)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in group]
        head, squares = pdf[pdf.a.isna() & pdf.b.isna()].iloc[0], pdf[pdf.a.isna() & pdf.b.notna()].v.iloc[0]
        sums, counts = pdf[pdf.a.notna() & pdf.b.isna()], pdf[pdf.a.notna() & pdf.b.notna()]
        names = np.sort(sums.a.to_numpy(dtype=np.int64))
        xy = sums.set_index("a").v.reindex(names).to_numpy()
        xx = np.zeros((len(names), len(names)))
        i, j = np.searchsorted(names, counts.a.to_numpy(dtype=np.int64)), np.searchsorted(names, counts.b.to_numpy(dtype=np.int64))
        xx[i, j] = xx[j, i] = counts.v
        share = np.diag(xx) / head.v
        centred, cross = xx - head.v * np.outer(share, share), xy - head.v * share * head.w
        fit = np.linalg.solve(centred + alpha * np.eye(len(names)), cross)
        r2 = 1 - (squares - 2 * fit @ cross + fit @ centred @ fit) / squares if squares > 0 else None
        out = pd.DataFrame({"feature": pd.array([None, *names], dtype="Int32"), "coefficient": [head.w - share @ fit, *fit]})
        for c, v in zip(group, key):
            out[c] = v
        return out.assign(r2=r2)[[*group, "feature", "coefficient", "r2"]]

    table = both.unionByName(single).unionByName(ends)
    return table.groupBy(*group).applyInPandas(solve, f"{fields}, feature int, coefficient double, r2 double")


def extremes(fit: DataFrame, group: list[str], n: int) -> DataFrame:
    """The ``n`` largest and the ``n`` least coefficients of each fit, with their rank from each end."""
    known = fit.where("feature is not null")
    up = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("coefficient"), "feature"))
    down = F.row_number().over(Window.partitionBy(*group).orderBy("coefficient", "feature"))
    return known.withColumns({"from_top": up, "from_bottom": down}).where((F.col("from_top") <= n) | (F.col("from_bottom") <= n))
